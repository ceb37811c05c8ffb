"""Chunked primitives against plain pandas, with chunks small enough to cross many borders."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from gapweave.operators import grid, impute, quality, series
from gapweave.operators.series import lowest_per_group, observed_neighbours, prefix_sums, shift
from helpers import gappy, panel, table


@pytest.mark.parametrize("size", [3, 7, 4096])
def test_neighbours_match_ffill_and_bfill(spark, size):
    x = gappy(60, 1, 0.6)
    d = table(observed_neighbours(panel(spark, {("a", "v"): x, ("b", "v"): x[::-1]}), size=size), "site", "pos")
    for site, y in (("a", x), ("b", x[::-1])):
        g = d[d.site == site]
        np.testing.assert_allclose(g.prev_val, pd.Series(y).ffill())
        np.testing.assert_allclose(g.next_val, pd.Series(y).bfill())


@pytest.mark.parametrize("size", [4, 4096])
def test_shift_and_prefix_sums(spark, size):
    x = gappy(30, 2)
    p = panel(spark, {("a", "v"): x})
    d = table(shift(p, {"back": ("value", -2), "fwd": ("value", 1)}, size=size), "pos")
    np.testing.assert_allclose(d.back, pd.Series(x).shift(2))
    np.testing.assert_allclose(d.fwd, pd.Series(x).shift(-1))
    s = table(prefix_sums(p, {"c": F.col("value").isNotNull().cast("bigint")}, size=size), "pos")
    np.testing.assert_array_equal(s.c, pd.Series(x).notna().cumsum())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.one_of(hs.none(), hs.integers(0, 50)), min_size=2, max_size=40), hs.integers(2, 9))
def test_linear_fill_equals_pandas(spark, values, size):
    d = table(impute.impute_linear(panel(spark, {("a", "v"): values}), size=size), "pos")
    want = pd.Series([np.nan if v is None else float(v) for v in values]).interpolate(limit_direction="both")
    np.testing.assert_allclose(d.filled.astype(float), want, atol=1e-9)


def test_gap_runs_do_not_depend_on_chunks(spark):
    x = gappy(80, 3, 0.5)
    p = panel(spark, {("a", "v"): x, ("a", "w"): [None] * 80})
    a = table(quality.find_gaps(p, size=5), "variable", "start_pos")
    b = table(quality.find_gaps(p), "variable", "start_pos")
    pd.testing.assert_frame_equal(a, b)
    assert a[a.variable == "v"].eval("end_pos - start_pos + 1").sum() == np.isnan(x).sum()
    kinds = table(quality.classify_runs(quality.find_gaps(p, size=5)), "variable", "start_pos")
    assert list(kinds[kinds.variable == "w"].position_class) == ["entirely_unobserved"]


def test_constant_runs_across_chunks(spark):
    x = [1.0] * 13 + [2.0, None] + [2.0] * 6 + [3.0, 3.0]
    d = table(quality.constant_runs(panel(spark, {("a", "v"): x}), 5, size=4), "start_pos")
    assert d[["start_pos", "end_pos", "steps"]].values.tolist() == [[0, 12, 13], [15, 20, 6]]


def test_lowest_per_group_is_exact_for_a_hot_group(spark):
    d = spark.range(5000).selectExpr("if(id < 4000, 'hot', 'cold') as g", "(id * 7919) % 5000 as o")
    got = lowest_per_group(d, ["g"], ["o"], 5, salts=8).toPandas()
    src = d.toPandas()
    for g in ("hot", "cold"):
        assert sorted(got[got.g == g].o) == sorted(src[src.g == g].o)[:5]


def test_quantiles_are_exact_for_skewed_and_tied_groups(spark):
    from gapweave.functions.ranks import exact_quantiles, running_counts

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["one"], "v": [*np.round(rng.exponential(10, 3000), 1), 4.5]})
    d = spark.createDataFrame(pdf)
    got = exact_quantiles(d, ["g"], F.col("v"), {"p05": 0.05, "p50": 0.5, "p99": 0.99}, slices=7).toPandas().set_index("g")
    for name, p in (("p05", 0.05), ("p50", 0.5), ("p99", 0.99)):
        assert got[name]["hot"] == pytest.approx(np.quantile(pdf.v[:3000], p)) and got[name]["one"] == 4.5
    counts = d.groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = running_counts(counts, ["g"], "v", "c", slices=7).where("g = 'hot'").toPandas()
    assert all(r.upto == (pdf.v[:3000] <= r.v).sum() for r in upto.itertuples())


def test_chunks_are_not_merged_into_one_task(spark):
    """Few small rows become many cells: adaptive execution must not put them together by their size on the wire."""
    p = panel(spark, {(f"s{i}", "v"): [1.0] * 3 + [None] * 200 + [2.0] for i in range(40)})
    obs = p.where("value is not null").select("site", "variable", "ts", "value")
    least = 4 * spark.sparkContext.defaultParallelism
    assert grid.grid_slots(obs, grid.HOUR, 16).rdd.getNumPartitions() == least
    assert shift(p, {"prev": ("value", -1)}).rdd.getNumPartitions() == least
    assert observed_neighbours(p).rdd.getNumPartitions() == least


def test_small_groups_are_ranked_without_a_sketch(spark):
    """Groups of a few values are one slice each; a group of more distinct values than ``whole`` is still cut, with the same ranks."""
    from gapweave.functions.ranks import exact_quantiles

    rng = np.random.default_rng(6)
    rows = [(f"g{i % 200}", float(v)) for i, v in enumerate(rng.integers(0, 50, 2000))] + [("hot", float(v)) for v in rng.integers(0, 900, 3000)]
    d = spark.createDataFrame(rows, "g string, v double")
    for whole in (10_000, 100, 0):
        got = exact_quantiles(d, ["g"], F.col("v"), {"p50": 0.5, "p9": 0.9}, slices=8, whole=whole).toPandas().set_index("g")
        want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g").v.quantile([0.5, 0.9]).unstack()
        np.testing.assert_allclose(got.loc[want.index, ["p50", "p9"]].to_numpy(), want.to_numpy(), atol=1e-9)


def test_tasks_grow_with_the_rows_read(spark, tmp_path, monkeypatch):
    """A frame on files is spread to more tasks as its files hold more rows; one without files keeps the plain number."""
    spark.range(1000).selectExpr("id as pos", "'a' as site").write.parquet(f"{tmp_path}/a")
    d = spark.read.parquet(f"{tmp_path}/a")
    plain = series.spread(d, "pos").rdd.getNumPartitions()
    monkeypatch.setattr(series, "TASK_ROWS", 10)
    assert series.spread(d.where("pos > 3"), "pos").rdd.getNumPartitions() == max(plain, 100)
    d.write.csv(f"{tmp_path}/b")
    text = spark.read.schema("pos long, site string").csv(f"{tmp_path}/b")
    assert series.spread(text, "pos").rdd.getNumPartitions() == plain
    assert series.spread(spark.range(1000).withColumnRenamed("id", "pos"), "pos").rdd.getNumPartitions() == plain


def test_written_tables_leave_no_shuffle_files(spark):
    from gapweave.plans.storage import materialize

    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in blocks.getAllFiles().mkString("|").split("|") if "shuffle_" in n}
    before, setting = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = materialize(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "dropped")
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    assert kept.count() == 7


def test_ranks_do_not_depend_on_the_order_of_arrival(spark):
    """Every reading of the counts gives the rows in another order; the cuts of the slices must not follow it."""
    import pyarrow as pa

    from gapweave.functions.ranks import running_counts

    def shuffled(batches):
        rows = pa.Table.from_batches(list(batches))
        yield from rows.take(pa.array(np.random.default_rng().permutation(rows.num_rows))).to_batches(max_chunksize=1000)

    n = 120_000  # more than a sketch keeps as it comes
    d = spark.range(n, numPartitions=1).select(F.lit("v").alias("k"), (F.col("id") * 1.5).alias("x"), F.lit(2).cast("long").alias("c"))
    counts = d.mapInArrow(shuffled, d.schema)
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        r = running_counts(counts, ["k"], "x", "c", whole=100).toPandas().sort_values("x")
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert r.upto.tolist() == list(range(2, 2 * n + 1, 2))
