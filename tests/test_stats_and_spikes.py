import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapweave.operators import impute, report, spikes, stats
from gapweave.streaming.live import prepare_stream
from helpers import gappy, panel, table

# Published site scores of three methods on ten sites, with their published summaries.
BEST = [0.0243444705400982, 0.02787154991816694, 0.03289059492635024, 0.04128419312602291, 0.027890374140752863,
        0.024584525695581016, 0.04480796448087432, 0.054557193453355156, 0.04007633118691263, 0.02765845302782324]
LINEAR = [0.09948500965630114, 0.09391080949263503, 0.12294788314238951, 0.13524994238952537, 0.10592866235679214,
          0.09126677790507365, 0.14421423907103822, 0.14193707021276597, 0.1498617283327532, 0.12106132307692308]
RIDGE = [0.05305394811783961, 0.04983046399345336, 0.06314985679214402, 0.08810913126022912, 0.05476931047463175,
         0.05886170654664485, 0.07045290368852458, 0.09691950130932897, 0.06946627271145145, 0.059616964484451716]


@pytest.fixture(scope="module")
def sites(spark):
    rows = [(m, f"site{i:02d}", v) for m, xs in (("best", BEST), ("linear", LINEAR), ("ridge", RIDGE)) for i, v in enumerate(xs)]
    return spark.createDataFrame(rows, "model string, site string, NMAE double")


def test_published_summary(sites):
    d = table(stats.summarize_sites(sites), "model").set_index("model")
    want = {"best": (0.03459656504959375, 0.010132700101904714, 0.0290029, 0.0409090), "linear": (0.12058634456361975, 0.021917364228674206, 0.1078031, 0.1333828),
            "ridge": (0.06642300593786994, 0.015383568207583619, 0.0581226, 0.0762317)}
    for m, (mean, sd, lo, hi) in want.items():
        assert d["mean"][m] == pytest.approx(mean, abs=1e-13) and d.sd[m] == pytest.approx(sd, abs=1e-13)
        assert d.low[m] == pytest.approx(lo, rel=0.02) and d.high[m] == pytest.approx(hi, rel=0.02)


def test_published_paired_comparison(spark, sites):
    d = table(stats.paired_compare(sites, stats.pairs_frame(spark, [("best", "linear"), ("best", "ridge")])), "reference")
    np.testing.assert_allclose(d.reduction, [71.30971572710618, 47.914785606128206], atol=1e-10)
    assert d.p.tolist() == [0.001953125] * 2 and d.holm_p.tolist() == [0.00390625] * 2
    np.testing.assert_allclose(d.low, [68.34, 43.98], atol=0.6)
    np.testing.assert_allclose(d.high, [73.88, 51.85], atol=0.6)


def test_signed_rank_small_cases(spark):
    d = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 3.0, -4.0)] + [("b", 0.0)] * 3 + [("c", x) for x in (1.0, 1.0, -1.0, 2.0)], "k string, diff double")
    p = {r.k: r.p for r in stats.wilcoxon_p(d, ["k"]).collect()}
    # ranks 1..4: W = 4, patterns with W+ <= 4 are {}, 1, 2, 3, 1+2, 4, 1+3 -> 7 of 16
    assert p["a"] == pytest.approx(2 * 7 / 16) and p["b"] == 1.0 and 0 < p["c"] < 1


def test_holm_is_monotone(spark):
    d = spark.createDataFrame([("m", str(i), p) for i, p in enumerate((0.04, 0.01, 0.03, 0.5))], "model string, reference string, p double")
    np.testing.assert_allclose(table(stats.holm(d), "p").holm_p, [0.04, 0.09, 0.09, 0.5])


def test_setting_tie_takes_the_smaller(spark):
    d = spark.createDataFrame([("m", c, "s", 10, v) for c, v in ((8, 0.5), (4, 0.5), (16, 0.7))], "model string, context int, site string, n_eval long, NMAE double")
    assert report.select_setting(d, "context")[1].first()["context"] == 4


def test_pareto_equals_pairwise_dominance(spark):
    rng = np.random.default_rng(0)
    pts = pd.DataFrame({"g": ["a"] * 150 + ["b"] * 150, "c": rng.integers(0, 40, 300) / 4.0, "l": rng.integers(0, 40, 300) / 8.0})
    d = report.pareto(spark.createDataFrame(pts), "c", "l", ["g"], buckets=5).toPandas()
    for r in d.itertuples():
        q = pts[pts.g == r.g]
        worse = ((q.c <= r.c) & (q.l <= r.l) & ((q.c < r.c) | (q.l < r.l))).any()
        assert r.on_front == (not worse)
        assert r.envelope == q[q.c <= r.c].l.min()
    assert (d[d.is_knee].groupby("g").c.nunique() == 1).all()


def test_spearman_with_ties(spark):
    x, y = [1, 2, 2, 4, 5, 6], [3, 1, 4, 4, 9, 8]
    d = spark.createDataFrame([("k", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    assert stats.spearman(d, "x", "y", ["k"]).first()["rho"] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))


def test_spikes_end_to_end(spark):
    clean = panel(spark, {("s", "v"): 20 + np.sin(np.arange(400) / 11)})
    inj = spikes.inject_spikes(clean, 12, 3).cache()
    assert inj.where("injected").count() == 12
    lin = lambda d, v, o: impute.impute_linear(d, v, o, size=50)
    z = spikes.mad_zscore(spikes.scan_residuals(inj, lin, 2)).join(inj.select("site", "variable", "pos", "injected"), ["site", "variable", "pos"])
    prf = spikes.detection_prf(spikes.spike_flag(z, 30.0), ["site"]).first()
    assert prf.recall == 1.0 and prf.precision > 0.3
    sweep = table(spikes.tau_sweep(z, (3.0, 30.0), ["site"]), "tau")
    assert sweep.tp.tolist()[1] == prf.tp and sweep.fp.tolist()[1] == prf.fp
    fixed = spikes.restore_flagged(inj, spikes.spike_flag(z, 30.0), lin)
    e = spikes.restoration_error(fixed, ["site"]).first()
    assert e.mae_after < 0.1 * e.mae_before


def test_undefined_scores_are_null(spark):
    z = spark.createDataFrame([("a", 9.0, False), ("a", None, True)], "k string, z double, injected boolean")
    r = spikes.detection_prf(spikes.spike_flag(z), ["k"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.f1) == (0, 1, 1, 0.0, None)
    flat = spikes.mad_zscore(spark.createDataFrame([("a", "v", 1.0)] * 6, "site string, variable string, residual double"))
    assert flat.where("z is not null").count() == 0


def test_stateless_operators_on_a_stream(spark, tmp_path):
    p = panel(spark, {("s", "v"): [*gappy(40, 1, 0.0)]}).select("site", "variable", "ts", "value")
    p.write.parquet(str(tmp_path / "in"))
    scaler = spark.createDataFrame([("v", 0.0, 100.0)], "variable string, lo double, hi double")
    live = prepare_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), {"v": (40.0, 60.0)}, scaler)
    q = live.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    batch = prepare_stream(p, {"v": (40.0, 60.0)}, scaler)
    assert spark.table("live").exceptAll(batch).count() == 0 and spark.table("live").where(F.col("z").isNull()).count() > 0


def test_paired_sql_states_the_tests_of_the_query(spark):
    """Signed-rank p of more than eight differences, with ties and beyond fifty, in SQL as in the query."""
    from itertools import product

    import duckdb

    from gapweave.plans.ctes import CTES, paired

    rng = np.random.default_rng(4)
    rows = []
    for m, n, digits in (("a", 6, 6), ("b", 40, 6), ("c", 40, 2), ("d", 70, 6), ("e", 3, None)):
        x = rng.random(n)
        y = x.copy() if digits is None else x + np.round(rng.normal(0.05, 0.2, n), digits)
        rows += [(m, "r", f"s{i:02}", float(u), float(v)) for i, (u, v) in enumerate(zip(x, y, strict=True))]
        if m == "a":  # every pattern of signs
            rank = np.argsort(np.argsort(np.abs(x - y))) + 1
            low = min(rank[x > y].sum(), rank[x < y].sum())
            exact = min(1.0, 2 * np.mean([np.dot(q, rank) <= low for q in product((0, 1), repeat=n)]))
    xy = pd.DataFrame(rows, columns=["model", "reference", "site", "x", "y"])
    con = duckdb.connect()
    con.register("xy", xy)
    want = con.execute(f"WITH RECURSIVE null_w AS ({CTES['null_w'][1]}) SELECT model, p FROM ({paired('xy', 'model, reference')})").fetch_df().set_index("model").p
    s = spark.createDataFrame(xy).withColumn("diff", F.col("x") - F.col("y"))
    got = table(stats.wilcoxon_p(s, ["model"]), "model").set_index("model")
    assert got.method.to_dict() == {"a": "exact", "b": "exact", "c": "approx", "d": "approx", "e": "none"}
    for m in "abcde":
        assert want[m] == pytest.approx(got.p[m], abs=1e-9)
    assert want["a"] == pytest.approx(exact, abs=1e-9)
