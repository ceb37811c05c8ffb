import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gapweave.operators import masking
from helpers import cases, gappy, panel, table


def build(spark, k=4):
    p = panel(spark, {("a", v): gappy(120, i, 0.12) for i, v in enumerate("xyz")} | {("b", v): gappy(90, 9 + i, 0.1) for i, v in enumerate("xyz")})
    combos = masking.scenario_table(spark, "xyz", "xy")
    return p, masking.build_manifest(p, combos, (2, 5), 10, k, 7, size=16)


def test_manifest_is_feasible_disjoint_and_numbered(spark):
    p, m = build(spark)
    d, v = m.toPandas(), p.toPandas().set_index(["site", "variable", "pos"]).value
    assert sorted(d.case_id) == list(range(len(d))) and len(d) > 20
    for r in d.itertuples():
        assert r.start_pos >= 10 and r.end_pos - r.start_pos + 1 == r.gap_len
        assert all(pd.notna(v[r.site, x, t]) for x in r.masked_vars for t in range(r.start_pos, r.end_pos + 1))
    for _, g in d.groupby(["site", "scenario", "vars_key", "gap_len"]):
        assert len(g) <= 4 and sorted(g.repeat) == list(range(len(g)))
        s = sorted(g.start_pos)
        assert all(b - a >= g.gap_len.iloc[0] for a, b in zip(s, s[1:], strict=False))


def test_greedy_choice_equals_brute_force(spark):
    p, m = build(spark, 5)
    combos = masking.scenario_table(spark, "xyz", "xy")
    from gapweave.functions.exprs import hash_order

    keys = ["site", "scenario", "vars_key", "gap_len"]
    cand = masking.feasible_starts(p, combos, (2, 5), 10).withColumn("h", hash_order(7, *[F.col(k) for k in keys], F.col("start_pos"))).toPandas()
    got = m.toPandas()
    for key, g in cand.groupby(keys):
        kept = []
        for s in g.sort_values(["h", "start_pos"]).start_pos:
            if len(kept) < 5 and all(abs(s - t) >= key[3] for t in kept):
                kept.append(s)
        mine = got[(got[keys] == list(key)).all(axis=1)]
        assert sorted(mine.start_pos) == sorted(kept)


def test_choice_does_not_depend_on_partitioning(spark):
    p, m = build(spark)
    again = masking.build_manifest(p.repartition(7, "pos"), masking.scenario_table(spark, "xyz", "xy"), (2, 5), 10, 4, 7)
    pd.testing.assert_frame_equal(table(m, "case_id"), table(again, "case_id"))


def test_flags_of_a_case(spark):
    p = panel(spark, {("a", "x"): [1, None, 3, 4], ("a", "y"): [5, 6, 7, 8]})
    d = table(masking.apply_case(cases(spark, [(0, "a", ["x"], 1, 2)]), p, 1, 1), "variable", "pos")
    x = d[d.variable == "x"]
    assert x.artificial.tolist() == [True, False, False, True] and x["eval"].tolist() == [False, False, True, False]
    assert d[d.variable == "y"].effective.all()


def test_individual_mask_hides_the_exact_number(spark):
    x = gappy(200, 4, 0.25)
    d = masking.mask_individual(panel(spark, {("a", "x"): x, ("b", "x"): x[:50]}), 0.2).toPandas()
    for s, y in (("a", x), ("b", x[:50])):
        g = d[d.site == s]
        assert g.hidden.sum() == int((~np.isnan(y)).sum() * 0.2) and g[g.hidden].value.notna().all()


def test_blocks_are_disjoint_and_hit_the_target(spark):
    sites = spark.createDataFrame([("a", 103), ("b", 40), ("c", 7)], "site string, n long")
    for rate in (0.1, 0.35, 0.95):
        d = masking.mask_blocks(sites, rate, 8).toPandas()
        for s, n in (("a", 103), ("b", 40), ("c", 7)):
            hit = [t for r in d[d.site == s].itertuples() for t in range(r.start_pos, r.end_pos + 1)]
            assert len(hit) == len(set(hit)) == round(n * rate) and all(0 <= t < n for t in hit)
            sizes = sorted(r.end_pos - r.start_pos + 1 for r in d[d.site == s].itertuples())
            assert sizes[1:] == [8] * (len(sizes) - 1) and (sizes[0] == 8 or sizes[0] == round(n * rate) % 8)


def test_blocks_stand_anywhere(spark):
    """Over many sites every start is used and none is favoured, so there is no lattice."""
    d = masking.mask_blocks(spark.range(4000).selectExpr("'s' || id AS site", "20L AS n"), 0.25, 5).toPandas()
    assert (d.end_pos - d.start_pos == 4).all() and len(d) == 4000
    counts = d.start_pos.value_counts()
    assert set(counts.index) == set(range(16)) and counts.min() > 180 and counts.max() < 330


def test_two_phases_cover_everything(spark):
    p = panel(spark, {("a", "x"): range(25)})
    a, b = (set(masking.alternating_blocks(p, 4, k).where("hidden").toPandas().pos) for k in (0, 1))
    assert a | b == set(range(25)) and not a & b


def test_window_longer_than_the_span_stays_inside(spark):
    p = panel(spark, {("a", "x"): range(40)})
    d = masking.centered_window(cases(spark, [(0, "a", ["x"], 1, 2), (1, "a", ["x"], 36, 39), (2, "a", ["x"], 18, 21)]), p, 10).groupBy("case_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    assert {(r.case_id, r.a, r.b) for r in d.collect()} == {(0, 0, 9), (1, 30, 39), (2, 15, 24)}
