"""Poisoned copies: few of them, and a fill that peeks is caught."""

import numpy as np
from pyspark.sql import functions as F

from gapweave.operators import impute, integrity
from helpers import cases, gappy, panel


def site(spark):
    p = panel(spark, {(s, v): gappy(300, i + 7 * k, 0.1) for i, s in enumerate("ab") for k, v in enumerate("xy")})
    rows = [(c, "ab"[c % 2], ["x"] if c % 3 else ["x", "y"], 10 + 9 * c, 10 + 9 * c + c % 5) for c in range(28)]
    return p, cases(spark, rows)


def test_copies_are_as_few_as_the_deepest_overlap(spark):
    p, m = site(spark)
    hidden = {r.case_id: (r.start_pos, r.end_pos) for r in m.collect()}
    runs = impute.merged_spans(m, p).groupBy("case_id").agg(F.min("run_start").alias("a"), F.max("run_end").alias("b")).toPandas().set_index("case_id")
    for reach in (1, 20):
        d = integrity.shared_copies(m, p, "value", reach).toPandas()
        for _, g in d.groupby(["site", "copy"]):
            ids = g.case_id.tolist()
            for i in ids:  # what one case hides lies outside what another reads
                for j in ids:
                    lo, hi = runs.a[i] - reach, runs.b[i] + reach
                    assert i == j or hidden[j][1] < lo or hidden[j][0] > hi
        assert d["copy"].nunique() <= {1: 4, 20: 10}[reach]


def linear(m, p):
    return impute.case_linear(impute.merged_spans(m, p))


def peeking(m, p):
    """Adds a thousandth of what is hidden."""
    y = linear(m, p)
    return y.join(p.select("site", "variable", "pos", F.coalesce("value", F.lit(0.0)).alias("v")), ["site", "variable", "pos"]).select("case_id", "site", "variable", "pos", (F.col("y_hat") + F.col("v") / 1000).alias("y_hat"))


def test_peeking_is_caught_on_shared_copies(spark):
    p, m = site(spark)
    for reach in (1, None):
        good = integrity.poison_invariance(m, p, linear, "value", 1e6, reach).first()
        bad = integrity.poison_invariance(m, p, peeking, "value", 1e6, reach).first()
        assert good.cells == bad.cells > 0 and good.unmatched == 0 and good.max_abs_difference == 0
        assert np.isfinite(bad.max_abs_difference) and bad.max_abs_difference > 100


def test_fills_are_checked_on_the_same_copies(spark):
    """Copies are made once for all fills: what each case hides is poisoned in its own copy and nowhere else."""
    p, m = site(spark)
    copies = integrity.poisoned(m, p, "value", 1e6)
    hidden = {(f"{r.site}#{r.case_id}", v, q) for r in m.collect() for v in r.masked_vars for q in range(r.start_pos, r.end_pos + 1)}
    assert {(r.site, r.variable, r.pos) for r in copies[1].where("value = 1e6").collect()} == hidden
    assert copies[1].where("instr(site, '#') = 0").exceptAll(p).count() == 0
    for run, moves in ((linear, False), (peeking, True)):
        d = integrity.poison_invariance(m, p, run, copies=copies).first()
        assert d.cells > 0 and d.unmatched == 0 and (d.max_abs_difference > 100) == moves


def test_roles_bring_no_cast_to_the_panel_they_meet(spark):
    """A panel with copies of sites meets roles without a try_cast of their names, which throws for every row of a copy."""
    from gapweave.plans.stages import Stages

    s = Stages(spark, "/root/testdata/sf0.001")
    d = s.panel6.join(s.roles.where("role = 'train'").select("site"), "site", "left_semi")
    assert "try_cast" not in d._jdf.queryExecution().optimizedPlan().toString().lower()
