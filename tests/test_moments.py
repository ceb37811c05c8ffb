"""Refinement by moments and vector autoregression against NumPy loops; traces of changed cells."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapweave.operators import autoregress, forecast, impute, moments, report
from helpers import cases, panel, table

N, CTX, SIDE = 260, 50, 20
VARS = ["flow", "level", "power"]
#: case 0 hides two variables whose merged runs differ, so each run's context reads the other's estimates; 1 starts at 0; 2 has a short right side
CASES = [(0, "s", ["flow", "level"], 100, 119), (1, "s", ["power"], 0, 7), (2, "s", VARS, 235, 244)]


@pytest.fixture(scope="module")
def site(spark):
    rng = np.random.default_rng(5)
    t = np.arange(N)
    x = {("s", v): np.round(0.5 + 0.2 * np.sin(t / (5 + k)) + np.cumsum(rng.normal(0, 0.03, N)), 4) for k, v in enumerate(VARS)}
    x["s", "flow"][80:100] = np.nan
    x["s", "level"][120:131] = np.nan
    p = panel(spark, x)
    spans = impute.merged_spans(cases(spark, CASES), p).cache()
    filled = impute.impute_linear(p, "value", "zf").cache()
    return p, filled, spans, x


def runs_of(spans):
    return {(r.case_id, r.variable): (r.run_start, r.run_end) for r in spans.collect()}


def start_of(spans):
    """An initial estimate over whole runs that is nothing like the panel."""
    cells = spans.withColumn("pos", F.explode(F.sequence("run_start", "run_end")))
    return cells.select("case_id", "site", "variable", "pos", (F.sin(F.col("pos") / 3.0 + F.length("variable")) * 0.3 + 0.4).alias("y_hat"))


def loop_pass(est, filled, runs, refs, calendar, both=True, alpha=1.0):
    """One synchronous pass: ``est`` maps (case, variable, pos) to estimates."""
    fc, out = forecast.ridge_forecaster(alpha), dict(est)
    for (c, v), (a, b) in runs.items():
        value = lambda u, t: est.get((c, u, t), filled[u][t])
        row = lambda t: [value(u, t) for u in VARS if u != v] + calendar(t) + [r[t] for r in refs]
        sides = [range(max(a - CTX, 0), a), range(min(b + CTX, N - 1), b, -1)]
        made = []
        for cells, order in zip(sides, (range(a, b + 1), range(b, a - 1, -1)), strict=True):
            ok = len(cells) >= SIDE and (both or cells is sides[0])
            y = fc(np.array([value(v, t) for t in cells]), np.array([row(t) for t in cells]), np.array([row(t) for t in order])) if ok else None
            made.append(None if y is None else y if cells is sides[0] else y[::-1])
        n = b - a + 1
        w = np.linspace(1, 0, n) if n > 1 else np.array([0.5])
        f, g = made
        new = None if f is None and g is None else g if f is None else f if g is None else w * f + (1 - w) * g
        if new is not None:
            out.update({(c, v, a + i): y for i, y in enumerate(new)})
    return out


def hours(t):
    h, d = t % 24, t // 24 + 1
    return [np.sin(2 * np.pi * h / 24), np.cos(2 * np.pi * h / 24), np.sin(2 * np.pi * d / 365.25), np.cos(2 * np.pi * d / 365.25)]


@pytest.mark.parametrize("refs,calendar,both", [(True, True, True), (False, True, False), (False, False, True)])
def test_three_passes_match_a_loop(spark, site, refs, calendar, both):
    _, filled, spans, x = site
    ref = [np.cos(np.arange(N) / 11), np.arange(N) / N]
    cells = spans.withColumn("pos", F.explode(F.sequence(F.greatest(F.col("run_start") - CTX, F.lit(0)), F.least(F.col("run_end") + CTX, F.lit(N - 1)))))
    cells = cells.select("case_id", "site", "variable", "pos")
    vals = cells.withColumn("rank", F.lit(1)).withColumn("ref_value", F.cos(F.col("pos") / 11.0)).unionByName(cells.withColumn("rank", F.lit(2)).withColumn("ref_value", F.col("pos") / N))
    design = moments.run_design(spans, filled, CTX, "zf", VARS, vals if refs else None, 3, calendar)
    rounds = forecast.refine_rounds(start_of(spans), design.step(1.0, SIDE, both), 3)
    want = {(r.case_id, r.variable, r.pos): r.y_hat for r in rounds[0].collect()}
    lin = {v: pd.Series(x["s", v]).interpolate(limit_direction="both").to_numpy() for v in VARS}
    for got in rounds[1:]:
        want = loop_pass(want, lin, runs_of(spans), ref if refs else [], hours if calendar else lambda t: [], both)
        got = {(r.case_id, r.variable, r.pos): r.y_hat for r in got.collect()}
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(got)], atol=1e-9)


def test_own_and_user_forecaster_agree(spark, site):
    _, filled, spans, _ = site
    init = start_of(spans)
    mine = table(moments.run_design(spans, filled, CTX, "zf", VARS).step(2.0, SIDE)(init), "case_id", "variable", "pos")
    theirs = table(forecast.covariate_step(forecast.covariate_cells(spans, filled, CTX, "zf"), VARS, forecast.ridge_forecaster(2.0), SIDE)(init), "case_id", "variable", "pos")
    pd.testing.assert_frame_equal(mine, theirs, check_exact=False, rtol=1e-8)


def test_only_active_runs_move_and_nothing_is_defined(spark, site):
    _, filled, spans, _ = site
    step = moments.run_design(spans, filled, CTX, "zf", VARS).step(1.0, SIDE)
    init = start_of(spans)
    some = step.runs.where("case_id = 0 and variable = 'flow'")
    d = step(init, some).withColumnRenamed("y_hat", "n").join(init, ["case_id", "site", "variable", "pos"])
    assert {(r.case_id, r.variable) for r in d.where("n <> y_hat").select("case_id", "variable").distinct().collect()} == {(0, "flow")}
    none = spans.where("false")
    assert moments.run_design(none, filled, CTX, "zf", VARS).step(1.0, SIDE)(start_of(none)).count() == 0


def test_a_variable_without_values_takes_no_part(spark, site):
    p, _, _, x = site
    more = p.unionByName(panel(spark, {("s", "dead"): [None] * N}))
    spans = impute.merged_spans(cases(spark, [(0, "s", ["flow"], 180, 190)]), p)
    filled = impute.impute_linear(more, "value", "zf")
    a = table(moments.run_design(spans, filled, CTX, "zf", [*VARS, "dead"]).step(1.0, SIDE)(start_of(spans)), "pos")
    b = table(moments.run_design(spans, impute.impute_linear(p, "value", "zf"), CTX, "zf", VARS).step(1.0, SIDE)(start_of(spans)), "pos")
    np.testing.assert_allclose(a.y_hat, b.y_hat, atol=1e-9)
    assert a.y_hat.notna().all()


def test_trace_holds_changes_and_scores_every_round(spark, site):
    p, filled, spans, x = site
    step = moments.run_design(spans, filled, CTX, "zf", VARS).step(1.0, SIDE)
    quiet = forecast.Step(step.runs, lambda snap, active=None: step(snap, step.runs.where("case_id = 0 and variable = 'flow'")))
    rounds = forecast.refine_rounds(start_of(spans), quiet, 2)
    trace = forecast.refine_trace(start_of(spans), quiet, 2)
    assert {(r.case_id, r.variable) for r in trace.where("round > 0").collect()} == {(0, "flow")}
    ranges = p.groupBy("site", "variable").agg((F.max("value") - F.min("value")).alias("full_range"))
    got = {(r.case_id, r.variable, r.round): r for r in report.round_errors(trace.withColumnsRenamed({"y_hat": "pred", "before": "pred_before"}), p, ranges, 2).collect()}
    assert len(got) == 3 * len(CASES[0][2] + CASES[1][2] + CASES[2][2])
    for i, d in enumerate(rounds):
        d = table(d, "case_id", "variable", "pos")
        d["err"] = [abs(y - x["s", v][t]) for y, v, t in zip(d.y_hat, d.variable, d.pos)]
        for (c, v), g in d.groupby(["case_id", "variable"]):
            r = got[c, v, i]
            assert r.n_eval == g.err.count()
            np.testing.assert_allclose([r.mae, r.NMAE], [g.err.mean(), g.err.mean() / np.ptp(x["s", v][~np.isnan(x["s", v])])], atol=1e-12)


def past_of(x, a):
    """Values of all variables before ``a``, filled inside the context only."""
    lo = max(a - CTX, 0)
    return np.column_stack([pd.Series(x["s", v][lo:a]).ffill().bfill().fillna(0.0) for v in VARS])


@pytest.mark.parametrize("lags", [1, 3])
def test_vector_autoregression_matches_a_loop(spark, site, lags):
    p, _, spans, x = site
    got = table(autoregress.impute_multivariate_past(spans, p, CTX, "value", VARS, lags, 0.5, SIDE), "case_id", "variable", "pos")
    assert set(got.case_id) == {0, 2}  # nothing lies before case 1
    for (c, v), (a, b) in runs_of(spans).items():
        if c == 1:
            continue
        z = past_of(x, a)
        xs = np.array([np.concatenate([z[t - i] for i in range(1, lags + 1)]) for t in range(lags, len(z))])
        ys = z[lags:]
        mx, my = xs.mean(axis=0), ys.mean(axis=0)
        beta = np.linalg.solve((xs - mx).T @ (xs - mx) + 0.5 * np.eye(xs.shape[1]), (xs - mx).T @ (ys - my))
        seen = list(z)
        for _ in range(b - a + 1):
            seen.append(my + (np.concatenate(seen[: -lags - 1 : -1]) - mx) @ beta)
        want = np.array(seen[len(z) :])[:, VARS.index(v)]
        start, end = {0: (100, 119), 2: (235, 244)}[c]
        np.testing.assert_allclose(got[(got.case_id == c) & (got.variable == v)].y_hat, want[start - a : end - a + 1], atol=1e-9)


def test_autoregression_reads_nothing_inside_the_gap(spark, site):
    _, _, _, x = site
    run = [(0, "s", ["flow"], 180, 199)]
    a = {k: v.copy() for k, v in x.items()}
    b = {k: v.copy() for k, v in x.items()}
    for v in VARS:
        b["s", v][180:200] = 1000.0
    b["s", "level"][200:] = -5.0  # nor anything after it
    out = []
    for y in (a, b):
        p = panel(spark, y)
        spans = impute.merged_spans(cases(spark, run), p)
        out.append(table(autoregress.impute_multivariate_past(spans, p, CTX, "value", VARS, 2, 1.0, SIDE), "pos"))
    pd.testing.assert_frame_equal(*out)
    assert len(out[0]) == 20


def test_solve_is_the_inverse(spark):
    rng = np.random.default_rng(3)
    for k in (1, 2, 7):
        a = rng.normal(size=(k, k))
        a, b = a @ a.T + np.eye(k), rng.normal(size=k)
        df = spark.createDataFrame([([[*map(float, r), float(y)] for r, y in zip(a, b)],)], "m array<array<double>>")
        np.testing.assert_allclose(df.select(F.expr(moments.solve_sql("m"))).first()[0], np.linalg.solve(a, b), atol=1e-9)


def test_forward_design_has_no_right_contexts(spark, site):
    p, filled, spans, x = site
    forward = moments.run_design(spans, filled, CTX, "zf", VARS, both_sides=False)
    assert {r.side for r in forward.sums.select("side").collect()} == {"L"}
    both = moments.run_design(spans, filled, CTX, "zf", VARS)
    keys = ("case_id", "variable", "pos")
    a, b = (table(d.step(1.0, SIDE, False)(start_of(spans)), *keys) for d in (forward, both))
    assert len(a) == len(b) and np.allclose(a["y_hat"], b["y_hat"], atol=1e-9)
    with pytest.raises(ValueError):
        forward.step(1.0, SIDE)


def test_context_sums_are_made_where_rows_meet_the_panel(spark, site):
    """Neither design rows nor sums of a context are shuffled: nothing is dealt by case, variable and side."""
    _, filled, spans, _ = site
    sums = moments.run_design(spans, filled, CTX, "zf", VARS).sums
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "side#" in line]


def test_runs_that_begin_together_share_a_past(spark, site):
    """Fits belong to starts of runs, not to cases and variables; a run far longer than a batch of cells is told to its end."""
    p, _, _, x = site
    spans = impute.merged_spans(cases(spark, [(i, "s", VARS, 150, 150 + 3 * i) for i in range(4)]), p)
    assert autoregress.past_vectors(spans, p, CTX, "value", VARS).count() == 1
    got = table(autoregress.impute_multivariate_past(spans, p, CTX, "value", VARS, 2, 1.0, SIDE), "case_id", "variable", "pos")
    assert got.groupby("case_id").size().to_dict() == {i: 3 * (3 * i + 1) for i in range(4)}
    far = spans.where("case_id = 3").withColumn("end_pos", F.lit(150 + 1500).cast("long"))
    long = table(autoregress.impute_multivariate_past(far, p, CTX, "value", VARS, 2, 1.0, SIDE), "variable", "pos")
    assert len(long) == 3 * 1501
    np.testing.assert_allclose(long[long.pos < 160].y_hat, got[got.case_id == 3].y_hat, atol=1e-9)
