"""Contexts, forecasters, bidirectional fusion and synchronous refinement on one site of four uneven series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gapweave.operators import forecast, impute, tabular
from helpers import cases, panel, table

N, A, B, CTX, SIDE = 432, 181, 229, 80, 40
VARS = ["flow", "level", "power", "temp"]


def middle_of_context():
    """A plug-in forecaster: the context's median, held over the horizon."""
    return forecast.user_forecaster(lambda past, steps: [float(np.median(past))] * steps)


@pytest.fixture(scope="module")
def site(spark):
    rng = np.random.default_rng(77)
    hours = np.arange(N)
    daily = np.where(hours % 24 < 9, 1.0, 3.0)
    x = {("s", v): np.round(10 * k + daily * (k + 1) + np.cumsum(rng.normal(0, 0.3, N)), 4) for k, v in enumerate(VARS)}
    x["s", "level"][[150, 151, 152, 300]] = np.nan
    p = panel(spark, x)
    spans = impute.merged_spans(cases(spark, [(0, "s", VARS, A, B)]), p)
    return p, impute.impute_linear(p, "value", "zf"), spans.cache(), x


def test_user_forecaster_sees_the_left_context(site):
    p, _, spans, x = site
    got = table(forecast.impute_forecast(spans, p, middle_of_context(), CTX), "variable", "pos")
    for v in VARS:
        ctx = pd.Series(x[("s", v)][A - CTX : A]).ffill().bfill()
        np.testing.assert_allclose(got[got.variable == v].y_hat, ctx.median())


def test_leading_run_uses_the_reversed_right_context(spark):
    p = panel(spark, {("s", "v"): [None, None, None, 5.0, 6.0, 7.0, 8.0]})
    sp = impute.merged_spans(cases(spark, [(0, "s", ["v"], 0, 2)]), p)
    got = table(forecast.impute_forecast(sp, p, forecast.drift, 4), "pos")
    np.testing.assert_allclose(got.y_hat, [2.0, 3.0, 4.0])


def test_short_output_is_padded_and_failures_fall_back(spark, site):
    p, _, spans, _ = site
    short = forecast.user_forecaster(lambda c, h: c[-2:])
    got = table(forecast.impute_forecast(spans, p, short, CTX), "variable", "pos")
    assert got.groupby("variable").y_hat.apply(lambda s: s.iloc[1:].nunique() == 1).all()

    def boom(c, h):
        raise RuntimeError("no model")

    lin = impute.case_linear(spans)
    with pytest.raises(Exception, match="no model"):
        forecast.impute_forecast(spans, p, forecast.user_forecaster(boom, "raise"), CTX).collect()
    d = impute.final_fill(forecast.impute_forecast(spans, p, forecast.user_forecaster(boom), CTX), lin)
    assert d.join(lin.withColumnRenamed("y_hat", "l"), ["case_id", "site", "variable", "pos"]).where("abs(y_hat - l) > 1e-12").count() == 0


def test_rolling_matches_a_loop(site):
    p, _, spans, x = site
    fc = forecast.seasonal_mean(7)
    got = table(forecast.impute_forecast(spans, p, fc, 30, "rolling", 10), "variable", "pos")

    def one(c, h):
        return [np.mean([c[j] for j in range(len(c)) if (j - len(c) - i) % 7 == 0]) for i in range(h)]

    c, out = list(x[("s", "flow")][A - 30 : A]), []
    while len(out) < B - A + 1:
        y = one(c, 10)
        out += y
        c = (c + y)[-30:]
    np.testing.assert_allclose(got[got.variable == "flow"].y_hat, out[: B - A + 1])


def test_bidirectional_weights(site):
    _, filled, spans, x = site
    got = table(forecast.bidirectional_init(spans, filled, middle_of_context(), CTX, SIDE, "zf"), "variable", "pos")
    w = np.linspace(1, 0, B - A + 1)
    for v in VARS:
        f = pd.Series(x[("s", v)]).interpolate()
        np.testing.assert_allclose(got[got.variable == v].y_hat, w * f[A - CTX : A].median() + (1 - w) * f[B + 1 : B + 1 + CTX].median())


def test_single_point_and_one_sided_runs(spark):
    p = panel(spark, {("s", "v"): [1.0] * 10 + [9.0] + [3.0] * 10})
    run = lambda a, b, side: table(
        forecast.bidirectional_init(impute.merged_spans(cases(spark, [(0, "s", ["v"], a, b)]), p), p, forecast.last_value, 8, side, "value"), "pos"
    ).y_hat.tolist()
    assert run(10, 10, 4) == [2.0]
    assert run(2, 3, 4) == [1.0, 1.0]
    assert run(1, 2, 50) == [1.0, 1.0]


def numpy_pass(est, fixed, x_names, alpha=1.0):
    """One synchronous pass written as a plain loop."""
    fc = forecast.ridge_forecaster(alpha)
    out = est.copy()
    n = B - A + 1
    w = np.linspace(1, 0, n)
    for t in range(len(x_names)):
        x = np.hstack([np.delete(est, t, axis=1), fixed])
        left, gap, right = slice(A - CTX, A), slice(A, B + 1), slice(B + 1, B + 1 + CTX)
        f = fc(est[left, t], x[left], x[gap])
        b = fc(est[right, t][::-1], x[right][::-1], x[gap][::-1])[::-1]
        out[gap, t] = w * f + (1 - w) * b
    return out


def test_refinement_reads_one_snapshot_per_pass(spark, site):
    _, filled, spans, x = site
    init = forecast.bidirectional_init(spans, filled, forecast.seasonal_mean(24), CTX, SIDE, "zf", whole_run=True).drop("start_pos", "end_pos")
    cells = forecast.covariate_cells(spans, filled, CTX, "zf")
    got = table(forecast.refine_sync(init, cells, VARS, forecast.ridge_forecaster(), 2, SIDE), "variable", "pos")
    est = np.column_stack([pd.Series(x[("s", v)]).interpolate() for v in VARS])
    est[A : B + 1] = table(init, "variable", "pos").y_hat.to_numpy().reshape(len(VARS), -1).T
    hour, doy = np.arange(N) % 24, np.arange(N) // 24 + 1
    fixed = np.column_stack([np.sin(2 * np.pi * hour / 24), np.cos(2 * np.pi * hour / 24), np.sin(2 * np.pi * doy / 365.25), np.cos(2 * np.pi * doy / 365.25)])
    for _ in range(2):
        est = numpy_pass(est, fixed, VARS)
    for i, v in enumerate(VARS):
        np.testing.assert_allclose(got[got.variable == v].y_hat, est[A : B + 1, i], atol=1e-7)


def test_convergence_stops_and_freezes_variables(spark, site):
    _, filled, spans, _ = site
    init = forecast.bidirectional_init(spans, filled, forecast.seasonal_mean(24), CTX, SIDE, "zf", False, whole_run=True).drop("start_pos", "end_pos")
    cells = forecast.covariate_cells(spans, filled, CTX, "zf")
    cur, log = forecast.refine_until_converged(init, impute.case_linear(spans), cells, VARS, forecast.ridge_forecaster(), SIDE, max_passes=3)
    rounds = log.orderBy("round").collect()
    assert 1 <= len(rounds) <= 3 and rounds[0].active_variables == len(VARS)
    assert cur.groupBy("variable").count().where(F.col("count") == B - A + 1).count() == len(VARS)


def test_run_at_position_zero_keeps_the_univariate_fill(spark):
    t = np.arange(150)
    p = panel(spark, {("s", "a"): np.sin(t / 5), ("s", "b"): np.cos(t / 5)})
    sp = impute.merged_spans(cases(spark, [(0, "s", ["a"], 0, 5), (1, "s", ["a"], 100, 105)]), p)
    filled = impute.impute_linear(p, "value", "zf")
    init = impute.case_linear(sp)
    cells = forecast.covariate_cells(sp, filled, 60, "zf")
    d = forecast.impute_covariate_once(init, cells, sp, ["a", "b"], forecast.ridge_forecaster(), 48).join(init.withColumnRenamed("y_hat", "i"), ["case_id", "site", "variable", "pos"])
    diff = {r.case_id: r.m for r in d.groupBy("case_id").agg(F.max(F.abs(F.col("y_hat") - F.col("i"))).alias("m")).collect()}
    assert diff[0] == 0 and diff[1] > 1e-3


def test_convergence_of_a_case_does_not_depend_on_others(spark, site):
    p, filled, _, _ = site
    both = impute.merged_spans(cases(spark, [(0, "s", VARS, 100, 120), (1, "s", ["flow"], 250, 330)]), p)

    def run(spans):
        init = forecast.bidirectional_init(spans, filled, forecast.seasonal_mean(24), CTX, SIDE, "zf", False, whole_run=True).drop("start_pos", "end_pos")
        cells = forecast.covariate_cells(spans, filled, CTX, "zf")
        cur, log = forecast.refine_until_converged(init, impute.case_linear(spans), cells, VARS, forecast.ridge_forecaster(), SIDE, tol=0.02, max_passes=4)
        return table(cur, "case_id", "variable", "pos"), table(log, "case_id", "round")

    together = run(both)
    for c in (0, 1):
        alone = run(both.where(f"case_id = {c}"))
        for a, b in zip(alone, together):
            pd.testing.assert_frame_equal(a, b[b.case_id == c].reset_index(drop=True), check_exact=False, rtol=1e-9)


def test_convergence_of_nothing(spark, site):
    _, filled, spans, _ = site
    none = spans.where("false")
    init = forecast.bidirectional_init(none, filled, forecast.seasonal_mean(24), CTX, SIDE, "zf", False, whole_run=True).drop("start_pos", "end_pos")
    cur, log = forecast.refine_until_converged(init, impute.case_linear(none), forecast.covariate_cells(none, filled, CTX, "zf"), VARS, forecast.ridge_forecaster(), SIDE)
    assert cur.count() == 0 and log.count() == 0


def test_runs_longer_than_a_thousand_steps_are_forecast(spark):
    t = np.arange(1500)
    p = panel(spark, {("s", "a"): np.where((t >= 100) & (t < 1200), np.nan, t % 7 + 1.0), ("s", "b"): t % 5 + 0.5})
    spans = impute.merged_spans(cases(spark, [(0, "s", ["a"], 100, 1199)]), p)
    filled = impute.impute_linear(p, "value", "zf")
    got = table(forecast.bidirectional_init(spans, filled, forecast.seasonal_mean(7), 98, 48, "zf"), "pos")
    assert len(got) == 1100 and got.y_hat.notna().all()
    cells = forecast.covariate_cells(spans, filled, 60, "zf")
    assert table(forecast.covariate_pass(cells, got.pipe(spark.createDataFrame), ["a", "b"], forecast.ridge_forecaster(), 48), "pos").y_hat.notna().sum() == 1100


def test_tree_forecasts_roll_to_the_end_of_a_run(spark):
    """70 steps against the model applied to its own output row by row; a short context is padded."""
    from pyspark.ml.linalg import Vectors

    t = np.arange(300)
    x = np.round(5 + 2 * np.sin(t / 5) + t / 100, 4)
    p = panel(spark, {("s", "v"): x, ("s", "w"): x[::-1].copy()})
    lags, season = 4, 24
    filled = impute.impute_linear(p, "value", "zf")
    model = tabular.fit_tabular(tabular.lag_table(filled, lags, season, "zf"), lags, "zf", rounds=5)
    spans = impute.merged_spans(cases(spark, [(0, "s", ["v"], 150, 219), (1, "s", ["v"], 2, 9), (2, "s", ["w"], 0, 4)]), p)
    got = table(tabular.impute_tabular(spans, filled, model, lags, season, "zf", steps=16), "case_id", "pos")
    for case, series, a, b, hist in ((0, x, 150, 219, list(x[146:150])), (1, x, 2, 9, [x[0], x[0], x[0], x[1]]), (2, x[::-1], 0, 4, [x[::-1][5]] * 4)):
        want = []
        for k in range(b - a + 1):
            y = model.predict(Vectors.dense([*hist[::-1], float((a + k) % season)]))
            want.append(y)
            hist = [*hist[1:], y]
        np.testing.assert_allclose(got[got.case_id == case].y_hat, want, rtol=1e-9)


@pytest.mark.parametrize("name,fc", [("last", forecast.last_value), ("drift", forecast.drift), ("seasonal_last", forecast.seasonal_last(7)), ("seasonal_mean", forecast.seasonal_mean(7))])
def test_closed_forms_equal_their_arrays(spark, site, name, fc):
    """Both ways, contexts shorter than a season and runs at the ends included."""
    p, filled, _, _ = site
    spans = impute.merged_spans(cases(spark, [(0, "s", VARS, A, B), (1, "s", ["flow"], 0, 11), (2, "s", ["temp"], 5, 30), (3, "s", ["power"], 420, N - 1)]), p)
    plain = lambda ctx, h: fc.arrays(ctx, h)
    keys = ("case_id", "variable", "pos")
    for a, b in (
        (forecast.impute_forecast(spans, p, fc, CTX), forecast.impute_forecast(spans, p, plain, CTX)),
        (forecast.bidirectional_init(spans, filled, fc, CTX, SIDE, "zf"), forecast.bidirectional_init(spans, filled, plain, CTX, SIDE, "zf")),
        (forecast.bidirectional_init(spans, filled, fc, CTX, SIDE, "zf", False, whole_run=True), forecast.bidirectional_init(spans, filled, plain, CTX, SIDE, "zf", False, whole_run=True)),
    ):
        pd.testing.assert_frame_equal(table(a, *keys), table(b, *keys), check_exact=False, rtol=1e-12)


def test_a_long_empty_run_needs_no_long_array(spark):
    n = 300_000
    p = spark.range(n).selectExpr("'s' AS site", "'v' AS variable", "id AS pos", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id) AS ts", f"CASE WHEN id < 48 OR id >= {n} - 48 THEN id % 24 + 0D END AS value")
    spans = impute.merged_spans(cases(spark, [(0, "s", ["v"], 1000, 1009)]), p)
    d = forecast.bidirectional_init(spans, p, forecast.seasonal_mean(24), 48, 24, "value", whole_run=True)
    got = d.agg(F.count("y_hat"), F.max(F.abs(F.col("y_hat") - F.col("pos") % 24))).first()
    assert got[0] == n - 96 and got[1] < 1e-9


def test_window_models_share_one_hook(spark):
    rng = np.random.default_rng(2)
    x = {("s", v): np.where(rng.random(97) < 0.3, np.nan, rng.normal(size=97)) for v in ("a", "b")}
    p = panel(spark, x)
    sizes = []

    def phase_means(contexts, horizon):
        sizes.append(contexts.shape)
        out = np.full((len(contexts), horizon), np.nan)
        for r, c in enumerate(contexts):
            for i in range(horizon):
                same = c[(np.arange(horizon) - i) % 4 == 0]
                out[r, i] = np.nan if np.isnan(same).all() else np.nanmean(same)
        return out

    built_in = table(forecast.impute_windowed_overlap(p, 16, 4, forecast.phase_mean_window(16, 4)), "variable", "pos")
    own = table(forecast.impute_windowed_overlap(p, 16, 4, forecast.user_window(phase_means, 16)), "variable", "pos")
    pd.testing.assert_frame_equal(built_in, own, check_exact=False, rtol=1e-12)
    assert built_in.filled.notna().all()
    with pytest.raises(Exception, match="shape"):
        forecast.impute_windowed_overlap(p, 16, 4, forecast.user_window(lambda c, h: c[:, :3], 16)).collect()
