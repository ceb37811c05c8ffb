"""Queries for imputers (G)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import autoregress, forecast, impute, references, tabular
from gapweave.operators.masking import centered_start, centered_window
from gapweave.plans import stages as st
from gapweave.plans.ctes import r, sql
from gapweave.plans.queries_prepare import rounded
from gapweave.plans.registry import query
from gapweave.plans.stages import Stages

CV = "case_id, site, variable, pos"


@query("G1_impute_linear", sql("lin3", f"SELECT site, variable, pos, {r('filled', 'filled')} FROM lin3"))
def _(s: Stages) -> DataFrame:
    return rounded(impute.impute_linear(s.panel3).select("site", "variable", "pos", "filled"))


@query("G1_case_linear", sql("p_linear", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM p_linear"))
def _(s: Stages) -> DataFrame:
    return rounded(impute.case_linear(s.spans))


@query(
    "G2_impute_linear_limited",
    sql("lin3", f"SELECT site, variable, pos, {r('CASE WHEN value IS NOT NULL OR pos - prev_pos <= 3 OR next_pos - pos <= 3 THEN filled END', 'filled')} FROM lin3"),
)
def _(s: Stages) -> DataFrame:
    return rounded(impute.impute_linear_limited(s.panel3, 3).select("site", "variable", "pos", "filled"))


@query(
    "G3_impute_seasonal",
    sql("seas3", f"""SELECT site, variable, pos, {r("CASE WHEN f IS NOT NULL THEN f WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv ELSE pv + (nv - pv) * (CAST(pos - pp AS DOUBLE) / (np - pp)) END", 'filled')} FROM (
SELECT *, last_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, last_value(f IGNORE NULLS) OVER a AS pv,
first_value(CASE WHEN f IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np, first_value(f IGNORE NULLS) OVER b AS nv FROM seas3
WINDOW a AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
b AS (PARTITION BY site, variable ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(impute.impute_seasonal(s.panel3, 8, 16).select("site", "variable", "pos", "filled"))


@query("G3_case_seasonal", sql("p_seasonal", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM p_seasonal"))
def _(s: Stages) -> DataFrame:
    return rounded(impute.case_seasonal(s.spans, s.scaled, st.SEASON, st.SEASON_CTX, "z"))


@query(
    "G4_align_references",
    sql("aligned roles6", f"SELECT a.site, a.variable, a.ref, ref_finite, {r('ref_finite / length', 'coverage')} FROM aligned a JOIN roles6 q ON q.site = a.site WHERE CAST(ref_finite AS DOUBLE) / length >= 0.6"),
)
def _(s: Stages) -> DataFrame:
    d = references.align_references(s.scaled, s.scaled, s.roles, "z", st.MIN_COVERAGE)
    return rounded(d.select("site", "variable", "ref", "ref_finite", "coverage"))


@query("G5_select_references", sql("refs", f"SELECT case_id, site, variable, ref, pairs, {r('abs_r', 'abs_r')}, rank FROM refs"))
def _(s: Stages) -> DataFrame:
    return rounded(references.select_references(s.spans, s.scaled, s.roles, "z", 3, st.MIN_COVERAGE, st.MIN_PAIRS))


@query("G6_impute_spatial_ridge", sql("p_ridge", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM p_ridge"))
def _(s: Stages) -> DataFrame:
    p = references.case_ridge(s.spans, s.references, s.scaled, "z", 1.0, st.MIN_PAIRS)
    return rounded(impute.final_fill(p, impute.case_linear(s.spans)))


# forecasts from the cleaned left context of 16 positions; season of 4 positions
@query("G7_forecast_seasonal_last", sql("fc_left", f"SELECT {CV}, {r('CASE WHEN n_ctx >= 4 THEN sl ELSE lv END', 'y_hat')} FROM fc_left"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.seasonal_last(4), 16, value="z"))


@query(
    "G7_forecast_rolling",
    sql("fc_roll", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM fc_roll WHERE pos BETWEEN start_pos AND end_pos"),
)
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.last_value, 16, "rolling", 4, "z"))


def _context_mean(ctx, h):
    """A forecaster a user would plug in: the mean of the context."""
    return [float(ctx.mean())] * h


@query("G7_forecast_user_function", sql("fc_left", f"SELECT {CV}, {r('cm', 'y_hat')} FROM fc_left"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.user_forecaster(_context_mean), 16, value="z"))


@query(
    "G8_repredict_hidden_only",
    sql("spans scaled nb6 scaler", f"""SELECT s.case_id, s.site, s.variable, p.pos, CASE WHEN p.pos BETWEEN s.run_start AND s.run_end THEN 'forecast' WHEN p.z IS NOT NULL THEN 'observed' ELSE 'base' END AS origin,
{r('''CASE WHEN p.pos BETWEEN s.run_start AND s.run_end THEN coalesce(s.left_val, s.right_val) WHEN p.z IS NOT NULL THEN p.z
ELSE (SELECT (coalesce(a.value, b.value) - c.lo) / (c.hi - c.lo) FROM nb6 q JOIN scaler c ON c.variable = q.variable LEFT JOIN nb6 a ON a.site = q.site AND a.variable = q.variable AND a.pos = q.prev_pos
LEFT JOIN nb6 b ON b.site = q.site AND b.variable = q.variable AND b.pos = q.next_pos WHERE q.site = s.site AND q.variable = s.variable AND q.pos = p.pos) END''', 'y_hat')}
FROM spans s JOIN scaled p ON p.site = s.site AND p.variable = s.variable AND p.pos BETWEEN s.run_start - 4 AND s.run_end + 4"""),
)
def _(s: Stages) -> DataFrame:
    base = forecast.natural_forecast(s.scaled, forecast.last_value, 16, "z")
    return rounded(forecast.repredict_hidden_only(s.spans, s.scaled, base, forecast.last_value, 16, 4, "z"))


@query("G9_bidirectional_init", sql("p_bidir", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM p_bidir"))
def _(s: Stages) -> DataFrame:
    p = forecast.bidirectional_init(s.spans, s.filled, forecast.seasonal_mean(st.SEASON), st.CONTEXT, st.MIN_SIDE, "zf")
    return rounded(impute.final_fill(p, impute.case_linear(s.spans)))


def _hidden(s: Stages, p: DataFrame) -> DataFrame:
    b = s.manifest.select("case_id", "start_pos", "end_pos")
    return p.join(b, "case_id").where("pos between start_pos and end_pos").select("case_id", "site", "variable", "pos", "y_hat")


def _one_pass(s: Stages, **design: bool) -> DataFrame:
    init, step = s.refinement(**design)
    return _hidden(s, step(init))


@query("G10_refine_sync", sql("pass2 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM pass2 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    return rounded(_hidden(s, forecast.refine_rounds(*s.refinement(), 2, written=True)[-1]))


@query(
    "G10_refine_depth_zero",
    sql("bidir_run", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM bidir_run WHERE pos BETWEEN start_pos AND end_pos"),
)
def _(s: Stages) -> DataFrame:
    """Depth 0 is the initial estimate itself."""
    return rounded(_hidden(s, forecast.refine_rounds(s.initial(), s.ridge_step(), 0)[-1]))


@query(
    "G11_forward_only",
    sql("sidefc p_linear", f"""SELECT l.case_id, l.site, l.variable, l.pos, {r('coalesce(f.y, l.y_hat)', 'y_hat')} FROM p_linear l LEFT JOIN (
SELECT case_id, variable, pos, CASE WHEN n_left >= 8 OR n_left > 0 THEN fw ELSE bw END AS y FROM sidefc) f ON f.case_id = l.case_id AND f.variable = l.variable AND f.pos = l.pos"""),
)
def _(s: Stages) -> DataFrame:
    p = forecast.bidirectional_init(s.spans, s.filled, forecast.seasonal_mean(st.SEASON), st.CONTEXT, st.MIN_SIDE, "zf", bidirectional=False)
    return rounded(impute.final_fill(p, impute.case_linear(s.spans)))


@query("G11_refine_without_references", sql("noref1 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM noref1 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    return rounded(_one_pass(s, use_refs=False))


@query("G11_refine_without_calendar", sql("nocal1 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM nocal1 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    return rounded(_one_pass(s, use_calendar=False))


@query("G12_refine_until_converged", sql("conv5 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM conv5 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    init, step = s.refinement(False, use_refs=False)
    cur, _ = forecast.converge(init, impute.case_linear(s.spans), step)
    return rounded(_hidden(s, cur))


@query("G13_impute_covariate_once", sql("once1 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM once1 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    p = forecast.covariate_once(*s.refinement(False), s.spans)
    return rounded(_hidden(s, p))


@query("G14_impute_multivariate_past", sql("var_fill", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM var_fill"))
def _(s: Stages) -> DataFrame:
    """Vector autoregression of lag 1; runs without a long enough past take the forward-only estimate, then the linear fill."""
    p = autoregress.impute_multivariate_past(s.spans, s.scaled, st.CONTEXT, "z", st.VARIABLES, 1, 1.0, st.MIN_SIDE)
    p = impute.final_fill(p, impute.final_fill(_hidden(s, s.initial(False)), impute.case_linear(s.spans)))
    return rounded(p)


@query("G14_multivariate_past_lags")
def _(s: Stages) -> DataFrame:
    """Three lags of every variable."""
    return rounded(autoregress.impute_multivariate_past(s.spans, s.scaled, st.CONTEXT, "z", st.VARIABLES, 3, 1.0, st.MIN_SIDE))


def _tabular(s: Stages, kind: str) -> DataFrame:
    lags = 6
    train = s.of_role(s.filled, "train").select("site", "variable", "pos", "zf")
    cut = train.groupBy("site").agg(F.floor(0.8 * (F.max("pos") + 1)).cast("bigint").alias("cut"))
    rows = tabular.lag_table(train, lags, st.SEASON, "zf").join(cut, "site").where("pos < cut")
    model = tabular.fit_tabular(rows, lags, "zf", kind)
    p = tabular.impute_tabular(s.spans, s.filled, model, lags, st.SEASON, "zf")
    return rounded(impute.final_fill(p, impute.case_linear(s.spans)))


@query("G15_impute_tabular_gbt")
def _(s: Stages) -> DataFrame:
    return _tabular(s, "gbt")


@query("G15_impute_tabular_forest")
def _(s: Stages) -> DataFrame:
    return _tabular(s, "forest")


@query("G16_seasonal_mean", sql("fc_left", f"SELECT {CV}, {r('sm', 'y_hat')} FROM fc_left"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.seasonal_mean(4), 16, value="z"))


@query("G16_last_value", sql("fc_left", f"SELECT {CV}, {r('lv', 'y_hat')} FROM fc_left"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.last_value, 16, value="z"))


@query("G16_drift", sql("fc_left", f"SELECT {CV}, {r('lv + CASE WHEN n_ctx > 1 THEN (lv - fv) / (n_ctx - 1) ELSE 0 END * (pos - run_start + 1)', 'y_hat')} FROM fc_left"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_forecast(s.spans, s.scaled, forecast.drift, 16, value="z"))


@query("G17_covariate_forecaster", sql("pass1 spans", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM (SELECT p.* FROM pass1 p JOIN spans s ON s.case_id = p.case_id AND s.variable = p.variable AND p.pos BETWEEN s.start_pos AND s.end_pos)"))
def _(s: Stages) -> DataFrame:
    """One pass of a user's forecaster, here the ridge as a NumPy function."""
    p = forecast.covariate_pass(forecast.covariate_cells(s.spans, s.filled, st.CONTEXT, "zf", s.reference_values()), s.initial(), st.VARIABLES, forecast.ridge_forecaster(1.0), st.MIN_SIDE)
    return rounded(_hidden(s, p))


@query(
    "G18_reference_features",
    sql("manifest span6 scaled refs refser", f"""WITH w AS (SELECT m.*, greatest(0, least((start_pos + end_pos + 1) // 2 - 16, n - 32)) AS ws FROM manifest m JOIN span6 USING (site)),
c AS (SELECT w.case_id, w.site, p.pos, p.variable, p.ts, CASE WHEN p.z IS NOT NULL AND NOT (list_contains(string_split(w.vars_key, ','), p.variable) AND p.pos BETWEEN w.start_pos AND w.end_pos) THEN p.z ELSE 0 END AS x
FROM w JOIN scaled p ON p.site = w.site AND p.pos BETWEEN w.ws AND w.ws + 31)
SELECT c.case_id, c.site, c.pos, """
        + ", ".join(r(f"max(c.x) FILTER (WHERE c.variable = '{v}')", f"x_{v}") for v in st.VARIABLES)
        + ", "
        + ", ".join(
            [r("sin(2 * pi() * hour(min(c.ts)) / 24)", "hour_sin"), r("cos(2 * pi() * hour(min(c.ts)) / 24)", "hour_cos"),
             r("sin(2 * pi() * dayofyear(min(c.ts)) / 365.25)", "doy_sin"), r("cos(2 * pi() * dayofyear(min(c.ts)) / 365.25)", "doy_cos")]
        )
        + ", "
        + ", ".join(r(f"coalesce(max(q.x) FILTER (WHERE c.variable = '{v}' AND f.rank = {k}), 0)", f"ref{k}_{v}") for v in st.VARIABLES for k in (1, 2, 3))
        + """, count(q.x) AS refs_present FROM c LEFT JOIN refs f ON f.case_id = c.case_id AND f.variable = c.variable
LEFT JOIN refser q ON q.site = c.site AND q.variable = c.variable AND q.ref = f.ref AND q.pos = c.pos GROUP BY 1, 2, 3""").replace("WITH w AS", "SELECT * FROM (WITH w AS", 1) + ")",
)
def _(s: Stages) -> DataFrame:
    win = centered_window(s.manifest, s.scaled, 32, "z")
    reach = s.spans.withColumn("_lo", centered_start(32)).withColumn("_hi", F.col("_lo") + 31)
    values = references.reference_windows(reach, s.references, s.scaled, "z", "_lo", "_hi")
    return rounded(forecast.reference_features(win, s.scaled, values, st.VARIABLES))


@query("G19_final_fill", sql("p_ridge", f"SELECT {CV}, {r('y_hat', 'y_hat')} FROM p_ridge"))
def _(s: Stages) -> DataFrame:
    """A partial prediction (the ridge skips cases with too few pairs): what it leaves takes the linear fill."""
    partial = references.case_ridge(s.spans, s.references, s.scaled, "z", 1.0, st.MIN_PAIRS)
    return rounded(impute.final_fill(partial, impute.case_linear(s.spans)))


@query("G20_windowed_overlap", sql("wo_fill", f"SELECT site, variable, pos, {r('filled', 'filled')} FROM wo_fill"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_windowed_overlap(s.panel3, 32, 8, forecast.phase_mean_window(32, 8)).select("site", "variable", "pos", "filled"))


def _row_means(contexts, horizon):
    """A window model a user would plug in: the mean of each context."""
    mean = np.where(np.isnan(contexts), 0.0, contexts).sum(axis=1) / np.maximum((~np.isnan(contexts)).sum(axis=1), 1)
    return np.repeat(mean[:, None], horizon, axis=1)


@query("G20_windowed_overlap_user_function", sql("wu_fill", f"SELECT site, variable, pos, {r('filled', 'filled')} FROM wu_fill"))
def _(s: Stages) -> DataFrame:
    return rounded(forecast.impute_windowed_overlap(s.panel3, 32, 8, forecast.user_window(_row_means, 32)).select("site", "variable", "pos", "filled"))

