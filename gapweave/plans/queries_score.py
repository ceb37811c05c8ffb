"""Queries for scoring, aggregation and statistics (H)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import masking, metrics, quality, references, report, stats
from gapweave.plans import stages as st
from gapweave.plans.ctes import METRICS, POLY, SCORE_COLS, boot, holm_sql, paired, r, sql
from gapweave.plans.queries_prepare import _SEASON, _TOD, rounded
from gapweave.plans.registry import query
from gapweave.plans.stages import Stages

PAIRS = (("bidir", "linear"), ("bidir", "seasonal"), ("bidir", "ridge"), ("ridge", "linear"))
SUBSET = ("bidir", "ridge", "seasonal")


def rr(*cols: str) -> str:
    return ", ".join(r(c, c) for c in cols)


def pairs(s: Stages) -> DataFrame:
    return stats.pairs_frame(s.spark, PAIRS)


def sum_sql(src: str, keys: str, metric: str = "NMAE") -> str:
    """Site table -> mean, sd, bootstrap interval, n_sites."""
    return f"""SELECT * FROM (SELECT {keys}, avg({metric}) AS mean, stddev_samp({metric}) AS sd, count(*) AS n_sites FROM {src} GROUP BY {keys})
JOIN (SELECT {keys}, quantile_cont({metric}, 0.025) AS low, quantile_cont({metric}, 0.975) AS high FROM ({boot(src, keys, metric)}) GROUP BY {keys}) USING ({keys})"""


def site_sql(keys: str, metric: str = "NMAE", src: str = "scores", where: str = "true") -> str:
    return f"SELECT {keys}, sum({metric} * n_eval) / sum(n_eval) AS {metric} FROM {src} WHERE {metric} IS NOT NULL AND {where} GROUP BY {keys}"


@query("flagship_nmae", sql("site_s", f"SELECT model, {r('avg(NMAE)', 'mean_nmae')}, count(*) AS n_sites FROM site_s GROUP BY 1"))
def _(s: Stages) -> DataFrame:
    """Events -> panel -> hidden intervals -> four imputers -> site-equal NMAE."""
    d = stats.site_scores(s.scores).groupBy("model").agg(F.avg("NMAE").alias("mean_nmae"), F.count(F.lit(1)).alias("n_sites"))
    return rounded(d)


@query("H1_case_metrics", sql("scores", "SELECT case_id, model, site, variable, " + rr("MSE", "MAE", "RMSE", "nRMSE", "R2") + ", n_eval FROM scores"))
def _(s: Stages) -> DataFrame:
    return metrics.case_scores(s.cells, s.ranges).select("case_id", "model", "site", "variable", "MSE", "MAE", "RMSE", "nRMSE", "R2", "n_eval")


@query("H2_nmae", sql("scores", "SELECT case_id, model, variable, " + rr("NMAE") + " FROM scores"))
def _(s: Stages) -> DataFrame:
    return rounded(s.scores.select("case_id", "model", "variable", "NMAE"))


@query(
    "H3_stratified_metrics",
    sql("cellsx ranges", f"""SELECT model, case_id, site, variable, group_type, group_value, {SCORE_COLS} FROM (
SELECT model, case_id, site, variable, group_type, group_value, {METRICS} FROM (
SELECT *, 'all' AS group_type, 'all' AS group_value FROM cellsx UNION ALL SELECT *, 'season', {_SEASON.format('ts')} FROM cellsx
UNION ALL SELECT *, 'time_of_day', {_TOD.format('ts')} FROM cellsx UNION ALL SELECT *, 'season_tod', {_SEASON.format('ts')} || '_' || {_TOD.format('ts')} FROM cellsx) GROUP BY ALL) JOIN ranges USING (site, variable)"""),
)
def _(s: Stages) -> DataFrame:
    return metrics.stratified_scores(s.cells, s.ranges)


@query("H4_norm_ranges", sql("norms", "SELECT site, variable, n_observations, " + rr("full_range", "prefix_range", "p01", "p99", "robust_range") + f", {r('CASE WHEN robust_range > 0 THEN full_range / robust_range END', 'ratio')}, common_valid FROM norms"))
def _(s: Stages) -> DataFrame:
    return rounded(metrics.norm_ranges(s.panel6))


@query("H5_site_scores", sql("scores", "SELECT model, site, variable, " + rr("NMAE") + f" FROM ({site_sql('model, site, variable')})"))
def _(s: Stages) -> DataFrame:
    return rounded(stats.site_scores(s.scores, "NMAE", ["variable"]))


_SUMCOLS = rr("mean", "sd", "low", "high") + ", n_sites"


@query("H6_summary", sql("site_s", f"SELECT model, {_SUMCOLS} FROM ({sum_sql('site_s', 'model')})"))
def _(s: Stages) -> DataFrame:
    return rounded(stats.summary(s.scores))


@query("H6_summary_by_scenario_gap", sql("scores", f", q AS ({site_sql('model, site, scenario, gap_len')}) SELECT model, scenario, gap_len, {_SUMCOLS} FROM ({sum_sql('q', 'model, scenario, gap_len')})"))
def _(s: Stages) -> DataFrame:
    return rounded(stats.summary(s.scores, "NMAE", ["scenario", "gap_len"]))


_PAIRCOLS = rr("reduction", "low", "high", "p", "holm_p") + ", n_sites, sites_improved, p_method"


def _with_method(xy: str, keys: str) -> str:
    """The test behind each p: exact up to 50 differences without ties."""
    d = "round(abs(x - y), 12)) FILTER (WHERE x <> y)"
    return f""" JOIN (SELECT {keys}, CASE WHEN count({d} = 0 THEN 'none' WHEN count({d} <= 50 AND count(DISTINCT {d} = count({d} THEN 'exact' ELSE 'approx' END AS p_method FROM {xy} GROUP BY {keys}) USING ({keys})"""


@query("H7_paired_compare", sql("xy null_w", f"SELECT model, reference, {_PAIRCOLS} FROM ({holm_sql(paired('xy', 'model, reference'))}){_with_method('xy', 'model, reference')}"))
def _(s: Stages) -> DataFrame:
    d = stats.paired_compare(stats.site_scores(s.scores), pairs(s))
    return rounded(d.drop("mean_model", "mean_reference"))


@query(
    "H8_cell_level_compare",
    sql("cellsx pairs", f""", e AS (SELECT model, case_id, variable, pos, abs(pred - value) AS err FROM cellsx),
x AS (SELECT p.model, p.reference, a.err - b.err AS d FROM pairs p JOIN e a ON a.model = p.model JOIN e b ON b.model = p.reference AND b.case_id = a.case_id AND b.variable = a.variable AND b.pos = a.pos),
k AS (SELECT model, reference, round(abs(d), 12) AS a, count(*) AS c, count(*) FILTER (WHERE d > 0) AS pc FROM x WHERE d <> 0 GROUP BY 1, 2, 3),
m AS (SELECT *, sum(c) OVER (PARTITION BY model, reference ORDER BY a) - (c - 1) / 2 AS rk FROM k),
w AS (SELECT model, reference, CAST(sum(c) AS DOUBLE) AS n, sum(rk * pc) AS wp, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM m GROUP BY 1, 2),
z AS (SELECT model, reference, -(least(wp, n * (n + 1) / 2 - wp) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS a FROM w),
p AS (SELECT model, reference, least(1.0, 2 * exp(-a * a / 2) * 0.3989422804014327 * {POLY}) AS p FROM (SELECT *, 1 / (1 + 0.2316419 * a) AS t FROM z))
SELECT model, reference, n, {rr('mean_difference', 'win_rate', 'p')}, 'approx' AS p_method FROM (SELECT model, reference, count(*) AS n, avg(d) AS mean_difference, avg(CASE WHEN d < 0 THEN 1.0::DOUBLE ELSE 0 END) AS win_rate FROM x GROUP BY 1, 2) JOIN p USING (model, reference)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(stats.cell_level_compare(s.cells, pairs(s)))


@query(
    "H9_duration_weights",
    sql("scores", f""", q AS (SELECT * FROM scores WHERE model = 'linear'), t AS (SELECT site, sum(n_eval) AS t FROM q GROUP BY 1)
SELECT scenario, gap_len, count(*) AS variable_cases, count(DISTINCT case_id) AS mask_cases, count(DISTINCT site) AS sites, CAST(sum(n_eval) AS BIGINT) AS evaluated_steps,
{r('sum(n_eval / t / (SELECT count(*) FROM t))', 'overall_weight')} FROM q JOIN t USING (site) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.duration_weights(s.scores, "linear"))


@query("H10_equal_case", sql("scores", f"SELECT model, {r('avg(v)', 'mean')}, {r('stddev_samp(v)', 'sd')}, count(*) AS n_sites FROM (SELECT model, site, avg(v) AS v FROM (SELECT model, site, case_id, avg(NMAE) AS v FROM scores GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1"))
def _(s: Stages) -> DataFrame:
    return rounded(report.equal_case(s.scores))


_MEANS = "SELECT model, avg(NMAE) AS mean FROM site_s GROUP BY 1"


@query(
    "H11_rank_models",
    sql("site_s", f"""SELECT model, {r('mean', 'mean')}, rank() OVER (ORDER BY mean) AS rank_all, model <> 'linear' AS in_subset,
CASE WHEN model <> 'linear' THEN rank() OVER (PARTITION BY model <> 'linear' ORDER BY mean) END AS rank_subset FROM ({_MEANS})"""),
)
def _(s: Stages) -> DataFrame:
    m = stats.site_scores(s.scores).groupBy("model").agg(F.avg("NMAE").alias("mean"))
    return rounded(report.rank_models(m, SUBSET))


@query(
    "H11_rank_changes",
    sql("scores", f""", k AS (SELECT model, site || '|' || variable AS setting, rank() OVER (PARTITION BY site, variable ORDER BY NMAE) AS rk FROM ({site_sql('model, site, variable')}))
SELECT a.model, a.setting, b.rk AS base_rank, a.rk AS rank FROM k a JOIN k b ON a.model = b.model AND b.setting = 's4|click' WHERE a.setting <> 's4|click' AND a.rk <> b.rk"""),
)
def _(s: Stages) -> DataFrame:
    m = stats.site_scores(s.scores, "NMAE", ["variable"]).withColumn("setting", F.concat_ws("|", "site", "variable")).withColumnRenamed("NMAE", "mean")
    return report.rank_changes(report.rank_models(m, SUBSET, ["setting"]), "setting", "s4|click")


@query(
    "H12_family_winner",
    sql("site_s", f"""SELECT family, arg_min(model, mean) AS winner, {r('min(mean)', 'best')} FROM (SELECT *, CASE WHEN model IN ('linear', 'seasonal') THEN 'single_site' ELSE 'informed' END AS family FROM ({_MEANS})) GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    m = stats.site_scores(s.scores).groupBy("model").agg(F.avg("NMAE").alias("mean"))
    return rounded(report.family_winner(m, {"single_site": ["linear", "seasonal"], "informed": ["ridge", "bidir"]}))


@query("H12_column_best", sql("scores", f"SELECT model, variable, {r('m', 'mean')}, rank() OVER (PARTITION BY variable ORDER BY m) = 1 AS is_best FROM (SELECT model, variable, avg(NMAE) AS m FROM ({site_sql('model, site, variable')}) GROUP BY 1, 2)"))
def _(s: Stages) -> DataFrame:
    m = stats.site_scores(s.scores, "NMAE", ["variable"]).groupBy("model", "variable").agg(F.avg("NMAE").alias("mean"))
    return rounded(report.column_best(m, "variable", "mean"))


@query("H13_select_context", sql("mbest", f"SELECT model, context, {rr('mean', 'sd')}, n_sites FROM mbest"))
def _(s: Stages) -> DataFrame:
    return rounded(report.select_setting(s.context_scores, "context")[1])


_DEPTH = "SELECT round AS refinements, avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n_sites FROM (SELECT round, site, sum(NMAE * n_eval) / sum(n_eval) AS v FROM rounds GROUP BY 1, 2) GROUP BY 1"


@query("H14_select_depth", sql("rounds", f"SELECT refinements, {rr('mean', 'sd')}, n_sites FROM ({_DEPTH}) ORDER BY round(mean, 12), refinements LIMIT 1"))
def _(s: Stages) -> DataFrame:
    d = s.round_scores.withColumnRenamed("round", "refinements")
    return rounded(report.select_setting(d, "refinements", by=())[1])


@query("H14_refinement_depths", sql("rounds", f"""SELECT refinements, {r('mean', 'mean')}, n_sites, refinements = (SELECT refinements FROM d ORDER BY round(mean, 12), refinements LIMIT 1) AS is_minimum,
{r('100 * (mean / (SELECT mean FROM d ORDER BY round(mean, 12), refinements LIMIT 1) - 1)', 'relative_percent')} FROM d""".replace("SELECT refinements,", f", d AS ({_DEPTH}) SELECT refinements,", 1)))
def _(s: Stages) -> DataFrame:
    """Scores of refinement passes 0-2, the chosen depth flagged."""
    return rounded(report.context_curve(s.round_scores.withColumnRenamed("round", "refinements"), "refinements", by=()))


@query("H15_context_curve", sql("msum mbest", f"SELECT s.model, s.context, {r('s.mean', 'mean')}, s.n_sites, s.context = b.context AS is_minimum, {r('100 * (s.mean / b.mean - 1)', 'relative_percent')} FROM msum s JOIN mbest b ON b.model = s.model"))
def _(s: Stages) -> DataFrame:
    return rounded(report.context_curve(s.context_scores, "context"))


@query(
    "H16_round_drift",
    sql("rounds", f""", d AS (SELECT a.round, concat_ws('|', a.site, a.case_id, a.variable) AS unit, 100 * (a.mae / nullif(z.mae, 0) - 1) AS drift FROM rounds a
JOIN rounds z ON z.round = 0 AND z.case_id = a.case_id AND z.variable = a.variable WHERE z.mae <> 0),
g AS (SELECT round, avg(drift) AS mean_drift, count(*) AS n_units FROM d GROUP BY 1),
c AS (SELECT round, quantile_cont(drift, 0.025) AS low, quantile_cont(drift, 0.975) AS high FROM ({boot('d', 'round', 'drift', 200, 'unit')}) GROUP BY 1)
SELECT round, {rr('mean_drift', 'low', 'high')}, n_units, round = (SELECT round FROM g ORDER BY round(mean_drift, 9), round LIMIT 1) AS is_best FROM g JOIN c USING (round)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.round_drift(s.round_scores, ["site", "case_id", "variable"], "mae", 200))


@query(
    "H17_ablation_steps",
    sql("rounds", f"SELECT scope, {r('b', 'before')}, {r('a', 'after')}, {r('100 * (1 - a / b)', 'drop_percent')} FROM (SELECT scope, avg(mae) FILTER (WHERE round = 0) AS b, avg(mae) FILTER (WHERE round = 1) AS a FROM (SELECT *, unnest(['ALL', variable]) AS scope FROM rounds) GROUP BY 1)"),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.ablation_steps(s.round_scores))


def _final_cols(col: str, values, cast: str = "") -> str:
    return ", ".join(r(f"(SELECT avg(v) FROM (SELECT site, sum(NMAE * n_eval) / sum(n_eval) AS v FROM scores q WHERE q.model = m.model AND q.{col} = {cast}'{v}' GROUP BY 1))", f"{col}_{v}") for v in values)


@query(
    "H18_final_table",
    sql("scores site_s", f"""SELECT model, {r('mean', 'mean')}, {r('sd', 'sd')}, {_final_cols('variable', st.VARIABLES)}, {_final_cols('scenario', 'ABC')}, {_final_cols('gap_len', st.GAPS)}
FROM (SELECT model, avg(NMAE) AS mean, stddev_samp(NMAE) AS sd FROM site_s GROUP BY 1) m"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.final_table(s.scores, st.VARIABLES, ("A", "B", "C"), st.GAPS))


@query(
    "H19_residual_strata",
    sql("cellsx panel6 roles6 cut6 ranges", f""", ch AS (SELECT site, variable, pos, abs(value - lag(value) OVER (PARTITION BY site, variable ORDER BY pos)) AS delta FROM panel6),
th AS (SELECT variable, quantile_cont(delta, 0.75) AS threshold FROM ch JOIN roles6 USING (site) JOIN cut6 USING (site) WHERE role = 'train' AND pos < cut GROUP BY 1),
d AS (SELECT c.*, ch.delta, th.threshold FROM cellsx c LEFT JOIN ch USING (site, variable, pos) JOIN th USING (variable)),
x AS (SELECT *, 'change_low' AS stratum FROM d WHERE delta <= threshold UNION ALL SELECT *, 'change_high' FROM d WHERE delta > threshold
UNION ALL SELECT *, 'level_zero' FROM d WHERE variable = 'click' AND value <= 20 UNION ALL SELECT *, 'level_positive' FROM d WHERE variable = 'click' AND value > 20)
SELECT model, case_id, site, variable, stratum, n_eval, {r('m', 'MAE')}, {r('m / full_range', 'NMAE')} FROM (SELECT model, case_id, site, variable, stratum, count(*) AS n_eval, avg(abs(pred - value)) AS m FROM x GROUP BY ALL) JOIN ranges USING (site, variable)"""),
)
def _(s: Stages) -> DataFrame:
    th = quality.change_thresholds(s.panel6, s.roles)
    return rounded(report.residual_strata(s.cells, s.panel6, th, s.ranges, "click", 20.0))


def _flagged(s: Stages) -> DataFrame:
    coarse = s.panel6.withColumn("value", F.floor(F.col("value") / 40).cast("double") * 40)
    return report.flagged_variable_cases(s.manifest, quality.constant_positions(coarse, 4))


@query(
    "H20_constant_exclusion",
    sql("scores flagged", f""", a AS (SELECT *, 'all' AS subset FROM scores UNION ALL SELECT *, 'exclude_constant' FROM scores s WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.case_id = s.case_id AND f.variable = s.variable))
SELECT model, subset, {r('avg(NMAE)', 'mean')}, {r('stddev_samp(NMAE)', 'sd')}, count(*) AS n_sites FROM ({site_sql('model, site, subset', src='a')}) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.constant_exclusion(s.scores, _flagged(s)))


@query(
    "H21_normalizer_sensitivity",
    sql("nscores", f""", q AS ({site_sql('model, site, normalizer', 'score', 'nscores')}), t AS ({sum_sql('q', 'model, normalizer', 'score')})
SELECT model, normalizer, {_SUMCOLS}, rank() OVER (PARTITION BY normalizer ORDER BY mean) AS rank_all, model <> 'linear' AS in_subset,
CASE WHEN model <> 'linear' THEN rank() OVER (PARTITION BY normalizer, model <> 'linear' ORDER BY mean) END AS rank_subset FROM t"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.normalizer_sensitivity(s.scores, metrics.norm_ranges(s.panel6), SUBSET))


@query(
    "H21_normalizer_effects",
    sql("nscores pairs null_w", f""", q AS ({site_sql('model, site, normalizer, scope', 'score', "(SELECT *, unnest(['all', variable]) AS scope FROM nscores)")}),
xz AS (SELECT p.model, p.reference, a.normalizer, a.scope, a.site, a.score AS x, b.score AS y FROM pairs p JOIN q a ON a.model = p.model JOIN q b ON b.model = p.reference AND b.site = a.site AND b.normalizer = a.normalizer AND b.scope = a.scope)
SELECT model, reference, normalizer, scope, {_PAIRCOLS}, {r('mx', 'mean_model')}, {r('my', 'mean_reference')} FROM ({holm_sql(paired('xz', 'model, reference, normalizer, scope'), 'normalizer, scope')}){_with_method('xz', 'model, reference, normalizer, scope')}"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.normalizer_effects(s.scores, metrics.norm_ranges(s.panel6), pairs(s)))


LIMITS = {v: (25.0, 70.0) for v in st.VARIABLES}


@query(
    "H22_prediction_bounds",
    sql("cellsx", f""", d AS (SELECT *, pred < 25 - 1e-6 AS b, pred > 70 + 1e-6 AS a, CASE WHEN pred < 25 - 1e-6 OR pred > 70 + 1e-6 THEN greatest(25 - pred, pred - 70) END AS x FROM cellsx)
SELECT model, variable, count(*) AS n_eval, count(*) FILTER (WHERE b) AS below_lower, count(*) FILTER (WHERE a) AS above_upper, count(*) FILTER (WHERE pred IS NULL) AS nonfinite,
{r('min(pred)', 'minimum_prediction')}, {r('max(pred)', 'maximum_prediction')}, count(*) FILTER (WHERE value = 0) AS zero_truth, count(*) FILTER (WHERE value = 0 AND b) AS below_on_zero_truth,
count(*) FILTER (WHERE pred < 24) AS below_by_1, count(*) FILTER (WHERE pred < 20) AS below_by_5, count(*) FILTER (WHERE pred < 15) AS below_by_10,
{r('count(*) FILTER (WHERE a OR b) / count(*)', 'pooled_fraction')}, {r('coalesce(avg(x), 0)', 'mean_excess')}, {r('coalesce(quantile_cont(x, 0.5), 0)', 'median_excess')},
{r('coalesce(quantile_cont(x, 0.95), 0)', 'p95_excess')}, {r('coalesce(max(x), 0)', 'max_excess')},
{r('(SELECT avg(q) FROM (SELECT e.site, count(*) FILTER (WHERE e.a OR e.b) / count(*) AS q FROM d e WHERE e.model = d.model AND e.variable = d.variable GROUP BY 1))', 'site_equal_fraction')}
FROM d GROUP BY model, variable"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.prediction_bounds(s.cells, LIMITS))


@query(
    "H23_clipping_sensitivity",
    sql("cellsx norms", f""", c AS (SELECT model, case_id, site, variable, count(*) AS n_eval, avg(abs(pred - value)) AS o, avg(abs(greatest(25, least(70, pred)) - value)) AS k FROM cellsx GROUP BY 1, 2, 3, 4),
x AS (SELECT c.model, c.site, c.n_eval, w.outputs, w.normalizer, CASE w.outputs WHEN 'original' THEN o ELSE k END / CASE w.normalizer WHEN 'full_range_common' THEN full_range ELSE robust_range END AS score
FROM c JOIN norms USING (site, variable), (VALUES ('original', 'full_range_common'), ('original', 'p01_p99_common'), ('clipped', 'full_range_common'), ('clipped', 'p01_p99_common')) w(outputs, normalizer) WHERE common_valid)
SELECT model, outputs, normalizer, {rr('mean', 'sd')}, n_sites, rank() OVER (PARTITION BY outputs, normalizer ORDER BY mean) AS rank FROM (
SELECT model, outputs, normalizer, avg(score) AS mean, stddev_samp(score) AS sd, count(*) AS n_sites FROM ({site_sql('model, site, outputs, normalizer', 'score', 'x')}) GROUP BY 1, 2, 3)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.clipping_sensitivity(s.cells, LIMITS, metrics.norm_ranges(s.panel6)))


_AUDIT = "SELECT s.case_id, s.site, s.variable, count(f.ref) AS n_references, coalesce(string_agg(f.ref, ',' ORDER BY f.rank), '') AS references_ FROM spans s LEFT JOIN refs f ON f.case_id = s.case_id AND f.variable = s.variable GROUP BY 1, 2, 3"


@query("H24_reference_audit", sql("spans refs", f'SELECT case_id, site, variable, n_references, references_ AS "references" FROM ({_AUDIT})'))
def _(s: Stages) -> DataFrame:
    return references.reference_audit(s.spans, s.references)


@query(
    "H24_score_by_references",
    sql("spans refs scores", f""", a AS ({_AUDIT}), q AS ({site_sql('model, site, n_references', src='(SELECT s.*, a.n_references FROM scores s JOIN a ON a.case_id = s.case_id AND a.variable = s.variable)')})
SELECT model, n_references, {r('avg(NMAE)', 'mean')}, count(*) AS n_sites FROM q GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    a = references.reference_audit(s.spans, s.references).select("case_id", "variable", "n_references")
    q = stats.site_scores(s.scores.join(a, ["case_id", "variable"]), "NMAE", ["n_references"])
    return rounded(q.groupBy("model", "n_references").agg(F.avg("NMAE").alias("mean"), F.count(F.lit(1)).alias("n_sites")))


_SLOTS = """SELECT scope, ref, row_number() OVER (PARTITION BY scope ORDER BY slots DESC, ref) AS rank, slots, slots / sum(slots) OVER (PARTITION BY scope) AS share
FROM (SELECT scope, ref, count(*) AS slots FROM (SELECT *, unnest(['all', variable]) AS scope FROM refs) GROUP BY 1, 2)"""


@query("H25_reference_concentration", sql("refs", f"SELECT scope, ref, rank, slots, {rr('share')}, {r('sum(CASE WHEN rank <= 2 THEN share END) OVER (PARTITION BY scope)', 'top_share')} FROM ({_SLOTS})"))
def _(s: Stages) -> DataFrame:
    c, t = references.reference_concentration(s.references, 2)
    return rounded(c.join(t, "scope"))


@query(
    "H25_same_group_fraction",
    sql("refs", f"""SELECT variable, tg AS target_group, count(*) AS slots, count(*) FILTER (WHERE tg = rg) AS same_slots, {r('avg(CASE WHEN tg = rg THEN 1 ELSE 0 END)', 'same_fraction')} FROM (
SELECT variable, 'g' || CAST(substr(site, 2) AS INTEGER) % 2 AS tg, 'g' || CAST(substr(ref, 2) AS INTEGER) % 2 AS rg FROM refs) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    grp = F.concat(F.lit("g"), (F.substring("site", 2, 9).cast("int") % 2).cast("string"))
    return rounded(references.same_group_fraction(s.references, s.roles.select("site", grp.alias("grp"))))


@query(
    "H26_variability_vs_error",
    sql("scores panel6", f""", v AS (SELECT site, variable, avg(abs(d)) / (max(value) - min(value)) AS sc FROM (SELECT *, value - lag(value) OVER (PARTITION BY site, variable ORDER BY pos) AS d FROM panel6) GROUP BY 1, 2),
j AS (SELECT variable, sc, NMAE FROM ({site_sql('model, site, variable', where="model = 'ridge'")}) JOIN v USING (site, variable)),
k AS (SELECT variable, rank() OVER (PARTITION BY variable ORDER BY sc) AS a, rank() OVER (PARTITION BY variable ORDER BY NMAE) AS b FROM j)
SELECT variable, {r('corr(a, b)', 'rho')}, count(*) AS n_sites FROM k GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    v = quality.variability(s.scaled).select("site", "variable", "scaled_change")
    e = stats.site_scores(s.scores.where("model = 'ridge'"), "NMAE", ["variable"])
    return rounded(stats.spearman(e.join(v, ["site", "variable"]), "scaled_change", "NMAE", ["variable"]))


@query(
    "H27_pareto",
    f"""WITH p AS (SELECT o_orderpriority AS model, o_totalprice AS cost, CAST(date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS DOUBLE) AS loss FROM orders),
l AS (SELECT model, min(cost) AS c0, max(cost) AS c1, min(loss) AS l0, max(loss) AS l1 FROM p GROUP BY 1),
f AS (SELECT p.*, sqrt(((cost - c0) / (c1 - c0)) ** 2 + ((loss - l0) / (l1 - l0)) ** 2) AS distance FROM p JOIN l USING (model)
WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.model = p.model AND q.cost <= p.cost AND q.loss <= p.loss AND (q.cost < p.cost OR q.loss < p.loss)))
SELECT model, {rr('cost', 'loss')}, {r('loss', 'envelope')}, {rr('distance')}, row_number() OVER (PARTITION BY model ORDER BY round(distance, 9), cost, loss) = 1 AS is_knee FROM f""",
)
def _(s: Stages) -> DataFrame:
    """Front of (price, age) per priority over all orders."""
    p = s.table("orders").select(
        F.col("o_orderpriority").alias("model"), F.col("o_totalprice").alias("cost"), F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate").cast("double").alias("loss")
    )
    return rounded(report.pareto(p, "cost", "loss", ["model"]).where("on_front").drop("on_front"))


@query(
    "H27_pareto_envelope",
    f"""WITH p AS (SELECT o_totalprice AS cost, CAST(date_diff('day', o_orderdate, TIMESTAMP '1999-01-01') AS DOUBLE) AS loss FROM orders)
SELECT {rr('cost', 'loss')}, {r('min(loss) OVER (ORDER BY cost)', 'envelope')} FROM p""",
)
def _(s: Stages) -> DataFrame:
    """Lower envelope at every order's price, all priorities together."""
    p = s.table("orders").select(F.col("o_totalprice").alias("cost"), F.datediff(F.lit("1999-01-01").cast("date"), "o_orderdate").cast("double").alias("loss"))
    return rounded(report.pareto(p, "cost", "loss").select("cost", "loss", "envelope"))


@query(
    "H28_context_ablation_summary",
    sql("mscores", f"SELECT model, context, {r('avg(NMAE)', 'mean_nmae')}, {r('avg(MAE)', 'mean_mae')}, CAST(sum(n_eval) AS BIGINT) AS n_eval FROM mscores GROUP BY 1, 2"),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.context_ablation_summary(s.context_scores))


@query(
    "H29_basic_summaries",
    sql("scores", 'SELECT model, "by", label, ' + ", ".join(r(f"avg({m})", m, 5) for m in ("MSE", "MAE", "NMAE")) + """, CAST(sum(n_eval) AS BIGINT) AS n_eval FROM (
SELECT *, 'scenario' AS "by", scenario AS label FROM scores UNION ALL SELECT *, 'variable', variable FROM scores UNION ALL SELECT *, 'gap_len', gap_len::VARCHAR FROM scores) GROUP BY 1, 2, 3"""),
)
def _(s: Stages) -> DataFrame:
    return report.basic_summaries(s.scores, ["scenario", "variable", "gap_len"])


_META = "SELECT 's' || (c_nationkey % 8)::VARCHAR AS site, avg(c_acctbal) * (1 + any_value(c_nationkey % 8)) / 5 AS area, CASE WHEN any_value(c_nationkey % 8) % 3 = 0 THEN 'glass' ELSE 'film' END AS structure FROM customer GROUP BY 1"


@query(
    "H30_metadata_strata",
    sql("site_s", f""", m AS ({_META}), q AS (SELECT quantile_cont(area, 1/3::DOUBLE) AS q1, quantile_cont(area, 2/3::DOUBLE) AS q2, quantile_cont(area, 0.5) AS med, min(area) AS mn, max(area) AS mx FROM m),
d AS (SELECT s.model, s.NMAE, m.*, q.* FROM site_s s JOIN m USING (site), q)
SELECT model, stratum_type, stratum, {r('avg(NMAE)', 'mean')}, count(*) AS n_sites FROM (
SELECT model, NMAE, 'area_bin' AS stratum_type, CASE WHEN area <= 2000 THEN '0-2000' WHEN area <= 6000 THEN '2000-6000' ELSE '6000+' END AS stratum FROM d
UNION ALL SELECT model, NMAE, 'area_tertile', CASE WHEN q1 <= mn OR q2 >= mx OR q1 = q2 THEN CASE WHEN area <= med THEN 'small' ELSE 'large' END WHEN area <= q1 THEN 'small' WHEN area <= q2 THEN 'medium' ELSE 'large' END FROM d
UNION ALL SELECT model, NMAE, 'structure', structure FROM d) GROUP BY 1, 2, 3"""),
)
def _(s: Stages) -> DataFrame:
    c = s.table("customer").withColumn("k", F.col("c_nationkey") % 8)
    m = c.groupBy(F.concat(F.lit("s"), F.col("k").cast("string")).alias("site")).agg(
        (F.avg("c_acctbal") * (1 + F.max("k")) / 5).alias("area"), F.when(F.max("k") % 3 == 0, "glass").otherwise("film").alias("structure")
    )
    return rounded(report.metadata_strata(stats.site_scores(s.scores), m))


@query(
    "H31_representative_site",
    sql("site_s", f"SELECT model, arg_min(site, round(g, 9)) AS representative, {r('any_value(m)', 'mean_score')}, {r('min(g)', 'distance')} FROM (SELECT s.*, m, abs(NMAE - m) AS g FROM site_s s JOIN (SELECT model, avg(NMAE) AS m FROM site_s GROUP BY 1) USING (model)) GROUP BY 1"),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.representative_site(stats.site_scores(s.scores)))


@query(
    "H32_delta_vs_best",
    sql("scores", f""", k AS (SELECT model, variable, avg(NMAE) AS mean FROM ({site_sql('model, site, variable')}) GROUP BY 1, 2)
SELECT variable, {r('b.mean', 'model_mean')}, {r('o.m', 'best_other')}, o.w AS best_other_model, {r('b.mean - o.m', 'delta')} FROM k b JOIN (SELECT variable, min(mean) AS m, arg_min(model, mean) AS w FROM k WHERE model <> 'bidir' GROUP BY 1) o USING (variable) WHERE b.model = 'bidir'"""),
)
def _(s: Stages) -> DataFrame:
    k = stats.site_scores(s.scores, "NMAE", ["variable"]).groupBy("model", "variable").agg(F.avg("NMAE").alias("mean"))
    return rounded(report.delta_vs_best(k, "bidir", ["variable"]))


@query(
    "H33_common_site_contrast",
    sql("scores", f""", d AS (SELECT * FROM scores WHERE scenario IN ('B', 'C') AND variable IN ('click', 'error', 'view')),
c AS (SELECT site FROM d WHERE scenario = 'B' INTERSECT SELECT site FROM d WHERE scenario = 'C')
SELECT model, scenario, {r('avg(NMAE)', 'mean')}, count(*) AS n_sites FROM ({site_sql('model, site, scenario', src='d', where='site IN (SELECT site FROM c)')}) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.common_site_contrast(s.scores, "B", "C", st.GROUP_B))


@query(
    "H34_compare_runs",
    sql("scores", f"SELECT count(*) AS matched, {r('max(abs(a.NMAE - b.NMAE))', 'max_abs_difference')}, {r('avg(abs(a.NMAE - b.NMAE))', 'mean_abs_difference')} FROM scores a JOIN scores b ON a.case_id = b.case_id AND a.variable = b.variable WHERE a.model = 'ridge' AND b.model = 'linear'"),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.compare_runs(s.scores.where("model = 'ridge'"), s.scores.where("model = 'linear'"), ["case_id", "variable"], "NMAE"))


@query("H35_gap_band", sql("scores", f"SELECT scenario, variable, model, gap_len, {r('avg(NMAE)', 'mean')}, {r('stddev_samp(NMAE)', 'sd')}, count(NMAE) AS n FROM scores GROUP BY 1, 2, 3, 4"))
def _(s: Stages) -> DataFrame:
    return rounded(report.gap_band(s.scores))


@query(
    "H36_panel_metrics",
    sql("cellsx", f""", g AS (SELECT site, variable, model, sum((value - pred) ** 2) AS sse, sum(value * value) - count(*) * avg(value) * avg(value) AS tot, avg(abs(value - pred)) AS mae FROM cellsx GROUP BY 1, 2, 3)
SELECT g.site, g.variable, g.model, {r('CASE WHEN tot <= 1e-9 AND sse = 0 THEN 1 WHEN tot <= 1e-9 THEN 0 ELSE 1 - sse / tot END', 'R2')}, {r('mae', 'MAE')}, b.best_baseline
FROM g JOIN (SELECT site, variable, arg_min(model, round(mae, 9)) AS best_baseline FROM g WHERE model <> 'bidir' GROUP BY 1, 2) b USING (site, variable)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.panel_metrics(s.cells, ["site", "variable"], "bidir"))


@query("H37_physical_mae", sql("scores", f", q AS ({site_sql('model, site, variable', 'MAE')}) SELECT model, variable, {_SUMCOLS} FROM ({sum_sql('q', 'model, variable', 'MAE')})"))
def _(s: Stages) -> DataFrame:
    return rounded(stats.summary(s.scores, "MAE", ["variable"]))


_SCOPED = "(SELECT *, 'all' AS scope FROM scores UNION ALL SELECT *, 'gap_8' FROM scores WHERE gap_len = 8 UNION ALL SELECT *, 'gap_le_4' FROM scores WHERE gap_len <= 4)"


@query("H38_scoped_summary", sql("scores", f", q AS ({site_sql('model, site, scope', src=_SCOPED)}) SELECT model, scope, {_SUMCOLS} FROM ({sum_sql('q', 'model, scope')})"))
def _(s: Stages) -> DataFrame:
    return rounded(report.scoped_summary(s.scores, 8, 4))


@query(
    "H38_scoped_compare",
    sql("scores pairs null_w", f""", q AS ({site_sql('model, site, scope', src=_SCOPED)}),
xz AS (SELECT p.model, p.reference, a.scope, a.site, a.NMAE AS x, b.NMAE AS y FROM pairs p JOIN q a ON a.model = p.model JOIN q b ON b.model = p.reference AND b.site = a.site AND b.scope = a.scope)
SELECT model, reference, scope, {_PAIRCOLS}, {r('mx', 'mean_model')}, {r('my', 'mean_reference')} FROM ({holm_sql(paired('xz', 'model, reference, scope'), 'scope')}){_with_method('xz', 'model, reference, scope')}"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.scoped_compare(s.scores, pairs(s), 8, 4))


@query(
    "H38_case_differences",
    sql("scores", f"SELECT case_id, site, variable, {r('x', 'a')}, {r('y', 'b')}, {r('x - y', 'difference')} FROM (SELECT case_id, site, variable, max(NMAE) FILTER (WHERE model = 'bidir') AS x, max(NMAE) FILTER (WHERE model = 'linear') AS y FROM scores GROUP BY 1, 2, 3)"),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.case_differences(s.scores, "bidir", "linear"))


@query(
    "H39_example_window",
    sql("cv panel6 middle cellsx", f"""SELECT c.case_id, c.site, c.variable, p.pos, p.ts, {r('p.value', 'truth')}, p.pos BETWEEN c.start_pos AND c.end_pos AS hidden, p.pos - c.start_pos AS steps_from_gap, x.model, {r('x.pred', 'pred')}
FROM cv c JOIN (SELECT case_id FROM (SELECT case_id, row_number() OVER (ORDER BY site, start_pos, case_id) - 1 AS i, count(*) OVER () AS n FROM middle) WHERE i = n // 2) k ON k.case_id = c.case_id
JOIN panel6 p ON p.site = c.site AND p.variable = c.variable AND p.pos BETWEEN c.start_pos - 12 AND c.end_pos + 4
LEFT JOIN cellsx x ON x.case_id = c.case_id AND x.variable = c.variable AND x.pos = p.pos"""),
)
def _(s: Stages) -> DataFrame:
    mid = masking.pick_middle_case(s.manifest, s.panel6, "C", 2, 12, 4, 0.7).select("case_id")
    return rounded(report.example_window(s.manifest.join(mid, "case_id"), s.panel6, s.cells, 12, 4))


@query(
    "H40_pooled_fit",
    sql("cellsx", f"""SELECT model, variable, count(*) AS n, {r('sqrt(sum((value - pred) ** 2) / count(*))', 'RMSE')},
{r('1 - sum((value - pred) ** 2) / (sum(value * value) - count(*) * avg(value) * avg(value))', 'R2')} FROM cellsx GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(report.pooled_fit(s.cells, ["model", "variable"]))


@query("H41_relative_curve", sql("msum mbest", f"SELECT s.model, s.context, {r('100 * (s.mean / b.mean - 1)', 'relative_percent')} FROM msum s JOIN mbest b ON b.model = s.model"))
def _(s: Stages) -> DataFrame:
    return rounded(report.context_curve(s.context_scores, "context").select("model", "context", "relative_percent"))


