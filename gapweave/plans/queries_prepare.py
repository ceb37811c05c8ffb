"""Queries for sources, reshaping, grids, quality and scaling (A-E)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import r6
from gapweave.operators import grid, quality, scaling, shape
from gapweave.plans import stages as st
from gapweave.plans.ctes import hsh, r, sql
from gapweave.plans.registry import query
from gapweave.plans.stages import Stages
from gapweave.plans.storage import new_path
from gapweave.sources import results, sheets
from gapweave.sources.events import event_observations

SENSORS = {"click": "Tin", "error": "Tout", "purchase": "RH", "signup": "CO2", "view": "Rad"}
RESULT_COLS = ["site", "model", "scenario", "vars_key", "gap_len", "repeat", "variable", "case_id", "MAE", "NMAE", "n_eval"]


def rounded(df: DataFrame) -> DataFrame:
    """Six decimals on every double column."""
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def bound_case(lo: bool, bounds=None) -> str:
    b = bounds or st.BOUNDS
    return "CASE variable " + " ".join(f"WHEN '{k}' THEN {v[0 if lo else 1]}::DOUBLE" for k, v in b.items()) + " END"


# ------------------------------------------------------------------ A sources and sinks


def _sheets(s: Stages) -> str:
    path = new_path(s.spark, "sheets")
    sheets.write_site_sheets(shape.to_wide(s.panel3, st.VARIABLES).drop("pos"), path)
    return path


@query("A1_read_site_sheets", sql("panel3", f"SELECT site, variable, ts, {r('value', 'value')} FROM panel3"))
def _(s: Stages) -> DataFrame:
    return rounded(sheets.read_site_sheets(s.spark, _sheets(s)))


@query(
    "A2_parse_compact_ts",
    """SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS parsed, min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts
FROM events WHERE event_id % 7 <> 0 GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    text = (
        F.when(F.col("event_id") % 7 == 0, F.lit("n/a"))
        .when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HHmmss"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    d = sheets.parse_timestamps(s.table("events").select(text.alias("stamp")), "stamp", "drop")
    return d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("parsed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "A2_parse_strict",
    "SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS parsed, min(date_trunc('second', ts)) AS first_ts, max(date_trunc('second', ts)) AS last_ts FROM events GROUP BY 1",
)
def _(s: Stages) -> DataFrame:
    """Every stamp, in one of the two forms; an unparseable one would fail the job."""
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HHmmss")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    d = sheets.parse_timestamps(s.table("events").select(text.alias("stamp")), "stamp", "strict")
    return d.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("parsed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("A3_list_sites", sql("obs3", "SELECT DISTINCT site FROM obs3"))
def _(s: Stages) -> DataFrame:
    return sheets.list_sites(s.spark, _sheets(s)).select("site")


@query("A4_split_json", sql("roles6", "SELECT site, role FROM roles6"))
def _(s: Stages) -> DataFrame:
    path = new_path(s.spark, "split")
    results.write_split(s.roles, path, {"seed": st.SEED, "n_test": 4})
    return results.read_split(s.spark, path)


def _model_counts(d: DataFrame) -> DataFrame:
    return d.groupBy("model").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_eval").alias("n_eval"), F.count_distinct("case_id").alias("cases"))


COUNTS = "SELECT model, count(*) AS rows, CAST(sum(n_eval) AS BIGINT) AS n_eval, count(DISTINCT case_id) AS cases FROM scores"


@query("A5_append_results", sql("scores", COUNTS + " GROUP BY 1"))
def _(s: Stages) -> DataFrame:
    path = new_path(s.spark, "results")
    rows = s.scores.select(*RESULT_COLS)
    results.append_results(rows.where("model = 'linear' or (model = 'ridge' and gap_len = 2)"), path)
    return _model_counts(results.append_results(rows, path))


@query("A6_reset_models", sql("scores", COUNTS + " WHERE model NOT IN ('seasonal') GROUP BY 1"))
def _(s: Stages) -> DataFrame:
    path = new_path(s.spark, "results")
    s.scores.select(*RESULT_COLS).write.partitionBy("model").parquet(path)
    return _model_counts(results.reset_models(s.spark, path, new_path(s.spark, "backup"), ["seasonal"]))


@query("A7_merge_shards", sql("scores", f"SELECT case_id, model, variable, {r('NMAE', 'NMAE')}, n_eval FROM scores"))
def _(s: Stages) -> DataFrame:
    rows = s.scores.select("case_id", "model", "variable", "NMAE", "n_eval")
    want = shape.explode_vars(s.manifest).select("case_id", "variable").crossJoin(rows.select("model").distinct())
    return results.merge_shards([results.shard(rows, 3, i) for i in range(3)], ["case_id", "model", "variable"], want)


@query(
    "A8_patch_results",
    sql("scores", f"SELECT case_id, model, variable, {r('CASE WHEN case_id % 5 = 0 THEN NMAE / 2 ELSE NMAE END', 'NMAE')} FROM scores"),
)
def _(s: Stages) -> DataFrame:
    rows = s.scores.select("case_id", "model", "variable", "NMAE")
    fix = rows.where("case_id % 5 = 0").withColumn("NMAE", F.col("NMAE") / 2)
    return rounded(results.patch_results(rows, fix, ["model", "case_id", "variable"]))


@query(
    "A9_read_site_metadata",
    f"""SELECT name, plant, area, n_groups FROM (
  SELECT 's' || (c_nationkey % 8)::VARCHAR AS name, 'crop ' || (c_nationkey % 4)::VARCHAR AS plant, {r('c_acctbal', 'area')}, 1::BIGINT AS n_groups,
         row_number() OVER (PARTITION BY c_nationkey % 8 ORDER BY c_custkey) AS rn FROM customer) WHERE rn = 1""",
)
def _(s: Stages) -> DataFrame:
    c = s.table("customer")
    odd = F.col("c_custkey") % 2 == 1
    grp = (F.col("c_nationkey") % 8).cast("string")
    crop = (F.col("c_nationkey") % 4).cast("string")
    raw = c.select(
        "c_custkey",
        F.when(odd, F.concat(F.lit(" S"), grp)).otherwise(F.concat(F.lit("s"), grp, F.lit(" "))).alias("name"),
        F.when(odd, F.concat(F.lit("Crop_"), crop)).otherwise(F.concat(F.lit(" crop "), crop)).alias("plant"),
        F.col("c_acctbal").alias("area"),
    )
    return rounded(results.read_site_metadata(raw, order=["c_custkey"]).select("name", "plant", "area", "n_groups"))


@query("A10_table_sinks", sql("panel3", f"SELECT site, variable, count(value) AS n, {r('avg(value)', 'mean')} FROM panel3 GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    path = new_path(s.spark, "csv")
    d = s.panel3.groupBy("site", "variable").agg(F.count("value").alias("n"), r6(F.avg("value")).alias("mean"))
    results.write_csv(d, path)
    return results.read_csv(s.spark, path, "site string, variable string, n long, mean double")


# ------------------------------------------------------------------ B projections, filters, reshaping


@query(
    "B1_select_targets",
    f"""WITH o AS (SELECT 's' || (user_id % 1000000)::VARCHAR AS site, event_type, time_bucket(INTERVAL '6 hours', ts) AS ts,
  CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE) AS value FROM events GROUP BY 1, 2, 3)
SELECT site, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SENSORS.items())} END AS variable, ts, {r('value', 'value')}
FROM o WHERE site IN (SELECT site FROM o GROUP BY 1 HAVING count(DISTINCT event_type) = 5)""",
)
def _(s: Stages) -> DataFrame:
    obs = event_observations(s.table("events"), 1_000_000, st.STEP6)
    return rounded(shape.select_targets(obs, SENSORS))


@query(
    "B2_attach_covariates",
    sql("obs6", f"SELECT site, variable, CASE WHEN variable = 'view' THEN 'covariate' ELSE 'target' END AS kind, count(*) AS n, {r('avg(value)', 'mean')} FROM obs6 WHERE variable IN ('click', 'error', 'view') GROUP BY ALL"),
)
def _(s: Stages) -> DataFrame:
    d = shape.attach_covariates(s.obs6, ["click", "error"], ["view", "wind"])
    return rounded(d.groupBy("site", "variable", "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")))


SCREEN = {k: (5.0, 150.0) for k in ("click", "error", "purchase")}


@query(
    "B3_range_screen",
    sql("panel3", f"SELECT site, variable, pos, {r(f'CASE WHEN coalesce(value < {bound_case(True, SCREEN)} OR value > {bound_case(False, SCREEN)}, false) THEN NULL ELSE value END', 'value')} FROM panel3"),
)
def _(s: Stages) -> DataFrame:
    return rounded(shape.range_screen(s.panel3, SCREEN).select("site", "variable", "pos", "value"))


@query(
    "B3_range_screen_report",
    sql("panel3", f"""SELECT site, variable, count(value) AS n_before, count(value) - count(*) FILTER (WHERE value < {bound_case(True, SCREEN)} OR value > {bound_case(False, SCREEN)}) AS n_after,
count(*) FILTER (WHERE value < {bound_case(True, SCREEN)} OR value > {bound_case(False, SCREEN)}) AS n_removed FROM panel3 GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return shape.range_screen_report(s.panel3, SCREEN)


@query("B4_melt", sql("panel6", f"SELECT site || '::' || variable AS item_id, site, variable, pos, ts, {r('value', 'value')} FROM panel6"))
def _(s: Stages) -> DataFrame:
    return rounded(shape.melt(shape.to_wide(s.panel6, st.VARIABLES), st.VARIABLES).select("item_id", "site", "variable", "pos", "ts", "value"))


@query(
    "B5_pivot_scores",
    sql("site_s", "SELECT site, " + ", ".join(r(f"max(NMAE) FILTER (WHERE model = '{m}')", m) for m in st.SCORED_MODELS) + " FROM site_s GROUP BY 1"),
)
def _(s: Stages) -> DataFrame:
    from gapweave.operators.stats import site_scores

    return rounded(shape.pivot_scores(site_scores(s.scores), ["site"], "model", st.SCORED_MODELS, "NMAE"))


CLIP = {v: (20.0, 80.0) for v in st.VARIABLES}


@query("B6_clip_to_bounds", sql("cellsx", f"SELECT model, case_id, variable, pos, {r('greatest(20.0::DOUBLE, least(80.0::DOUBLE, pred))', 'pred')} FROM cellsx"))
def _(s: Stages) -> DataFrame:
    return rounded(shape.clip_to_bounds(s.cells.select("model", "case_id", "variable", "pos", "pred"), CLIP, "pred"))


@query("B7_explode_vars", sql("cv", "SELECT case_id, variable FROM cv"))
def _(s: Stages) -> DataFrame:
    return shape.explode_vars(s.manifest.select("case_id", "vars_key"), "vars_key").select("case_id", "variable")


@query(
    "B8_round6",
    sql("scaled", f"SELECT site, variable, {r('avg(z)', 'mean_z')}, {r('CASE WHEN count(z) > 100 THEN max(z) END', 'max_z')} FROM scaled GROUP BY 1, 2"),
)
def _(s: Stages) -> DataFrame:
    d = s.scaled.groupBy("site", "variable").agg(F.avg("z").alias("mean_z"), F.when(F.count("z") > 100, F.max("z")).otherwise(F.lit(float("nan"))).alias("max_z"))
    return shape.round6(d, ["mean_z", "max_z"])


@query("B9_head_per_group", sql("manifest", "SELECT scenario, gap_len, case_id FROM manifest QUALIFY row_number() OVER (PARTITION BY scenario, gap_len ORDER BY case_id) <= 2"))
def _(s: Stages) -> DataFrame:
    return shape.head_per_group(s.manifest, ["scenario", "gap_len"], ["case_id"], 2).select("scenario", "gap_len", "case_id")


@query("B10_derive_rmse", sql("scores", f"SELECT case_id, model, variable, {r('sqrt(greatest(MSE, 0))', 'RMSE')} FROM scores"))
def _(s: Stages) -> DataFrame:
    return rounded(shape.derive_rmse(s.scores.drop("RMSE")).select("case_id", "model", "variable", "RMSE"))


# ------------------------------------------------------------------ C grids and calendar


@query("C1_regularize", sql("panel3", f"SELECT site, variable, pos, ts, {r('value', 'value')} FROM panel3"))
def _(s: Stages) -> DataFrame:
    return rounded(grid.regularize(s.obs3, st.STEP3))


@query(
    "C1_regularize_report",
    sql("obs3 span3", "SELECT site, any_value(n) AS rows, count(DISTINCT ts) AS source_rows, any_value(n) - count(DISTINCT ts) AS inserted_rows FROM obs3 JOIN span3 USING (site) GROUP BY 1"),
)
def _(s: Stages) -> DataFrame:
    return grid.regularize_report(s.obs3, st.STEP3)


@query(
    "C1_grid_violations",
    """WITH e AS (SELECT 's' || (user_id % 8)::VARCHAR AS site, event_type AS variable, date_trunc('minute', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2, 3)
SELECT site, 0::BIGINT AS null_stamps, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, count(*) FILTER (WHERE epoch_us(ts) % 300000000 <> 0) AS off_grid_stamps FROM e GROUP BY 1""",
)
def _(s: Stages) -> DataFrame:
    from gapweave.functions.exprs import floor_ts

    e = s.table("events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("site"), F.col("event_type").alias("variable"), floor_ts("ts", 60_000_000).alias("ts")
    )
    return grid.grid_violations(e, 300_000_000)


@query("C2_assert_grid", sql("panel3", "SELECT site, variable, count(*) - 1 AS steps, 0::BIGINT AS violations FROM panel3 GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return grid.assert_grid(s.panel3, st.STEP3)


@query(
    "C3_detect_freq",
    f"""WITH d AS (SELECT DISTINCT 's' || (user_id % 8)::VARCHAR AS site, ts FROM events),
g AS (SELECT site, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY site ORDER BY ts))) / 60e6 AS m FROM d),
q AS (SELECT site, quantile_cont(CAST(m AS DOUBLE), 0.5) AS med FROM g GROUP BY 1)
SELECT site, {r('med', 'median_minutes')}, CASE WHEN med <= 1.5 THEN '1min' WHEN med <= 6 THEN '5min' WHEN med <= 11 THEN '10min' ELSE '1H' END AS freq FROM q""",
)
def _(s: Stages) -> DataFrame:
    e = s.table("events").select(F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("site"), "ts")
    return rounded(grid.detect_freq(e))


_CAL = ", ".join(
    [r("sin(2 * pi() * hour(ts) / 24)", "hour_sin"), r("cos(2 * pi() * hour(ts) / 24)", "hour_cos"),
     r("sin(2 * pi() * dayofyear(ts) / 365.25)", "doy_sin"), r("cos(2 * pi() * dayofyear(ts) / 365.25)", "doy_cos")]
)


@query("C4_calendar_features", sql("panel6", f"SELECT DISTINCT site, pos, {_CAL} FROM panel6"))
def _(s: Stages) -> DataFrame:
    d = s.panel6.select("site", "pos", "ts").distinct()
    return rounded(grid.calendar_features(d).drop("ts"))


_SEASON = "CASE WHEN month({0}) IN (6, 7, 8) THEN 'summer' WHEN month({0}) IN (12, 1, 2) THEN 'winter' WHEN month({0}) IN (3, 4, 5) THEN 'spring' ELSE 'fall' END"
_TOD = "CASE WHEN hour({0}) < 12 THEN 'AM' ELSE 'PM' END"


@query(
    "C5_group_labels",
    f"""SELECT {_SEASON.format('o_orderdate')} AS season, {_TOD.format('o_orderdate')} AS time_of_day,
{_SEASON.format('o_orderdate')} || '_' || {_TOD.format('o_orderdate')} AS season_tod, count(*) AS n FROM orders GROUP BY ALL""",
)
def _(s: Stages) -> DataFrame:
    d = grid.group_labels(s.table("orders").select(F.col("o_orderdate").alias("ts")))
    return d.groupBy("season", "time_of_day", "season_tod").agg(F.count(F.lit(1)).alias("n"))


@query("C6_chrono_split", sql("panel6 cut6", "SELECT site, CASE WHEN pos < cut THEN 'prefix' ELSE 'suffix' END AS part, any_value(cut) AS cut, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM panel6 JOIN cut6 USING (site) GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    d = grid.chrono_split(s.panel6)
    return d.groupBy("site", "part").agg(F.max("cut").alias("cut"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(
    "C7_mask_start_month",
    sql("manifest", """SELECT strftime(start_ts, '%Y-%m') AS start_month, scenario, gap_len, count(*) AS mask_cases, count(DISTINCT site) AS n_sites,
CAST(sum(n_vars) AS BIGINT) AS variable_cases, CAST(sum(gap_len * n_vars) AS BIGINT) AS evaluated_variable_steps FROM manifest GROUP BY 1, 2, 3"""),
)
def _(s: Stages) -> DataFrame:
    return grid.mask_start_month(s.manifest)


# ------------------------------------------------------------------ D missingness and quality


@query("D1_find_gaps", sql("runs3", "SELECT site, variable, start_pos, end_pos FROM runs3"))
def _(s: Stages) -> DataFrame:
    return quality.find_gaps(s.panel3).select("site", "variable", "start_pos", "end_pos")


@query(
    "D1_any_variable_gaps",
    sql("panel3", """SELECT site, min(pos) AS start_pos, max(pos) AS end_pos FROM (SELECT site, pos, pos - row_number() OVER (PARTITION BY site ORDER BY pos) AS g
FROM (SELECT site, pos FROM panel3 GROUP BY 1, 2 HAVING count(value) < count(*))) GROUP BY site, g"""),
)
def _(s: Stages) -> DataFrame:
    return quality.any_variable_gaps(s.panel3).select("site", "start_pos", "end_pos")


_CLASS = """CASE WHEN start_pos = 0 AND end_pos = n - 1 THEN 'entirely_unobserved' WHEN start_pos = 0 THEN 'leading' WHEN end_pos = n - 1 THEN 'trailing' ELSE 'internal' END"""
_BIN = """CASE WHEN end_pos - start_pos + 1 < 6 THEN '1-5' WHEN end_pos - start_pos + 1 < 24 THEN '6-23' WHEN end_pos - start_pos + 1 < 72 THEN '24-71'
WHEN end_pos - start_pos + 1 < 168 THEN '72-167' WHEN end_pos - start_pos + 1 < 336 THEN '168-335' WHEN end_pos - start_pos + 1 < 720 THEN '336-719' ELSE '720+' END"""


@query("D2_classify_runs", sql("runs3", f"SELECT site, variable, start_pos, end_pos, n, end_pos - start_pos + 1 AS length, {_CLASS} AS position_class, {_BIN} AS duration_bin FROM runs3"))
def _(s: Stages) -> DataFrame:
    return quality.classify_runs(quality.find_gaps(s.panel3))


@query(
    "D3_missing_run_summary",
    sql("runs3 roles3", f"""SELECT role, variable, {_CLASS} AS position_class, {_BIN} AS duration_bin, count(*) AS runs, CAST(sum(end_pos - start_pos + 1) AS BIGINT) AS missing_steps,
count(DISTINCT site) AS n_sites, max(end_pos - start_pos + 1) AS max_steps FROM runs3 JOIN roles3 USING (site) GROUP BY 1, 2, 3, 4"""),
)
def _(s: Stages) -> DataFrame:
    return quality.missing_run_summary(quality.find_gaps(s.panel3), s.roles)


_COOC = """SELECT site, coalesce(l, 'none') AS missing_variables, count(*) AS positions FROM
(SELECT site, pos, string_agg(variable, ',' ORDER BY variable) FILTER (WHERE value IS NULL) AS l FROM panel3 GROUP BY 1, 2) GROUP BY 1, 2"""


@query("D4_missing_cooccurrence", sql("panel3 span3", f"SELECT c.*, {r('positions / s.n', 'fraction')} FROM ({_COOC}) c JOIN span3 s USING (site)"))
def _(s: Stages) -> DataFrame:
    return rounded(quality.missing_cooccurrence(s.panel3, st.VARIABLES))


@query("D4_missing_cooccurrence_totals", sql("panel3 roles3", f"SELECT role, missing_variables, CAST(sum(positions) AS BIGINT) AS positions, count(DISTINCT site) AS n_sites FROM ({_COOC}) JOIN roles3 USING (site) GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return quality.missing_cooccurrence_totals(s.panel3, st.VARIABLES, s.roles)


DIAG = {v: (0.5, 100.0) for v in st.VARIABLES}


@query(
    "D5_raw_value_diagnostics",
    sql("scr", f"""SELECT site, variable, count(*) AS positions, count(value) AS n_finite, {r('avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END)', 'fraction_missing')},
{r('count(*) FILTER (WHERE abs(value - round_even(value, 0)) <= 1e-8) / nullif(count(value), 0)', 'integer_fraction')},
count(*) FILTER (WHERE value = 0.5) AS n_equal_lower, count(*) FILTER (WHERE value = 100) AS n_equal_upper,
count(*) FILTER (WHERE variable = 'click' AND value = 100) AS n_click_at_100, count(*) FILTER (WHERE variable = 'view' AND value > 90) AS n_view_above_90 FROM scr GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    v = F.col("value")
    d = s.panel3.withColumn("value", F.when(v.isNotNull(), F.greatest(F.lit(0.5), F.least(F.lit(100.0), v))))
    return rounded(quality.raw_value_diagnostics(d, DIAG, {"n_click_at_100": ("click", 100.0)}, {"n_view_above_90": ("view", 90.0)}))


def _coarse(s: Stages) -> DataFrame:
    """The 3-hour panel as a coarse sensor (steps of 25): equal neighbours do occur."""
    return s.panel3.withColumn("value", F.floor(F.col("value") / 25).cast("double") * 25)


@query(
    "D6_constant_runs",
    sql("construns", "SELECT site, variable, start_pos, end_pos, steps, value FROM construns WHERE steps >= 4"),
)
def _(s: Stages) -> DataFrame:
    return quality.constant_runs(_coarse(s), 4).select("site", "variable", "start_pos", "end_pos", "steps", "value")


@query("D6_constant_positions", sql("construns coarse", """SELECT c.site, c.variable, c.pos, k.site IS NOT NULL AS constant_flag FROM coarse c
LEFT JOIN (SELECT * FROM construns WHERE steps >= 4) k ON k.site = c.site AND k.variable = c.variable AND c.pos BETWEEN k.start_pos AND k.end_pos"""))
def _(s: Stages) -> DataFrame:
    return quality.constant_positions(_coarse(s), 4).select("site", "variable", "pos", "constant_flag")


@query(
    "D7_missing_rate",
    sql("construns coarse", f"""SELECT c.site, c.variable, count(*) AS positions, count(c.value) AS observations, {r('avg(CASE WHEN c.value IS NULL THEN 1 ELSE 0 END)', 'missing_fraction')},
count(k.site) AS constant_flag_steps FROM coarse c LEFT JOIN (SELECT * FROM construns WHERE steps >= 4) k
ON k.site = c.site AND k.variable = c.variable AND c.pos BETWEEN k.start_pos AND k.end_pos GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.missing_rate(_coarse(s), 4))


@query(
    "D8_change_thresholds",
    sql("panel6 roles6 cut6", f"""SELECT variable, {r('quantile_cont(CAST(abs(d) AS DOUBLE), 0.75)', 'threshold')}, count(d) AS n_changes FROM (
SELECT *, value - lag(value) OVER (PARTITION BY site, variable ORDER BY pos) AS d FROM panel6) JOIN roles6 USING (site) JOIN cut6 USING (site) WHERE role = 'train' AND pos < cut GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.change_thresholds(s.panel6, s.roles))


@query(
    "D9_site_profile",
    sql("panel3 obs3 span3 cut3", f"""SELECT p.site, min(p.ts) AS start_ts, max(p.ts) AS end_ts, any_value(c.n) AS rows, (SELECT count(DISTINCT ts) FROM obs3 o WHERE o.site = p.site) AS source_rows,
any_value(c.n) - (SELECT count(DISTINCT ts) FROM obs3 o WHERE o.site = p.site) AS inserted_rows, any_value(c.cut) AS cut, count(DISTINCT month(p.ts)) AS n_months,
bool_or(month(p.ts) IN (6, 7, 8)) AS has_summer, bool_or(month(p.ts) IN (12, 1, 2)) AS has_winter, count(DISTINCT p.variable) FILTER (WHERE p.value IS NOT NULL) AS n_variables,
{r('count(p.value) / count(*)', 'completeness')}, strftime(min(p.ts), '%Y-%m') || ' to ' || strftime(max(p.ts), '%Y-%m') AS period
FROM panel3 p JOIN cut3 c ON c.site = p.site GROUP BY p.site"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.site_profile(s.panel3, s.obs3))


_CTX = """SELECT c.case_id, c.site, c.variable, c.scenario, c.gap_len, c.start_pos - greatest(c.start_pos - 60, 0) AS left_positions,
least(c.end_pos + 1 + 60, s.n) - c.end_pos - 1 AS right_positions, count(p.value) FILTER (WHERE p.pos < c.start_pos) AS left_observed, count(p.value) FILTER (WHERE p.pos > c.end_pos) AS right_observed,
c.start_pos < 60 AS left_short, least(c.end_pos + 1 + 60, s.n) - c.end_pos - 1 < 60 AS right_short
FROM cv c JOIN span6 s USING (site) LEFT JOIN panel6 p ON p.site = c.site AND p.variable = c.variable AND p.pos BETWEEN c.start_pos - 60 AND c.end_pos + 60 GROUP BY ALL"""


@query("D10_available_context", sql("cv span6 panel6", _CTX))
def _(s: Stages) -> DataFrame:
    return quality.available_context(s.manifest, s.panel6, 60)


@query(
    "D10_available_context_summary",
    sql("cv span6 panel6", f"""SELECT scenario, variable, count(*) AS variable_cases, min(left_positions) AS left_min, {r('median(left_positions)', 'left_median')}, min(right_positions) AS right_min,
{r('median(right_positions)', 'right_median')}, count(*) FILTER (WHERE left_short) AS left_short_cases, count(*) FILTER (WHERE right_short) AS right_short_cases,
{r('median(left_observed)', 'left_observed_median')}, {r('median(right_observed)', 'right_observed_median')}, count(*) FILTER (WHERE NOT left_short AND NOT right_short) AS both_full_cases FROM ({_CTX}) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.available_context_summary(quality.available_context(s.manifest, s.panel6, 60)))


@query(
    "D11_variability",
    sql("scaled", f"""SELECT site, variable, {r('avg(abs(d))', 'mean_change')}, {r('quantile_cont(CAST(abs(d) AS DOUBLE), 0.5)', 'median_change')},
{r('avg(abs(d)) / nullif(max(value) - min(value), 0)', 'scaled_change')}, {r('stddev_samp(dz)', 'sd_scaled_change')}, {r('max(value) - min(value)', 'range')} FROM (
SELECT *, value - lag(value) OVER w AS d, z - lag(z) OVER w AS dz FROM scaled WINDOW w AS (PARTITION BY site, variable ORDER BY pos)) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.variability(s.scaled))


_PAIRS = """SELECT a.site, a.variable AS var_a, b.variable AS var_b, a.value AS x, b.value AS y FROM panel6 a JOIN panel6 b
ON a.site = b.site AND a.pos = b.pos AND a.variable < b.variable WHERE a.value IS NOT NULL AND b.value IS NOT NULL"""


@query("D12_corr_matrix_site_mean", sql("panel6", f"SELECT var_a, var_b, {r('avg(c)', 'r')}, count(c) AS n_sites FROM (SELECT site, var_a, var_b, corr(x, y) AS c FROM ({_PAIRS}) GROUP BY 1, 2, 3) GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return rounded(quality.corr_matrix(s.panel6, st.VARIABLES, "site_mean"))


@query("D12_corr_matrix_pooled", sql("panel6", f"SELECT var_a, var_b, {r('corr(x, y)', 'r')}, count(*) AS n_pairs FROM ({_PAIRS}) GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return rounded(quality.corr_matrix(s.panel6, st.VARIABLES, "pooled"))


@query(
    "D13_distribution_summary",
    sql("panel3", f"""SELECT variable, {r('quantile_cont(value, 0.25)', 'q1')}, {r('quantile_cont(value, 0.5)', 'median')}, {r('quantile_cont(value, 0.75)', 'q3')}, count(*) AS n FROM panel3 WHERE value IS NOT NULL GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(quality.distribution_summary(s.panel3))


@query("D14_role_missing_means", sql("panel3 roles3", f"SELECT role, variable, {r('avg(m)', 'mean_missing_rate')}, count(*) AS n_sites FROM (SELECT site, variable, avg(CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS m FROM panel3 GROUP BY 1, 2) JOIN roles3 USING (site) GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return rounded(quality.role_missing_means(s.panel3, s.roles))


# ------------------------------------------------------------------ E scaling


@query("E1_fit_minmax_pooled", sql("scaler", f"SELECT variable, {r('lo', 'lo')}, {r('hi', 'hi')}, n_obs FROM scaler"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.fit_minmax(s.panel6, "pooled_prefix", 0.8, s.roles))


@query("E1_fit_minmax_site", sql("panel6", f"SELECT site, variable, {r('min(value)', 'lo')}, {r('max(value)', 'hi')}, count(value) AS n_obs FROM panel6 GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.fit_minmax(s.panel6, "site"))


@query("E1_fit_minmax_train", sql("panel6 cut6", f"SELECT site, variable, {r('min(value)', 'lo')}, {r('max(value)', 'hi')}, count(value) AS n_obs FROM panel6 JOIN cut6 USING (site) WHERE pos < cut GROUP BY 1, 2"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.fit_minmax(s.panel6, "train"))


@query("E2_transform_minmax", sql("scaled", f"SELECT site, variable, pos, {r('z', 'z')} FROM scaled"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.transform_minmax(s.panel6, s.scaler).select("site", "variable", "pos", "z"))


@query("E3_inverse_minmax", sql("panel6", f"SELECT site, variable, pos, {r('value', 'back')} FROM panel6"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.inverse_minmax(s.scaled, s.scaler, "z", "back").select("site", "variable", "pos", "back"))


_ZS = "SELECT variable, avg(filled) AS mean, CASE WHEN coalesce(stddev_samp(filled), 0) = 0 THEN 1 ELSE stddev_samp(filled) END AS sd FROM lin6 JOIN roles6 USING (site) WHERE role = 'train' GROUP BY 1"


@query("E4_fit_zscore", sql("lin6 roles6", f"SELECT variable, {r('mean', 'mean')}, {r('sd', 'sd')} FROM ({_ZS})"))
def _(s: Stages) -> DataFrame:
    return rounded(scaling.fit_zscore(s.of_role(s.panel6, "train")))


@query(
    "E4_zscore_roundtrip",
    sql("lin6 roles6", f"SELECT p.site, p.variable, p.pos, {r('(p.value - s.mean) / s.sd', 'z')}, {r('p.value', 'back')} FROM lin6 p JOIN ({_ZS}) s USING (variable)"),
)
def _(s: Stages) -> DataFrame:
    stats = scaling.fit_zscore(s.of_role(s.panel6, "train"))
    d = scaling.transform_zscore(s.panel6, stats)
    return rounded(scaling.inverse_zscore(d, stats, "z", "back").select("site", "variable", "pos", "z", "back"))


