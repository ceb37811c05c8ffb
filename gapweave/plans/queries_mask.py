"""Queries for masking, splitting and sampling (F)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import forecast, masking
from gapweave.plans import stages as st
from gapweave.plans.ctes import hsh, r, sql, unit
from gapweave.plans.queries_prepare import rounded
from gapweave.plans.registry import query
from gapweave.plans.stages import Stages


def _test(s: Stages) -> DataFrame:
    return s.of_role(s.panel6, "test")


@query("F1_feasible_starts", sql("feas", "SELECT site, scenario, vars_key, gap_len, start_pos FROM feas"))
def _(s: Stages) -> DataFrame:
    return masking.feasible_starts(_test(s), s.combos, st.GAPS, st.LEFT_CTX)


@query("F2_select_nonoverlapping", sql("picks", "SELECT site, scenario, vars_key, gap_len, repeat, start_pos FROM picks"))
def _(s: Stages) -> DataFrame:
    return masking.select_nonoverlapping(masking.feasible_starts(_test(s), s.combos, st.GAPS, st.LEFT_CTX), st.REPEATS, st.SEED)


@query("F3_build_manifest", sql("manifest", "SELECT case_id, site, scenario, vars_key, gap_len, repeat, start_pos, end_pos, start_ts, end_ts FROM manifest"))
def _(s: Stages) -> DataFrame:
    return masking.build_manifest(_test(s), s.combos, st.GAPS, st.LEFT_CTX, st.REPEATS, st.SEED).drop("masked_vars")


@query("F4_build_validation_manifest", sql("valmanifest", "SELECT case_id, site, scenario, vars_key, gap_len, repeat, start_pos, end_pos, start_ts, validation_start FROM valmanifest"))
def _(s: Stages) -> DataFrame:
    train = s.of_role(s.panel6, "train")
    return masking.build_validation_manifest(train, s.combos, st.GAPS, 48, 4, st.REPEATS, st.SEED).drop("masked_vars")


@query(
    "F5_apply_case",
    sql("manifest panel6", f"""SELECT case_id, site, variable, pos, NOT h AS artificial, NOT h AND value IS NOT NULL AS effective, h AND value IS NOT NULL AS eval, {r('CASE WHEN NOT h THEN value END', 'masked_value')} FROM (
SELECT m.case_id, m.site, p.variable, p.pos, p.value, list_contains(string_split(m.vars_key, ','), p.variable) AND p.pos BETWEEN m.start_pos AND m.end_pos AS h
FROM manifest m JOIN panel6 p ON p.site = m.site AND p.pos BETWEEN m.start_pos - 4 AND m.end_pos + 4)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(masking.apply_case(s.manifest, s.panel6, 4, 4))


_MI = f"""SELECT site, variable, pos, value IS NOT NULL AND row_number() OVER (PARTITION BY site, variable, value IS NULL ORDER BY {hsh('42', 'site', 'variable', 'pos')}, pos)
<= floor(count(value) OVER (PARTITION BY site, variable) * 0.15::DOUBLE) AS hidden FROM panel3"""


@query("F6_mask_individual", sql("panel3", _MI))
def _(s: Stages) -> DataFrame:
    return masking.mask_individual(s.panel3, 0.15, st.SEED).select("site", "variable", "pos", "hidden")


def _blocks_sql(rate: float, block: int) -> str:
    return f"""SELECT site, u + (rk - 1) * {block} - CASE WHEN rk > lastrk THEN short ELSE 0 END AS start_pos,
u + rk * {block} - CASE WHEN rk >= lastrk THEN short ELSE 0 END - 1 AS end_pos, target FROM (
SELECT *, max(rk) FILTER (WHERE b = blocks - 1) OVER (PARTITION BY site) AS lastrk FROM (
SELECT *, row_number() OVER (PARTITION BY site ORDER BY h, b) AS rk, (h * (n - target + 1)) // 4294967296 AS u FROM (
SELECT *, blocks * {block} - target AS short, {hsh('42', 'site', "'block'", 'b')} AS h FROM (
SELECT *, unnest(range(blocks)) AS b FROM (SELECT *, (target + {block - 1}) // {block} AS blocks FROM (SELECT site, n, CAST(round(n * {rate}::DOUBLE) AS BIGINT) AS target FROM span3)))))) """


@query("F7_mask_blocks", sql("span3", _blocks_sql(0.2, 8)))
def _(s: Stages) -> DataFrame:
    sites = s.panel3.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    return masking.mask_blocks(sites, 0.2, masking.block_points(24, st.STEP3), st.SEED)


@query("F7_mask_blocks_dense", sql("span3", _blocks_sql(0.9, 7)))
def _(s: Stages) -> DataFrame:
    """Nine tenths hidden: blocks keep their length, only the last one drawn is shorter."""
    sites = s.panel3.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    return masking.mask_blocks(sites, 0.9, 7, st.SEED)


def _windows(s: Stages, length: int) -> DataFrame:
    wid = F.concat_ws(":", "site", F.expr(f"pos div {length}"))
    return s.scaled.select(wid.alias("window_id"), (F.col("pos") % length).alias("pos_in"), "variable", F.col("z").alias("value"))


@query(
    "F8_corrupt_mixture",
    sql("scaled", f"""SELECT window_id, pos_in, variable, kind, {r('CASE WHEN seen AND NOT hit THEN z ELSE 0 END', 'x')}, seen AND NOT hit AS mask, {r('CASE WHEN seen THEN z ELSE 0 END', 'holdout')}, seen AND hit AS indicator FROM (
SELECT *, z IS NOT NULL AS seen, CASE kind WHEN 0 THEN {unit('42', 'window_id', 'variable', 'pos_in')} < 0.2 WHEN 1 THEN blk AND variable = vv WHEN 2 THEN blk AND variable IN ('click', 'error', 'view') ELSE blk END AS hit FROM (
SELECT *, pos_in >= st AND pos_in < st + ln AS blk FROM (
SELECT *, {hsh('42', 'window_id', "'start'")} % (24 - ln + 1) AS st FROM (
SELECT site || ':' || (pos // 24)::VARCHAR AS window_id, pos % 24 AS pos_in, variable, z,
{hsh('42', 'window_id', "'kind'")} % 4 AS kind, [2, 4, 8][{hsh('42', 'window_id', "'len'")} % 3 + 1] AS ln,
['click', 'error', 'purchase', 'signup', 'view'][{hsh('42', 'window_id', "'var'")} % 5 + 1] AS vv FROM scaled))))"""),
)
def _(s: Stages) -> DataFrame:
    d = masking.corrupt_mixture(_windows(s, 24), st.VARIABLES, st.GROUP_B, st.GAPS, 24, st.SEED)
    return rounded(d.drop("value"))


@query("F9_alternating_blocks", sql("panel6", "SELECT site, variable, pos, (pos // 6) % 2 = 0 AS hidden FROM panel6"))
def _(s: Stages) -> DataFrame:
    return masking.alternating_blocks(s.panel6, 6, 0).select("site", "variable", "pos", "hidden")


_PROFILE = """SELECT 's' || (o_custkey % 40)::VARCHAR AS site, count(DISTINCT o_orderpriority) AS n_variables, count(DISTINCT date_trunc('month', o_orderdate)) / 80.0::DOUBLE AS completeness,
bool_or(month(o_orderdate) IN (6, 7, 8)) AS has_summer, bool_or(month(o_orderdate) IN (12, 1, 2)) AS has_winter FROM orders GROUP BY 1"""


@query(
    "F10_scan_and_split",
    f"""WITH p AS ({_PROFILE}), q AS (SELECT site, coalesce(completeness >= 0.99 AND has_summer AND has_winter, false) AS in_pool FROM p WHERE n_variables > 0)
SELECT site, in_pool, CASE WHEN in_pool AND row_number() OVER (PARTITION BY in_pool ORDER BY {hsh('42', 'site')}, site) <= 10 THEN 'test' ELSE 'train' END AS role FROM q""",
)
def _(s: Stages) -> DataFrame:
    o = s.table("orders")
    months = F.collect_set(F.month("o_orderdate"))
    p = o.groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % 40).cast("string")).alias("site")).agg(
        F.count_distinct("o_orderpriority").alias("n_variables"),
        (F.count_distinct(F.date_format("o_orderdate", "yyyy-MM")) / 80.0).alias("completeness"),
        F.arrays_overlap(months, F.array(*[F.lit(m) for m in (6, 7, 8)])).alias("has_summer"),
        F.arrays_overlap(months, F.array(*[F.lit(m) for m in (12, 1, 2)])).alias("has_winter"),
        F.lit(0.99).alias("min_completeness"),
    )
    return masking.scan_and_split(p, 10, st.SEED)


@query(
    "F11_rebind_cases",
    sql("manifest p_linear spans", f"""SELECT l.case_id, l.variable, 'B' AS scenario, count(*) AS cells, {r('avg(l.y_hat)', 'mean_fill')} FROM p_linear l JOIN manifest m USING (case_id)
WHERE m.scenario = 'C' AND l.variable IN ('click', 'error', 'view') GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    from gapweave.operators import impute

    cases = masking.rebind_cases(s.manifest, "C", "B", st.GROUP_B)
    p = impute.case_linear(impute.merged_spans(cases, s.scaled, "z")).join(cases.select("case_id", "scenario"), "case_id")
    return rounded(p.groupBy("case_id", "variable", "scenario").agg(F.count(F.lit(1)).alias("cells"), F.avg("y_hat").alias("mean_fill")))


@query(
    "F12_training_windows",
    sql("panel6 cut6", """SELECT w.site, part, start_pos, start_pos + 15 AS end_pos, CAST(sum(c) AS BIGINT) AS finite, min(c) AS min_each FROM (
SELECT w.site, w.part, w.start_pos, p.variable, count(p.value) AS c FROM (
 SELECT site, 'prefix' AS part, unnest(range(0, cut - 16 + 1, 8)) AS start_pos FROM cut6 UNION ALL SELECT site, 'suffix', unnest(range(cut, n - 16 + 1, 4)) FROM cut6) w
JOIN panel6 p ON p.site = w.site AND p.pos BETWEEN w.start_pos AND w.start_pos + 15 GROUP BY 1, 2, 3, 4) w
GROUP BY 1, 2, 3 HAVING sum(c) >= 0.8::DOUBLE * 16 * count(*) AND min(c) >= 12"""),
)
def _(s: Stages) -> DataFrame:
    return masking.training_windows(s.panel6, 16, 8, 4, 0.8, 0.8, 12)


@query(
    "F13_centered_window",
    sql("manifest scaled span6", f"""SELECT m.case_id, m.site, p.variable, p.pos, p.pos - m.ws AS pos_in, {r('CASE WHEN seen THEN z ELSE 0 END', 'x')}, seen AS mask, true AS valid_time FROM (
SELECT m.*, greatest(0, least((start_pos + end_pos + 1) // 2 - 16, n - 32)) AS ws FROM manifest m JOIN span6 USING (site)) m
JOIN (SELECT * FROM scaled) p ON p.site = m.site AND p.pos BETWEEN m.ws AND m.ws + 31,
LATERAL (SELECT p.z IS NOT NULL AND NOT (list_contains(string_split(m.vars_key, ','), p.variable) AND p.pos BETWEEN m.start_pos AND m.end_pos) AS seen)"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(masking.centered_window(s.manifest, s.scaled, 32, "z"))


@query(
    "F14_pick_middle_case",
    sql("cv panel6 span6 middle", f"""SELECT case_id, site, start_pos, end_pos, {r('coverage', 'coverage')}, n_eligible FROM (
SELECT *, row_number() OVER (ORDER BY site, start_pos, case_id) - 1 AS i, count(*) OVER () AS n_eligible FROM middle) WHERE i = n_eligible // 2"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(masking.pick_middle_case(s.manifest, s.panel6, "C", 2, 12, 4, 0.7))


@query(
    "F15_probe_gaps",
    sql("panel6 span6", f"""SELECT site, masked_vars, gap_len, repeat, arg_min(pos, h) AS start_pos, arg_min(pos, h) + gap_len - 1 AS end_pos FROM (
SELECT t.*, {hsh('42', 'site', 'gap_len', 'repeat', 'pos')} * 4096 + pos AS h FROM (
SELECT site, n, m.v AS masked_vars, g.gap_len, r.repeat, q.pos FROM span6, (SELECT unnest(['click,view', '{",".join(sorted(st.VARIABLES))}']) AS v) m, (SELECT unnest([2, 4])::BIGINT AS gap_len) g,
(SELECT unnest(range(3)) AS repeat) r, (SELECT unnest(range(4096)) AS pos) q WHERE q.pos BETWEEN 24 AND n - g.gap_len - 4 - 1) t
WHERE (SELECT count(q.value) = t.gap_len * len(string_split(t.masked_vars, ',')) FROM panel6 q WHERE q.site = t.site AND list_contains(string_split(t.masked_vars, ','), q.variable)
AND q.pos BETWEEN t.pos AND t.pos + t.gap_len - 1)) GROUP BY 1, 2, 3, 4"""),
)
def _(s: Stages) -> DataFrame:
    probe = lambda masked: masking.probe_gaps(s.panel6, (2, 4), st.LEFT_CTX, 3, masked, 4, st.SEED)
    return probe(["click", "view"]).unionByName(probe(st.VARIABLES))


@query(
    "F16_merged_spans",
    sql("spans", """SELECT case_id, site, variable, end_pos - start_pos + 1 AS hidden_len, run_start, run_end, run_end - run_start + 1 AS run_len, run_start = 0 AS leading,
run_end - run_start > end_pos - start_pos AS extended FROM spans"""),
)
def _(s: Stages) -> DataFrame:
    from gapweave.operators import impute

    return impute.merged_span_report(impute.merged_spans(s.manifest, s.panel6))


@query(
    "F17_context_slices",
    sql("spans panel6", f"""SELECT case_id, variable, c AS context, actual, {r('avg(f)', 'mean_context')}, {r('max(f) FILTER (WHERE pos = last_pos)', 'last_context')}, count(o) AS observed FROM (
SELECT *, count(*) OVER (PARTITION BY case_id, variable, c) AS actual, max(pos) OVER (PARTITION BY case_id, variable, c) AS last_pos,
coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY case_id, variable, c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value(o IGNORE NULLS) OVER (PARTITION BY case_id, variable, c ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f FROM (
SELECT s.case_id, s.variable, k.c, p.pos, p.value AS o FROM spans s, (SELECT unnest([8, 16, 32])::BIGINT AS c) k, panel6 p
WHERE p.site = s.site AND p.variable = s.variable AND p.pos BETWEEN s.run_start - k.c AND s.run_start - 1)) GROUP BY ALL"""),
)
def _(s: Stages) -> DataFrame:
    d = forecast.context_slices(s.spans, s.panel6, (8, 16, 32))
    return rounded(d)

