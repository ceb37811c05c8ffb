"""Queries for spike detection (I) and integrity checks (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators import forecast, impute, integrity, references, scaling, spikes
from gapweave.plans import stages as st
from gapweave.plans.ctes import PRF, PRF_OUT, r, sql
from gapweave.plans.queries_prepare import rounded
from gapweave.plans.registry import query
from gapweave.plans.stages import Stages
from gapweave.plans.storage import materialize

TAUS = (2.0, 3.0, 3.5, 5.0, 8.0)
ROC_TAUS = (0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 1e9)


def linear_panel(d: DataFrame, value: str, out: str) -> DataFrame:
    return impute.impute_linear(d, value, out)


def seasonal_panel(d: DataFrame, value: str, out: str) -> DataFrame:
    return impute.impute_seasonal(d, st.SEASON, 16, value, out)


def _stage(s: Stages, name: str, build) -> DataFrame:
    """A stage table of this module, kept with the others on the stages object."""
    if name not in s.__dict__:
        s.__dict__[name] = materialize(build(), name)
    return s.__dict__[name]


def injected(s: Stages) -> DataFrame:
    return _stage(s, "injected", lambda: spikes.inject_spikes(s.panel6, 6, st.SEED))


def residuals(s: Stages) -> DataFrame:
    def build() -> DataFrame:
        marks = injected(s).select("site", "variable", "pos", "injected")
        parts = [
            spikes.scan_residuals(injected(s), fn, 4).withColumn("model", F.lit(m))
            for m, fn in (("linear", linear_panel), ("seasonal", seasonal_panel))
        ]
        return parts[0].unionByName(parts[1]).join(marks, ["site", "variable", "pos"])

    return _stage(s, "residuals", build)


def zscores(s: Stages) -> DataFrame:
    return _stage(s, "zscores", lambda: spikes.mad_zscore(residuals(s), ["model", "site", "variable"]))


@query("I1_scan_residuals", sql("resid", f"SELECT model, site, variable, pos, {r('recon', 'recon')}, {r('residual', 'residual')} FROM resid"))
def _(s: Stages) -> DataFrame:
    return rounded(residuals(s).select("model", "site", "variable", "pos", "recon", "residual"))


@query("I2_mad_zscore", sql("zs", f"SELECT model, site, variable, pos, {r('z', 'z')} FROM zs"))
def _(s: Stages) -> DataFrame:
    return rounded(zscores(s).select("model", "site", "variable", "pos", "z"))


@query("I3_spike_flag", sql("flags", "SELECT model, site, variable, pos, flag FROM flags"))
def _(s: Stages) -> DataFrame:
    return spikes.spike_flag(zscores(s)).select("model", "site", "variable", "pos", "flag")


@query("I4_consensus", sql("flags", f"SELECT site, variable, pos, {r('avg(CASE WHEN flag THEN 1 ELSE 0 END)', 'consensus')}, count(*) AS n_models, avg(CASE WHEN flag THEN 1 ELSE 0 END) >= 0.5 AS reported FROM flags GROUP BY 1, 2, 3"))
def _(s: Stages) -> DataFrame:
    return rounded(spikes.consensus(spikes.spike_flag(zscores(s))))


@query("I5_inject_spikes", sql("inj", f"SELECT site, variable, pos, {r('value', 'value')}, injected, {r('true_value', 'true_value')} FROM inj"))
def _(s: Stages) -> DataFrame:
    return rounded(spikes.inject_spikes(s.panel6, 6, st.SEED).drop("ts"))


@query("I6_detection_prf", sql("flags", f"SELECT model, site, variable, {PRF_OUT} FROM (SELECT model, site, variable, {PRF.format(f='flag')} FROM flags GROUP BY 1, 2, 3)"))
def _(s: Stages) -> DataFrame:
    return rounded(spikes.detection_prf(spikes.spike_flag(zscores(s)), ["model", "site", "variable"]))


_TAU_VALUES = ", ".join(f"({t}::DOUBLE)" for t in TAUS)


@query(
    "I7_tau_sweep",
    sql("zs", f"SELECT model, variable, tau, {PRF_OUT} FROM (SELECT model, variable, tau, {PRF.format(f='coalesce(z > tau, false)')} FROM zs, (VALUES {_TAU_VALUES}) t(tau) GROUP BY 1, 2, 3)"),
)
def _(s: Stages) -> DataFrame:
    return rounded(spikes.tau_sweep(zscores(s), TAUS, ["model", "variable"]).drop("n_clean"))


@query(
    "I7_tau_sweep_pooled",
    sql("zs", f"SELECT model, tau, {PRF_OUT} FROM (SELECT model, tau, {PRF.format(f='coalesce(z > tau, false)')} FROM zs, (VALUES {_TAU_VALUES}) t(tau) GROUP BY 1, 2)"),
)
def _(s: Stages) -> DataFrame:
    return rounded(spikes.tau_sweep(zscores(s), TAUS, ["model"]).drop("n_clean"))


def _restored(s: Stages) -> DataFrame:
    flags = spikes.spike_flag(zscores(s).where("model = 'linear'"))
    return spikes.restore_flagged(injected(s), flags, linear_panel)


@query("I8_restore_flagged", sql("restored", f"SELECT site, variable, pos, fl AS was_flagged, {r('restored', 'restored')} FROM restored"))
def _(s: Stages) -> DataFrame:
    return rounded(_restored(s).select("site", "variable", "pos", "was_flagged", "restored"))


@query(
    "I8_restore_consensus",
    sql("flags inj restored", """, c AS (SELECT site, variable, pos FROM flags GROUP BY 1, 2, 3 HAVING avg(CASE WHEN flag THEN 1 ELSE 0 END) >= 0.5)
SELECT i.site, i.variable, count(c.pos) AS n_flagged, count(*) AS positions FROM inj i LEFT JOIN c USING (site, variable, pos) GROUP BY 1, 2"""),
)
def _(s: Stages) -> DataFrame:
    c = spikes.consensus(spikes.spike_flag(zscores(s))).withColumn("flag", F.col("reported"))
    d = spikes.restore_flagged(injected(s), c, linear_panel)
    return d.groupBy("site", "variable").agg(F.count_if("was_flagged").alias("n_flagged"), F.count(F.lit(1)).alias("positions"))


@query(
    "I9_restoration_error",
    sql("restored", f"SELECT site, variable, {r('avg(abs(value - true_value))', 'mae_before')}, {r('avg(abs(restored - true_value))', 'mae_after')}, count(*) AS n FROM restored WHERE injected GROUP BY 1, 2"),
)
def _(s: Stages) -> DataFrame:
    return rounded(spikes.restoration_error(_restored(s), ["site", "variable"]))


_ROC_VALUES = ", ".join(f"({t}::DOUBLE)" for t in ROC_TAUS)


@query(
    "I10_roc_auc",
    sql("zs", f"""SELECT model, {r('sum((fpr - lf) * (tpr + lt) / 2)', 'auc')}, count(*) AS n_points FROM (
SELECT *, lag(fpr) OVER w AS lf, lag(tpr) OVER w AS lt FROM (SELECT model, tau, count(*) FILTER (WHERE z > tau AND NOT injected) / count(*) FILTER (WHERE NOT injected) AS fpr,
count(*) FILTER (WHERE z > tau AND injected) / count(*) FILTER (WHERE injected) AS tpr FROM zs, (VALUES {_ROC_VALUES}) t(tau) GROUP BY 1, 2) WINDOW w AS (PARTITION BY model ORDER BY fpr, tpr)) GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    return rounded(spikes.roc_auc(zscores(s), ROC_TAUS, ["model"]))


@query(
    "I10_restoration_in_sd",
    sql("restored panel6", f"SELECT variable, {r('avg(e / sd)', 'mean_error_in_sd')} FROM (SELECT site, variable, avg(abs(restored - true_value)) AS e FROM restored WHERE injected GROUP BY 1, 2) JOIN (SELECT site, variable, stddev_samp(value) AS sd FROM panel6 GROUP BY 1, 2) USING (site, variable) GROUP BY 1"),
)
def _(s: Stages) -> DataFrame:
    e = spikes.restoration_error(_restored(s), ["site", "variable"])
    sd = s.panel6.groupBy("site", "variable").agg(F.stddev_samp("value").alias("sd"))
    d = e.join(sd, ["site", "variable"])
    return rounded(d.groupBy("variable").agg(F.avg(F.try_divide("mae_after", "sd")).alias("mean_error_in_sd")))


# ------------------------------------------------------------------ J integrity


@query(
    "J1_check_manifest",
    sql("manifest hid panel6", """SELECT m.case_id, count(*) FILTER (WHERE p.value IS NULL) AS unobserved_cells, count(*) AS hidden_cells, any_value(m.end_pos - m.start_pos + 1 = m.gap_len) AS length_ok,
any_value(epoch_us(m.end_ts) - epoch_us(m.start_ts) = (m.gap_len - 1) * 21600000000) AS elapsed_ok, any_value(m.start_pos >= 24) AS context_ok, count(*) = any_value(m.gap_len * m.n_vars) AS cells_ok
FROM manifest m JOIN hid h USING (case_id) LEFT JOIN panel6 p ON p.site = h.site AND p.variable = h.variable AND p.pos = h.pos GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    return integrity.check_manifest(s.manifest, s.panel6, st.LEFT_CTX, st.STEP6)


@query("J2_check_scalers", sql("scaler", f"SELECT variable, {r('lo', 'lo')}, {r('hi', 'hi')}, n_obs, true AS identical FROM scaler"))
def _(s: Stages) -> DataFrame:
    return rounded(integrity.check_scalers(s.scaler, scaling.fit_minmax(s.panel6, "pooled_prefix", 0.8, s.roles)))


@query("J2_check_scalers_altered", sql("scaler", f"SELECT variable, {r("CASE WHEN variable = 'error' THEN lo + 1 ELSE lo END", 'lo')}, {r('hi', 'hi')}, n_obs, variable <> 'error' AND variable <> 'view' AS identical FROM scaler WHERE variable <> 'view' UNION ALL SELECT variable, NULL, NULL, 0, false FROM scaler WHERE variable = 'view'"))
def _(s: Stages) -> DataFrame:
    """A stored scaler with one bound moved and one variable lost: both are told."""
    stored = s.scaler.where("variable <> 'view'").withColumn("lo", F.when(F.col("variable") == "error", F.col("lo") + 1).otherwise(F.col("lo")))
    d = integrity.check_scalers(stored, scaling.fit_minmax(s.panel6, "pooled_prefix", 0.8, s.roles))
    return rounded(d.withColumn("n_obs", F.coalesce("n_obs", F.lit(0))))


@query(
    "J3_check_split",
    sql("roles6", "SELECT count(*) FILTER (WHERE role = 'train') AS train_sites, count(*) FILTER (WHERE role = 'test') AS test_sites, count(*) - count(DISTINCT site) AS shared_ids, 0::BIGINT AS shared_content FROM roles6"),
)
def _(s: Stages) -> DataFrame:
    return integrity.check_split(s.panel6, s.roles)


@query(
    "J4_check_coverage",
    sql("scores cv", """SELECT model, (SELECT count(*) FROM cv) - count(DISTINCT (case_id, variable)) AS missing_keys, 0::BIGINT AS unexpected_keys, count(*) - count(DISTINCT (case_id, variable)) AS duplicate_keys,
CAST(count(*) FILTER (WHERE MAE IS NULL) AS BIGINT) AS null_scores, 0::BIGINT AS uneven_n_eval, count(*) AS keys FROM scores GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    return integrity.check_coverage(s.scores, s.manifest)


@query(
    "J4_check_coverage_altered",
    sql("scores cv", """SELECT model, count(*) FILTER (WHERE case_id % 7 = 0 AND model = 'ridge') AS missing_keys, count(*) FILTER (WHERE case_id % 11 = 1 AND model = 'linear') AS unexpected_keys,
count(*) FILTER (WHERE case_id % 5 = 2 AND model = 'seasonal') AS duplicate_keys, count(*) FILTER (WHERE case_id % 3 = 1 AND model = 'bidir') * 1 + count(*) FILTER (WHERE MAE IS NULL AND NOT (case_id % 7 = 0 AND model = 'ridge') AND NOT (case_id % 3 = 1 AND model = 'bidir'))
+ count(*) FILTER (WHERE MAE IS NULL AND ((case_id % 11 = 1 AND model = 'linear') OR (case_id % 5 = 2 AND model = 'seasonal'))) AS null_scores, count(*) FILTER (WHERE case_id % 13 = 4) AS uneven_n_eval,
count(*) FILTER (WHERE NOT (case_id % 7 = 0 AND model = 'ridge')) + count(*) FILTER (WHERE case_id % 11 = 1 AND model = 'linear') AS keys
FROM (SELECT * FROM scores) GROUP BY 1""".replace("count(*) FILTER (WHERE case_id % 13 = 4)", "count(*) FILTER (WHERE case_id % 13 = 4 AND NOT (case_id % 7 = 0 AND model = 'ridge'))")),
)
def _(s: Stages) -> DataFrame:
    """Scores with keys lost, made up and repeated, errors lost and counts changed: each is counted under its own name."""
    d = s.scores
    lost = (F.col("case_id") % 7 == 0) & (F.col("model") == "ridge")
    made_up = d.where("case_id % 11 = 1 and model = 'linear'").withColumn("case_id", -F.col("case_id") - 1)
    twice = d.where("case_id % 5 = 2 and model = 'seasonal'")
    d = d.where(~lost).withColumn("MAE", F.when((F.col("case_id") % 3 == 1) & (F.col("model") == "bidir"), F.lit(None)).otherwise(F.col("MAE")))
    d = d.withColumn("n_eval", F.when((F.col("case_id") % 13 == 4) & (F.col("model") == "linear"), F.col("n_eval") + 1).otherwise(F.col("n_eval")))
    return integrity.check_coverage(d.unionByName(made_up).unionByName(twice), s.manifest)


def _runs(s: Stages) -> dict:
    spans: list[tuple[DataFrame, DataFrame, DataFrame]] = []

    def spans_of(cases: DataFrame, panel: DataFrame) -> DataFrame:
        """Written once for the fills that run on the same cases and panel."""
        for c, p, d in spans:
            if c is cases and p is panel:
                return d
        spans.append((cases, panel, materialize(impute.merged_spans(cases, panel, "z"), "check_spans")))
        return spans[-1][2]

    def linear(cases: DataFrame, panel: DataFrame) -> DataFrame:
        return impute.case_linear(spans_of(cases, panel))

    def seasonal(cases: DataFrame, panel: DataFrame) -> DataFrame:
        return impute.case_seasonal(spans_of(cases, panel), panel, st.SEASON, st.SEASON_CTX, "z")

    def bidir(cases: DataFrame, panel: DataFrame) -> DataFrame:
        spans = spans_of(cases, panel)
        fc = forecast.seasonal_mean(st.SEASON)
        return forecast.bidirectional_init(spans, impute.impute_linear(panel, "z", "zf"), fc, st.CONTEXT, st.MIN_SIDE, "zf")

    def ridge(cases: DataFrame, panel: DataFrame) -> DataFrame:
        spans = spans_of(cases, panel)
        chosen = materialize(references.select_references(spans, panel, s.roles, "z", 3, st.MIN_COVERAGE, st.MIN_PAIRS), "check_refs")
        return references.case_ridge(spans, chosen, panel, "z", 1.0, st.MIN_PAIRS)

    return {"linear": linear, "seasonal": seasonal, "bidir": bidir, "ridge": ridge}


def _union_checks(s: Stages, check) -> DataFrame:
    out = None
    for name, run in _runs(s).items():
        d = check(run).withColumn("model", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


_INV = "SELECT m.model, (SELECT count(*) FROM hid JOIN manifest USING (case_id) WHERE {w}) AS cells, 0::BIGINT AS unmatched, 0.0::DOUBLE AS max_abs_difference FROM (SELECT unnest(['linear', 'seasonal', 'bidir', 'ridge']) AS model) m"


@query("J5_poison_invariance", sql("hid manifest", _INV.format(w="true")))
def _(s: Stages) -> DataFrame:
    """The hidden truth is replaced in the panel the fill reads; nothing may move. Ridge reads whole series, so every case has its own copy anyway, and the other fills run on them too."""
    copies = integrity.poisoned(s.manifest, s.scaled, "z", 1e3)
    out = None
    for name, run in _runs(s).items():
        d = integrity.poison_invariance(s.manifest, s.scaled, run, "z", 1e3, copies=copies).withColumn("model", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return rounded(out)


@query("J6_order_invariance", sql("hid manifest", _INV.format(w="true")))
def _(s: Stages) -> DataFrame:
    return rounded(_union_checks(s, lambda run: integrity.order_invariance(s.manifest, s.scaled, run)))


@query("J7_observed_preserved", sql("panel3", "SELECT variable, count(value) AS observed_cells, 0.0::DOUBLE AS max_abs_change, 0::BIGINT AS lost FROM panel3 GROUP BY 1"))
def _(s: Stages) -> DataFrame:
    return rounded(integrity.observed_preserved(s.panel3, impute.impute_seasonal(s.panel3, 8, 16), "value", "filled"))


@query(
    "J8_truth_audit",
    sql("hid scr6 panel6", """, e AS (SELECT site, variable, min(value) AS m0, max(value) AS m1 FROM scr6 GROUP BY 1, 2),
k AS (SELECT site, variable, any_value(m0) AS m0, any_value(m1) AS m1, count(*) FILTER (WHERE value = m0) AS k0, count(*) FILTER (WHERE value = m1) AS k1 FROM scr6 JOIN e USING (site, variable) GROUP BY 1, 2)
SELECT h.case_id, h.site, h.variable, count(*) FILTER (WHERE s.value IS NOT NULL AND p.value IS NULL) AS not_raw_observed, count(*) FILTER (WHERE s.value = k.m0) = any_value(k.k0) AS moves_min,
count(*) FILTER (WHERE s.value = k.m1) = any_value(k.k1) AS moves_max FROM hid h JOIN scr6 s USING (site, variable, pos) JOIN panel6 p USING (site, variable, pos) JOIN k USING (site, variable) GROUP BY 1, 2, 3"""),
)
def _(s: Stages) -> DataFrame:
    """Processed values here are limited fills of the raw panel, so some evaluated cells could be fills."""
    filled = impute.impute_linear_limited(s.panel6, 3).select("site", "variable", "pos", F.col("filled").alias("value"))
    return integrity.truth_audit(s.manifest, s.panel6, filled)


@query(
    "J9_rescore",
    sql("scores cellsx ranges", "SELECT model, count(*) AS variable_cases, 0::BIGINT AS n_eval_mismatches, true AS mae_reconciled, true AS nmae_reconciled FROM scores GROUP BY 1"),
)
def _(s: Stages) -> DataFrame:
    return integrity.rescore(s.cells, s.scores, s.ranges)


@query(
    "J9_rescore_altered",
    sql("scores cellsx ranges", """SELECT model, count(*) AS variable_cases, count(*) FILTER (WHERE model = 'ridge' AND case_id % 4 = 1) AS n_eval_mismatches, model <> 'linear' AS mae_reconciled, model <> 'seasonal' AS nmae_reconciled FROM scores GROUP BY 1"""),
)
def _(s: Stages) -> DataFrame:
    """Stored scores with one column moved a model: the check must name it."""
    move = lambda c, m, by: F.when(F.col("model") == m, F.col(c) + by).otherwise(F.col(c))
    n = F.when((F.col("model") == "ridge") & (F.col("case_id") % 4 == 1), F.col("n_eval") + 1).otherwise(F.col("n_eval"))
    return integrity.rescore(s.cells, s.scores.withColumns({"MAE": move("MAE", "linear", 0.01), "NMAE": move("NMAE", "seasonal", 0.001), "n_eval": n}), s.ranges)
