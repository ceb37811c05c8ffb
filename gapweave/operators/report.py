"""Report tables built from scores, site scores, predictions and run summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.exprs import r6, ratio
from gapweave.functions.ranks import exact_quantiles
from gapweave.operators.masking import hidden_cells, interval_join
from gapweave.operators.quality import abs_changes
from gapweave.operators.resample import bootstrap_means
from gapweave.operators.shape import clip_to_bounds
from gapweave.operators.stats import paired_compare, site_scores, summarize_sites, summary


def duration_weights(scores: DataFrame, model: str) -> DataFrame:
    """Share of each scenario x gap in the site-equal mean: mean over sites of n / total n."""
    q = scores.where(F.col("model") == model)
    tot = q.groupBy("site").agg(F.sum("n_eval").alias("_t"))
    n_sites = tot.agg(F.count(F.lit(1)).alias("_s"))
    g = q.groupBy("site", "scenario", "gap_len").agg(F.count(F.lit(1)).alias("vc"), F.count_distinct("case_id").alias("mc"), F.sum("n_eval").alias("n"))
    g = g.join(tot, "site").crossJoin(n_sites)  # one-row side
    return g.groupBy("scenario", "gap_len").agg(
        F.sum("vc").alias("variable_cases"),
        F.sum("mc").alias("mask_cases"),
        F.count_distinct("site").alias("sites"),
        F.sum("n").alias("evaluated_steps"),
        F.sum(F.col("n") / F.col("_t") / F.col("_s")).alias("overall_weight"),
    )


def equal_case(scores: DataFrame, metric: str = "NMAE") -> DataFrame:
    """Variables equal in a case, cases equal in a site, sites equal in the mean."""
    case = scores.groupBy("model", "site", "case_id").agg(F.avg(metric).alias(metric))
    site = case.groupBy("model", "site").agg(F.avg(metric).alias(metric))
    return site.groupBy("model").agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n_sites"))


def rank_models(sums: DataFrame, subset: Sequence[str], by: Sequence[str] = (), metric: str = "mean") -> DataFrame:
    """Min-rank among all models and inside a named subset."""
    part = [F.col(c) for c in by] or [F.lit(0)]
    member = F.col("model").isin(list(subset))
    overall = F.rank().over(Window.partitionBy(*part).orderBy(metric)).cast("bigint")
    inside = F.when(member, F.rank().over(Window.partitionBy(*part, member).orderBy(metric)).cast("bigint"))
    return sums.withColumns({"rank_all": overall, "in_subset": member, "rank_subset": inside})


def rank_changes(ranks: DataFrame, by: str, base: str, metric: str = "rank_all") -> DataFrame:
    """Models whose rank under another setting differs from the base setting."""
    b = ranks.where(F.col(by) == base).select("model", F.col(metric).alias("base_rank"))
    d = ranks.where(F.col(by) != base).join(b, "model")
    return d.where(F.col(metric) != F.col("base_rank")).select("model", by, "base_rank", F.col(metric).alias("rank"))


def family_winner(sums: DataFrame, families: Mapping[str, Sequence[str]], metric: str = "mean") -> DataFrame:
    fams = [F.when(F.col("model").isin(list(m)), F.lit(f)) for f, m in families.items()]
    d = sums.withColumn("family", F.explode(F.array_compact(F.array(*fams))))
    return d.groupBy("family").agg(F.min_by("model", F.struct(metric, "model")).alias("winner"), F.min(metric).alias("best"))


def column_best(wide_long: DataFrame, column: str, metric: str) -> DataFrame:
    w = Window.partitionBy(column).orderBy(metric)
    return wide_long.withColumn("is_best", F.rank().over(w) == 1)


def select_setting(scores: DataFrame, setting: str, metric: str = "NMAE", by: Sequence[str] = ("model",)) -> tuple[DataFrame, DataFrame]:
    """Mean site score per (by, setting) and the chosen setting: smallest mean, tie -> smaller setting."""
    keys = [*by, setting]
    s = scores.groupBy(*keys, "site").agg(ratio(F.sum(F.col(metric) * F.col("n_eval")), F.sum("n_eval")).alias(metric))
    t = s.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n_sites"))
    part = [F.col(c) for c in by] or [F.lit(0)]
    w = Window.partitionBy(*part).orderBy(F.round("mean", 12), setting)
    best = t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return t, best


def context_curve(scores: DataFrame, setting: str, metric: str = "NMAE", by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean per setting with the minimum flagged and the distance to it in percent."""
    t, best = select_setting(scores, setting, metric, by)
    b = best.select(*by, F.col("mean").alias("_m"), F.col(setting).alias("_c"))
    d = t.join(b, list(by)) if by else t.crossJoin(b)
    return d.select(
        *by, setting, "mean", "n_sites", (F.col(setting) == F.col("_c")).alias("is_minimum"), (100.0 * (ratio(F.col("mean"), F.col("_m")) - 1.0)).alias("relative_percent")
    )


def round_errors(trace: DataFrame, truth: DataFrame, ranges: DataFrame, passes: int) -> DataFrame:
    """MAE and NMAE of every (case_id, site, variable) after rounds 0 to ``passes``, from a trace of changes.

    ``trace`` has ``pred`` of all cells in round 0 and, of later rounds, only of cells that changed, with ``pred_before``. A cell is scored when it changes: its
    error replaces the one before in the running sums, so a round in which nothing moves costs nothing. Cells without a true value do not count; fewer than two give NULL.
    """
    keys = ["case_id", "site", "variable"]
    d = trace.join(truth.where("value is not null").select("site", "variable", "pos", "value"), ["site", "variable", "pos"])
    first, error = F.col("round") == 0, lambda p: F.abs(F.col(p) - F.col("value"))
    change = d.groupBy(*keys, "round").agg(F.sum(F.when(first, error("pred")).otherwise(error("pred") - error("pred_before"))).alias("_e"))
    scored = d.where(first).groupBy(*keys).agg(F.count("pred").alias("n_eval"), (F.max("value") - F.min("value")).alias("truth_range"))
    every = scored.withColumn("round", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(passes).cast("bigint"))))
    w = Window.partitionBy(*keys).orderBy("round")
    d = every.join(change, [*keys, "round"], "left").withColumn("_e", F.sum("_e").over(w)).join(ranges, ["site", "variable"], "left")
    mae = F.when(F.col("n_eval") >= 2, F.col("_e") / F.col("n_eval"))
    scale = F.when(F.col("full_range") > 1e-8, F.col("full_range")).when(F.col("truth_range") > 1e-8, F.col("truth_range"))
    n = F.when(F.col("n_eval") >= 2, F.col("n_eval")).otherwise(F.lit(0)).cast("bigint")
    return d.select(*keys, "round", mae.alias("mae"), ratio(mae, scale).alias("NMAE"), n.alias("n_eval"))


def round_drift(per_round: DataFrame, unit: Sequence[str], metric: str = "mae", draws: int = 1000, seed: int = 42) -> DataFrame:
    """Error of each round relative to round 0 of the same unit (percent): mean, interval, best round."""
    z = per_round.where("round = 0").select(*unit, F.col(metric).alias("_z"))
    d = per_round.join(z, list(unit)).withColumn("drift", 100.0 * (ratio(F.col(metric), F.col("_z")) - 1.0)).where("drift is not null")
    d = d.withColumn("unit", F.concat_ws("|", *[F.col(u).cast("string") for u in unit]))
    g = d.groupBy("round").agg(F.avg("drift").alias("mean_drift"), F.count(F.lit(1)).alias("n_units"))
    b = bootstrap_means(d, ["round"], ["drift"], draws, seed, "unit", many=True).groupBy("round").agg(
        F.percentile("drift", F.lit(0.025)).alias("low"), F.percentile("drift", F.lit(0.975)).alias("high")
    )
    best = g.agg(F.min_by("round", F.struct(F.round("mean_drift", 9), "round")).alias("_b"))
    return g.join(b, "round").crossJoin(best).select("round", "mean_drift", "low", "high", "n_units", (F.col("round") == F.col("_b")).alias("is_best"))


def ablation_steps(per_round: DataFrame, metric: str = "mae") -> DataFrame:
    """Per variable and overall ('ALL'): mean before (round 0) and after (round 1) and the drop in percent."""
    d = per_round.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("variable"))))
    g = d.groupBy("scope").agg(
        F.avg(F.when(F.col("round") == 0, F.col(metric))).alias("before"), F.avg(F.when(F.col("round") == 1, F.col(metric))).alias("after")
    )
    return g.withColumn("drop_percent", 100.0 * (1.0 - ratio(F.col("after"), F.col("before"))))


def final_table(scores: DataFrame, variables: Sequence[str], scenarios: Sequence[str], gaps: Sequence[int]) -> DataFrame:
    """Per model: site-equal mean and sd, then a column per variable, scenario and gap length."""
    base = site_scores(scores).groupBy("model").agg(F.avg("NMAE").alias("mean"), F.stddev_samp("NMAE").alias("sd"))
    out = base
    for col, values in (("variable", variables), ("scenario", scenarios), ("gap_len", gaps)):
        s = site_scores(scores, extra=[col]).groupBy("model", col).agg(F.avg("NMAE").alias("m"))
        p = s.groupBy("model").pivot(col, list(values)).agg(F.first("m"))
        p = p.select("model", *[F.col(f"`{v}`").alias(f"{col}_{v}") for v in values])
        out = out.join(p, "model", "left")
    return out


def residual_strata(cells: DataFrame, panel: DataFrame, thresholds: DataFrame, ranges: DataFrame, zero_variable: str, zero_level: float = 0.0) -> DataFrame:
    """Mean error where the truth changes little or much (training threshold) and at zero / positive truth."""
    ch = abs_changes(panel).select("site", "variable", "pos", F.abs("change").alias("delta"))
    d = cells.join(ch, ["site", "variable", "pos"], "left").join(thresholds.select("variable", "threshold"), "variable").join(ranges, ["site", "variable"])
    z = F.col("variable") == zero_variable
    strata = F.array_compact(
        F.array(
            F.when(F.col("delta") <= F.col("threshold"), F.lit("change_low")),
            F.when(F.col("delta") > F.col("threshold"), F.lit("change_high")),
            F.when(z & (F.col("value") <= zero_level), F.lit("level_zero")),
            F.when(z & (F.col("value") > zero_level), F.lit("level_positive")),
        )
    )
    err = F.abs(F.col("pred") - F.col("value"))
    g = d.withColumn("stratum", F.explode(strata)).groupBy("model", "case_id", "site", "variable", "stratum").agg(
        F.count(F.lit(1)).alias("n_eval"), F.avg(err).alias("MAE"), F.max("full_range").alias("_r")
    )
    return g.withColumn("NMAE", ratio(F.col("MAE"), F.col("_r"))).drop("_r")


def flagged_variable_cases(cases: DataFrame, flags: DataFrame) -> DataFrame:
    """Number of flagged cells (site, variable, pos) inside each hidden variable-case."""
    cells = hidden_cells(cases).join(flags.where("constant_flag").select("site", "variable", "pos"), ["site", "variable", "pos"], "left_semi")
    return cells.groupBy("case_id", "variable").agg(F.count(F.lit(1)).alias("flagged_steps"))


def constant_exclusion(scores: DataFrame, flagged: DataFrame) -> DataFrame:
    """Site-equal means on all variable-cases and without the flagged ones."""
    kept = scores.join(flagged, ["case_id", "variable"], "left_anti")
    both = scores.withColumn("subset", F.lit("all")).unionByName(kept.withColumn("subset", F.lit("exclude_constant")))
    s = site_scores(both, extra=["subset"])
    return s.groupBy("model", "subset").agg(F.avg("NMAE").alias("mean"), F.stddev_samp("NMAE").alias("sd"), F.count("NMAE").alias("n_sites"))


NORMALIZERS = ("full_range_all", "full_range_common", "p01_p99_common")


def normalizer_scores(scores: DataFrame, norms: DataFrame) -> DataFrame:
    """Every variable-case scored under the three normaliser definitions."""
    d = scores.join(norms.select("site", "variable", "full_range", "robust_range", "common_valid"), ["site", "variable"])
    opt = F.array_compact(
        F.array(
            F.struct(F.lit("full_range_all").alias("normalizer"), F.col("full_range").alias("den")),
            F.when(F.col("common_valid"), F.struct(F.lit("full_range_common").alias("normalizer"), F.col("full_range").alias("den"))),
            F.when(F.col("common_valid"), F.struct(F.lit("p01_p99_common").alias("normalizer"), F.col("robust_range").alias("den"))),
        )
    )
    d = d.withColumn("_o", F.explode(opt)).withColumn("normalizer", F.col("_o.normalizer"))
    return d.withColumn("score", ratio(F.col("MAE"), F.col("_o.den"))).drop("_o", "full_range", "robust_range", "common_valid")


def normalizer_sensitivity(scores: DataFrame, norms: DataFrame, subset: Sequence[str], draws: int = 10_000) -> DataFrame:
    """Site-equal mean per normaliser with its bootstrap interval and ranks; the site scores are written once, as ranges of all series stand behind them."""
    from gapweave.plans.storage import materialize

    site = materialize(site_scores(normalizer_scores(scores, norms), "score", ["normalizer"]), "normalizer-sites")
    return rank_models(summarize_sites(site, "score", ["normalizer"], draws), subset, ["normalizer"])


def normalizer_effects(scores: DataFrame, norms: DataFrame, pairs: DataFrame, draws: int = 10_000) -> DataFrame:
    """Paired effects per normaliser, for all variables together and each one."""
    from gapweave.plans.storage import materialize

    s = normalizer_scores(scores, norms).withColumn("scope", F.explode(F.array(F.lit("all"), F.col("variable"))))
    site = materialize(site_scores(s, "score", ["normalizer", "scope"]), "normalizer-sites")
    return paired_compare(site, pairs, "score", ["normalizer", "scope"], draws)


def prediction_bounds(cells: DataFrame, bounds: Mapping[str, tuple[float, float]], tol: float = 1e-6) -> DataFrame:
    """Violations of the physical bounds per model x variable; rates pooled and site-equal, excess sizes."""
    lo = F.coalesce(*[F.when(F.col("variable") == v, F.lit(float(b[0]))) for v, b in bounds.items()])
    hi = F.coalesce(*[F.when(F.col("variable") == v, F.lit(float(b[1]))) for v, b in bounds.items()])
    p = F.col("pred")
    finite = p.isNotNull() & ~F.isnan(p)
    below, above = finite & (p < lo - tol), finite & (p > hi + tol)
    d = cells.withColumns(
        {"_b": below, "_a": above, "_f": finite, "_x": F.when(below | above, F.greatest(lo - p, p - hi)), "_lo": lo}
    )
    zero = F.col("value") == 0
    g = d.groupBy("model", "variable").agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.count_if("_b").alias("below_lower"),
        F.count_if("_a").alias("above_upper"),
        F.count_if(~F.col("_f")).alias("nonfinite"),
        F.min("pred").alias("minimum_prediction"),
        F.max("pred").alias("maximum_prediction"),
        F.count_if(zero).alias("zero_truth"),
        F.count_if(zero & F.col("_b")).alias("below_on_zero_truth"),
        F.count_if(p < F.col("_lo") - 1).alias("below_by_1"),
        F.count_if(p < F.col("_lo") - 5).alias("below_by_5"),
        F.count_if(p < F.col("_lo") - 10).alias("below_by_10"),
        (F.count_if(F.col("_b") | F.col("_a")) / F.count(F.lit(1))).alias("pooled_fraction"),
        F.coalesce(F.avg("_x"), F.lit(0.0)).alias("mean_excess"),
        F.coalesce(F.max("_x"), F.lit(0.0)).alias("max_excess"),
    )
    site = d.groupBy("model", "variable", "site").agg((F.count_if(F.col("_b") | F.col("_a")) / F.count(F.lit(1))).alias("_r"))
    rate = site.groupBy("model", "variable").agg(F.avg("_r").alias("site_equal_fraction"))
    size = exact_quantiles(d, ["model", "variable"], F.col("_x"), {"median_excess": 0.5, "p95_excess": 0.95}).drop("_n")
    return g.join(rate, ["model", "variable"]).join(size, ["model", "variable"], "left").fillna(0.0, ["median_excess", "p95_excess"])


def clipping_scores(cells: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """MAE of each variable-case before and after clipping predictions to the bounds."""
    d = clip_to_bounds(cells.withColumn("_c", F.col("pred")), bounds, "_c")
    return d.groupBy("model", "case_id", "site", "variable").agg(
        F.count(F.lit(1)).alias("n_eval"),
        F.avg(F.abs(F.col("pred") - F.col("value"))).alias("original_MAE"),
        F.avg(F.abs(F.col("_c") - F.col("value"))).alias("clipped_MAE"),
    )


def clipping_sensitivity(cells: DataFrame, bounds: Mapping[str, tuple[float, float]], norms: DataFrame) -> DataFrame:
    """Site-equal normalised means of original and clipped outputs under both normalisers, with ranks."""
    d = clipping_scores(cells, bounds).join(norms.where("common_valid").select("site", "variable", "full_range", "robust_range"), ["site", "variable"])
    opts = [
        F.struct(F.lit(o).alias("outputs"), F.lit(n).alias("normalizer"), ratio(F.col(c), F.col(r)).alias("score"))
        for o, c in (("original", "original_MAE"), ("clipped", "clipped_MAE"))
        for n, r in (("full_range_common", "full_range"), ("p01_p99_common", "robust_range"))
    ]
    d = d.withColumn("_o", F.explode(F.array(*opts))).select("model", "site", "n_eval", "_o.*")
    s = site_scores(d, "score", ["outputs", "normalizer"])
    t = s.groupBy("model", "outputs", "normalizer").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("sd"), F.count("score").alias("n_sites"))
    w = Window.partitionBy("outputs", "normalizer").orderBy("mean")
    return t.withColumn("rank", F.rank().over(w).cast("bigint"))


def pareto(points: DataFrame, cost: str, loss: str, keys: Sequence[str] = (), buckets: int = 4096) -> DataFrame:
    """Non-dominated (cost, loss) points by a running minimum, not by comparing pairs.

    A point stays if no other point is at most as costly and at most as bad, and better in one. The
    running minimum of the loss goes over cost buckets first and over distinct costs inside a bucket
    second, so no task orders a whole group. ``envelope`` is the best loss at that cost or below;
    the knee is the front point nearest to the ideal corner after scaling both axes to [0, 1].
    """
    grp = list(keys)
    lim = points.groupBy(*grp).agg(F.min(cost).alias("_c0"), F.max(cost).alias("_c1"), F.min(loss).alias("_l0"), F.max(loss).alias("_l1"))
    pts = points.join(lim, grp) if grp else points.crossJoin(lim)  # without keys the limits are one row
    width = F.coalesce(ratio(F.col(cost) - F.col("_c0"), F.col("_c1") - F.col("_c0")), F.lit(0.0))
    pts = pts.withColumn("_bk", F.least(F.floor(width * buckets), F.lit(buckets - 1)))
    lead = [*grp, "_bk"]
    part = [F.col(k) for k in grp] or [F.lit(0)]
    best = pts.groupBy(*lead, cost).agg(F.min(loss).alias("_m"))
    inside = Window.partitionBy(*lead).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_in", F.min("_m").over(inside))
    across = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    tops = best.groupBy(*lead).agg(F.min("_m").alias("_t"))
    tops = tops.select(*lead, F.min("_t").over(across).alias("_before"))
    best = best.join(tops, lead).withColumn("_cheaper", F.least("_in", "_before")).select(*lead, cost, "_m", "_cheaper")
    d = pts.join(best, [*lead, cost])
    front = (F.col(loss) == F.col("_m")) & (F.col("_cheaper").isNull() | (F.col(loss) < F.col("_cheaper")))
    nx = F.coalesce(ratio(F.col(cost) - F.col("_c0"), F.col("_c1") - F.col("_c0")), F.lit(0.0))
    ny = F.coalesce(ratio(F.col(loss) - F.col("_l0"), F.col("_l1") - F.col("_l0")), F.lit(0.0))
    d = d.withColumns({"on_front": front, "envelope": F.least("_m", "_cheaper"), "distance": F.sqrt(nx * nx + ny * ny)})
    near = F.struct(F.round("distance", 9), F.col(cost), F.col(loss))
    knee = d.where("on_front").groupBy(*grp).agg(F.min(near).alias("_k"))
    d = d.join(knee, grp) if grp else d.crossJoin(knee)
    return d.select(*points.columns, "on_front", "envelope", "distance", (F.col("on_front") & (near == F.col("_k"))).alias("is_knee"))


def context_ablation_summary(runs: DataFrame) -> DataFrame:
    """Mean scores and evaluated cells per model and context; with the mean of measured ``seconds`` where runs carry them."""
    timing = [F.avg("seconds").alias("mean_seconds")] if "seconds" in runs.columns else []
    return runs.groupBy("model", "context").agg(F.avg("NMAE").alias("mean_nmae"), F.avg("MAE").alias("mean_mae"), *timing, F.sum("n_eval").alias("n_eval"))


def basic_summaries(scores: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Mean MSE, MAE and NMAE and total n for each single label column, one long table."""
    lab = F.array(*[F.struct(F.lit(c).alias("by"), F.col(c).cast("string").alias("label")) for c in labels])
    d = scores.withColumn("_l", F.explode(lab)).select("model", "_l.by", "_l.label", "MSE", "MAE", "NMAE", "n_eval")
    return d.groupBy("model", "by", "label").agg(
        r6(F.avg("MSE"), 5).alias("MSE"), r6(F.avg("MAE"), 5).alias("MAE"), r6(F.avg("NMAE"), 5).alias("NMAE"), F.sum("n_eval").alias("n_eval")
    )


def area_bins(area: Column) -> Column:
    """Fixed floor-area bins."""
    return F.when(area <= 2000, "0-2000").when(area <= 6000, "2000-6000").when(area > 6000, "6000+")


def metadata_strata(site: DataFrame, meta: DataFrame, metric: str = "NMAE") -> DataFrame:
    """Mean score by area bin, area tertile (median split when the cut points tie) and structure type."""
    q = exact_quantiles(meta.withColumn("_all", F.lit(0)), ["_all"], F.col("area"), {"q1": 1 / 3, "q2": 2 / 3, "med": 0.5, "mn": 0.0, "mx": 1.0}).drop("_all", "_n")
    a = F.col("area")
    tied = (F.col("q1") <= F.col("mn")) | (F.col("q2") >= F.col("mx")) | (F.col("q1") == F.col("q2"))
    tertile = (
        F.when(tied, F.when(a <= F.col("med"), "small").otherwise("large"))
        .when(a <= F.col("q1"), "small")
        .when(a <= F.col("q2"), "medium")
        .otherwise("large")
    )
    m = meta.crossJoin(q)  # one-row side
    s = lambda t, c: F.struct(F.lit(t).alias("stratum_type"), c.alias("stratum"))
    d = site.join(m, "site").withColumn("_s", F.explode(F.array(s("area_bin", area_bins(a)), s("area_tertile", tertile), s("structure", F.col("structure")))))
    return d.groupBy("model", "_s.stratum_type", "_s.stratum").agg(F.avg(metric).alias("mean"), F.count(metric).alias("n_sites"))


def representative_site(site: DataFrame, metric: str = "NMAE") -> DataFrame:
    """Per model the site whose score is nearest to the model's mean."""
    m = site.groupBy("model").agg(F.avg(metric).alias("mean_score"))
    d = site.join(m, "model").withColumn("gap_to_mean", F.abs(F.col(metric) - F.col("mean_score")))
    return d.groupBy("model").agg(
        F.min_by("site", F.struct(F.round("gap_to_mean", 9), "site")).alias("representative"), F.max("mean_score").alias("mean_score"), F.min("gap_to_mean").alias("distance")
    )


def delta_vs_best(strata: DataFrame, model: str, by: Sequence[str], metric: str = "mean") -> DataFrame:
    """Per stratum: the model's score minus the best of the others."""
    mine = strata.where(F.col("model") == model).select(*by, F.col(metric).alias("model_mean"))
    rest = strata.where(F.col("model") != model).groupBy(*by).agg(
        F.min(metric).alias("best_other"), F.min_by("model", F.struct(metric, "model")).alias("best_other_model")
    )
    return mine.join(rest, list(by)).withColumn("delta", F.col("model_mean") - F.col("best_other"))


def common_site_contrast(scores: DataFrame, a: str, b: str, variables: Sequence[str]) -> DataFrame:
    """Scenario means on the sites that have both scenarios."""
    d = scores.where(F.col("scenario").isin(a, b) & F.col("variable").isin(list(variables)))
    both = d.groupBy("site").agg(F.count_distinct("scenario").alias("_n")).where("_n = 2").select("site")
    s = site_scores(d.join(both, "site", "left_semi"), extra=["scenario"])
    return s.groupBy("model", "scenario").agg(F.avg("NMAE").alias("mean"), F.count("NMAE").alias("n_sites"))


def compare_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    d = a.select(*keys, F.col(metric).alias("_a")).join(b.select(*keys, F.col(metric).alias("_b")), list(keys))
    x = F.abs(F.col("_a") - F.col("_b"))
    return d.agg(F.count(F.lit(1)).alias("matched"), F.max(x).alias("max_abs_difference"), F.avg(x).alias("mean_abs_difference"))


def gap_band(scores: DataFrame, metric: str = "NMAE") -> DataFrame:
    """Mean and sd over the site x repeat population by scenario, variable, model and gap."""
    return scores.groupBy("scenario", "variable", "model", "gap_len").agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(metric).alias("n")
    )


def panel_metrics(cells: DataFrame, panel_keys: Sequence[str], main: str) -> DataFrame:
    """R2 (1 when residual and total are both 0, 0 when only the total is) and MAE per panel; best baseline by MAE."""
    v, p = F.col("value"), F.col("pred")
    sse = F.sum((v - p) * (v - p))
    tot = F.sum(v * v) - F.count(v) * F.avg(v) * F.avg(v)
    flat = tot <= 1e-9
    g = cells.groupBy(*panel_keys, "model").agg(
        F.when(flat & (sse == 0), F.lit(1.0)).when(flat, F.lit(0.0)).otherwise(1.0 - F.try_divide(sse, tot)).alias("R2"), F.avg(F.abs(v - p)).alias("MAE")
    )
    best = g.where(F.col("model") != main).groupBy(*panel_keys).agg(F.min_by("model", F.struct(F.round("MAE", 9), "model")).alias("best_baseline"))
    return g.join(best, list(panel_keys), "left")


def scoped_scores(scores: DataFrame, one_gap: int, limit: int) -> DataFrame:
    """Rows tagged with every scope they belong to: all, one gap length, gaps up to a limit."""
    scopes = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("gap_len") == one_gap, F.lit(f"gap_{one_gap}")),
            F.when(F.col("gap_len") <= limit, F.lit(f"gap_le_{limit}")),
        )
    )
    return scores.withColumn("scope", F.explode(scopes))


def scoped_summary(scores: DataFrame, one_gap: int, limit: int, draws: int = 10_000) -> DataFrame:
    return summary(scoped_scores(scores, one_gap, limit), "NMAE", ["scope"], draws)


def scoped_compare(scores: DataFrame, pairs: DataFrame, one_gap: int, limit: int, draws: int = 10_000) -> DataFrame:
    site = site_scores(scoped_scores(scores, one_gap, limit), "NMAE", ["scope"])
    return paired_compare(site, pairs, "NMAE", ["scope"], draws)


def case_differences(scores: DataFrame, a: str, b: str, metric: str = "NMAE") -> DataFrame:
    m = lambda x: F.max(F.when(F.col("model") == x, F.col(metric)))
    g = scores.groupBy("case_id", "site", "variable").agg(m(a).alias("a"), m(b).alias("b"))
    return g.select("case_id", "site", "variable", "a", "b", (F.col("a") - F.col("b")).alias("difference"))


def example_window(case: DataFrame, panel: DataFrame, cells: DataFrame, before: int = 72, after: int = 24) -> DataFrame:
    """Truth, predictions, hidden flag and offset from the gap start around the given case(s)."""
    iv = case.select("case_id", "site", "masked_vars", "start_pos", "end_pos").withColumns(
        {"_lo": F.greatest(F.col("start_pos") - before, F.lit(0)), "_hi": F.col("end_pos") + after}
    )
    d = interval_join(iv, panel.select("site", "variable", "pos", "ts", "value"), "_lo", "_hi")
    d = d.where(F.array_contains("masked_vars", F.col("variable")))
    hidden = F.col("pos").between(F.col("start_pos"), F.col("end_pos"))
    d = d.select("case_id", "site", "variable", "pos", "ts", F.col("value").alias("truth"), hidden.alias("hidden"), (F.col("pos") - F.col("start_pos")).alias("steps_from_gap"))
    p = cells.select("case_id", "variable", "pos", "model", "pred")
    return d.join(p, ["case_id", "variable", "pos"], "left")


def pooled_fit(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    v, p = F.col("value"), F.col("pred")
    n = F.count(v)
    sse = F.sum((v - p) * (v - p))
    tot = F.sum(v * v) - n * F.avg(v) * F.avg(v)
    return cells.groupBy(*by).agg(n.alias("n"), F.sqrt(sse / n).alias("RMSE"), F.when(tot > 1e-12, 1.0 - F.try_divide(sse, tot)).alias("R2"))
