"""Missingness, run, profile and correlation operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import hash_order, pearson, ratio
from gapweave.functions.ranks import exact_quantiles
from gapweave.operators.series import CHUNK, SERIES, carry, lowest_per_group, observed_neighbours, prefix_sums, shift


def find_gaps(panel: DataFrame, value: str = "value", size: int = CHUNK) -> DataFrame:
    """Maximal missing runs: site, variable, start_pos, end_pos (inclusive), n (series length)."""
    d = observed_neighbours(panel, value=value, size=size)
    n = panel.groupBy(*SERIES).agg((F.max("pos") + 1).alias("n"))
    first = F.col("pos") == F.coalesce(F.col("prev_pos"), F.lit(-1)) + 1
    return (
        d.where(F.col(value).isNull() & first)
        .join(n, list(SERIES))
        .select(*SERIES, F.col("pos").alias("start_pos"), (F.coalesce("next_pos", "n") - 1).alias("end_pos"), "n")
    )


def any_variable_gaps(panel: DataFrame, size: int = CHUNK) -> DataFrame:
    """Runs of positions at which at least one variable is missing."""
    rows = panel.groupBy("site", "pos").agg(F.when(F.count("value") == F.count(F.lit(1)), F.lit(1.0)).alias("value"))
    return find_gaps(rows.withColumn("variable", F.lit("any")), size=size).drop("variable")


def classify_runs(runs: DataFrame) -> DataFrame:
    length = F.col("end_pos") - F.col("start_pos") + 1
    lead, trail = F.col("start_pos") == 0, F.col("end_pos") == F.col("n") - 1
    kind = (
        F.when(lead & trail, "entirely_unobserved").when(lead, "leading").when(trail, "trailing").otherwise("internal")
    )
    bins = (
        F.when(length < 6, "1-5")
        .when(length < 24, "6-23")
        .when(length < 72, "24-71")
        .when(length < 168, "72-167")
        .when(length < 336, "168-335")
        .when(length < 720, "336-719")
        .otherwise("720+")
    )
    return runs.withColumns({"length": length, "position_class": kind, "duration_bin": bins})


def missing_run_summary(runs: DataFrame, roles: DataFrame) -> DataFrame:
    return (
        classify_runs(runs)
        .join(roles, "site")
        .groupBy("role", "variable", "position_class", "duration_bin")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.sum("length").alias("missing_steps"),
            F.count_distinct("site").alias("n_sites"),
            F.max("length").alias("max_steps"),
        )
    )


def missing_cooccurrence(panel: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per site: how often each set of variables is missing together, label in the given order."""
    flags = [F.max(F.when((F.col("variable") == v) & F.col("value").isNull(), F.lit(v))) for v in variables]
    rows = panel.groupBy("site", "pos").agg(F.concat_ws(",", *flags).alias("label"))
    label = F.when(F.col("label") == "", "none").otherwise(F.col("label"))
    counts = rows.groupBy("site", label.alias("missing_variables")).agg(F.count(F.lit(1)).alias("positions"))
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    return counts.join(n, "site").select("site", "missing_variables", "positions", (F.col("positions") / F.col("n")).alias("fraction"))


def missing_cooccurrence_totals(panel: DataFrame, variables: Sequence[str], roles: DataFrame) -> DataFrame:
    return (
        missing_cooccurrence(panel, variables)
        .join(roles, "site")
        .groupBy("role", "missing_variables")
        .agg(F.sum("positions").alias("positions"), F.count_distinct("site").alias("n_sites"))
    )


def raw_value_diagnostics(
    panel: DataFrame,
    bounds: Mapping[str, tuple[float, float]],
    equal_checks: Mapping[str, tuple[str, float]] | None = None,
    above_checks: Mapping[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """Counts per series. ``equal_checks``/``above_checks``: output name -> (variable, level)."""
    v, var = F.col("value"), F.col("variable")
    lo = F.coalesce(*[F.when(var == k, F.lit(float(b[0]))) for k, b in bounds.items()])
    hi = F.coalesce(*[F.when(var == k, F.lit(float(b[1]))) for k, b in bounds.items()])
    extra = [F.count_if((var == k) & (v == x)).alias(name) for name, (k, x) in (equal_checks or {}).items()]
    extra += [F.count_if((var == k) & (v > x)).alias(name) for name, (k, x) in (above_checks or {}).items()]
    return panel.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("positions"),
        F.count("value").alias("n_finite"),
        (F.count_if(v.isNull()) / F.count(F.lit(1))).alias("fraction_missing"),
        ratio(F.count_if(F.abs(v - F.rint(v)) <= 1e-8), F.count("value")).alias("integer_fraction"),
        F.count_if(v == lo).alias("n_equal_lower"),
        F.count_if(v == hi).alias("n_equal_upper"),
        *extra,
    )


def constant_run_flags(panel: DataFrame, min_len: int = 48, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """The panel with the start of each cell's equal-value run, and the runs of at least ``min_len``."""
    d = shift(panel, {"_prev": ("value", -1)}, size=size)
    begins = F.col("value").isNotNull() & ~F.coalesce(F.col("value") == F.col("_prev"), F.lit(False))
    d = carry(d, prev={"run_start": F.when(begins, F.col("pos"))}, size=size)
    runs = (
        d.where("value is not null")
        .groupBy(*SERIES, "run_start")
        .agg(F.max("pos").alias("run_end"), F.count(F.lit(1)).alias("run_len"), F.max("value").alias("run_value"))
        .where(F.col("run_len") >= min_len)
    )
    return d.drop("_prev"), runs


def constant_runs(panel: DataFrame, min_len: int = 48, size: int = CHUNK) -> DataFrame:
    """Runs of at least ``min_len`` consecutive equal observations; any missing position breaks a run."""
    return constant_run_flags(panel, min_len, size)[1].withColumnsRenamed(
        {"run_start": "start_pos", "run_end": "end_pos", "run_len": "steps", "run_value": "value"}
    )


def constant_positions(panel: DataFrame, min_len: int = 48, size: int = CHUNK) -> DataFrame:
    d, runs = constant_run_flags(panel, min_len, size)
    flagged = d.join(runs.select(*SERIES, "run_start", F.lit(True).alias("_c")), [*SERIES, "run_start"], "left")
    flag = F.col("value").isNotNull() & F.coalesce(F.col("_c"), F.lit(False))
    return flagged.select(*panel.columns, flag.alias("constant_flag"))


def missing_rate(panel: DataFrame, min_len: int = 48, size: int = CHUNK) -> DataFrame:
    d = constant_positions(panel, min_len, size)
    return d.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("positions"),
        F.count("value").alias("observations"),
        F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("missing_fraction"),
        F.count_if("constant_flag").alias("constant_flag_steps"),
    )


def abs_changes(panel: DataFrame, value: str = "value", size: int = CHUNK) -> DataFrame:
    d = shift(panel, {"_prev": (value, -1)}, size=size)
    return d.withColumn("change", F.col(value) - F.col("_prev")).drop("_prev")


def change_thresholds(panel: DataFrame, roles: DataFrame, frac: float = 0.8, q: float = 0.75, size: int = CHUNK) -> DataFrame:
    """Quantile of |x_t - x_(t-1)| pooled over the training prefixes, per variable."""
    n = panel.groupBy("site").agg(F.floor(F.lit(frac) * (F.max("pos") + 1)).cast("bigint").alias("cut"))
    d = abs_changes(panel, size=size).join(n, "site").where("pos < cut")
    d = d.join(roles.where("role = 'train'").select("site"), "site", "left_semi")
    return exact_quantiles(d, ["variable"], F.abs("change"), {"threshold": q}).withColumnRenamed("_n", "n_changes")


def site_profile(
    panel: DataFrame, source: DataFrame, frac: float = 0.8, summer: Sequence[int] = (6, 7, 8), winter: Sequence[int] = (12, 1, 2)
) -> DataFrame:
    """One row per site: span, rows, inserted rows, cut, month coverage and display id."""
    src = source.groupBy("site").agg(F.count_distinct("ts").alias("source_rows"))
    p = panel.groupBy("site").agg(
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
        (F.max("pos") + 1).alias("rows"),
        F.array_sort(F.collect_set(F.month("ts"))).alias("_m"),
        F.count_distinct(F.when(F.col("value").isNotNull(), F.col("variable"))).alias("n_variables"),
        (F.count("value") / F.count(F.lit(1))).alias("completeness"),
    )
    has = lambda ms: F.arrays_overlap(F.col("_m"), F.array(*[F.lit(m) for m in ms]))
    return p.join(src, "site").select(
        "site",
        "start_ts",
        "end_ts",
        "rows",
        "source_rows",
        (F.col("rows") - F.col("source_rows")).alias("inserted_rows"),
        F.floor(F.lit(frac) * F.col("rows")).cast("bigint").alias("cut"),
        F.size("_m").cast("bigint").alias("n_months"),
        has(summer).alias("has_summer"),
        has(winter).alias("has_winter"),
        "n_variables",
        "completeness",
        F.concat_ws(" to ", F.date_format("start_ts", "yyyy-MM"), F.date_format("end_ts", "yyyy-MM")).alias("period"),
    )


def available_context(cases: DataFrame, panel: DataFrame, reach: int = 1900, size: int = CHUNK) -> DataFrame:
    """Per case x variable: positions and observed steps within ``reach`` of either side.

    Observed counts are differences of running sums at four positions, not scans of the context.
    """
    sums = prefix_sums(panel, {"c": F.col("value").isNotNull().cast("bigint")}, size=size).select(*SERIES, "pos", "c")
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    cv = cases.withColumn("variable", F.explode("masked_vars")).join(n, "site")
    cv = cv.withColumns(
        {
            "_l0": F.greatest(F.col("start_pos") - reach, F.lit(0)),
            "_r1": F.least(F.col("end_pos") + 1 + reach, F.col("n")),
        }
    )
    at = {"_a": F.col("_l0") - 1, "_b": F.col("start_pos") - 1, "_c": F.col("end_pos"), "_d": F.col("_r1") - 1}
    for name, pos in at.items():
        look = sums.select(*SERIES, F.col("pos").alias("_p"), F.col("c").alias(name))
        cv = cv.withColumn("_p", pos).join(look, [*SERIES, "_p"], "left").drop("_p")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    left, right = F.col("start_pos") - F.col("_l0"), F.col("_r1") - F.col("end_pos") - 1
    return cv.select(
        "case_id",
        "site",
        "variable",
        "scenario",
        "gap_len",
        left.alias("left_positions"),
        right.alias("right_positions"),
        (zero("_b") - zero("_a")).alias("left_observed"),
        (zero("_d") - zero("_c")).alias("right_observed"),
        (left < reach).alias("left_short"),
        (right < reach).alias("right_short"),
    )


def available_context_summary(ctx: DataFrame) -> DataFrame:
    med = lambda c, a: F.percentile(c, F.lit(0.5)).alias(a)
    return ctx.groupBy("scenario", "variable").agg(
        F.count(F.lit(1)).alias("variable_cases"),
        F.min("left_positions").alias("left_min"),
        med("left_positions", "left_median"),
        F.min("right_positions").alias("right_min"),
        med("right_positions", "right_median"),
        F.count_if("left_short").alias("left_short_cases"),
        F.count_if("right_short").alias("right_short_cases"),
        med("left_observed", "left_observed_median"),
        med("right_observed", "right_observed_median"),
        F.count_if(~F.col("left_short") & ~F.col("right_short")).alias("both_full_cases"),
    )


def variability(panel: DataFrame, scaled: str = "z", size: int = CHUNK) -> DataFrame:
    """Typical size of adjacent changes, raw and relative, and the sd of scaled changes."""
    d = shift(panel, {"_prev": ("value", -1), "_zprev": (scaled, -1)}, size=size)
    step = F.abs(F.col("value") - F.col("_prev"))
    span = F.max("value") - F.min("value")
    med = exact_quantiles(d, SERIES, step, {"median_change": 0.5}).drop("_n")
    g = d.groupBy(*SERIES).agg(
        F.avg(step).alias("mean_change"),
        ratio(F.avg(step), span).alias("scaled_change"),
        F.stddev_samp(F.col(scaled) - F.col("_zprev")).alias("sd_scaled_change"),
        span.alias("range"),
    )
    return g.join(med, list(SERIES), "left")


def _pair_sums(panel: DataFrame, variables: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Moment sums of every variable pair from one wide row per position (no pair join)."""
    wide = panel.groupBy("site", "pos").pivot("variable", list(variables)).agg(F.max("value"))
    names = sorted(variables)
    pairs = [
        F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    p = wide.select("site", F.explode(F.array(*pairs)).alias("p")).select("site", "p.*").where("x is not null and y is not null")
    return p.groupBy(*keys, "var_a", "var_b").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
    )


def corr_matrix(panel: DataFrame, variables: Sequence[str], mode: str = "site_mean") -> DataFrame:
    """Pairwise-complete Pearson r: averaged over sites, or pooled over all sites."""
    keys = ["site"] if mode == "site_mean" else []
    cols = [F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]
    r = _pair_sums(panel, variables, keys).withColumn("r", pearson(*cols))
    if mode == "site_mean":
        return r.groupBy("var_a", "var_b").agg(F.avg("r").alias("r"), F.count("r").alias("n_sites"))
    return r.select("var_a", "var_b", "r", F.col("n").cast("bigint").alias("n_pairs"))


def distribution_summary(panel: DataFrame, per_series: int | None = None, seed: int = 42) -> DataFrame:
    """Quartiles per variable over all values, or (a sampling operator) over ``per_series`` values of each series in hash order."""
    d = panel.where("value is not null").select(*SERIES, "pos", "value")
    if per_series is not None:
        h = hash_order(seed, F.col("site"), F.col("variable"), F.col("pos"))
        d = lowest_per_group(d.withColumn("_h", h), SERIES, ["_h", "pos"], per_series)
    return exact_quantiles(d, ["variable"], F.col("value"), {"q1": 0.25, "median": 0.5, "q3": 0.75}).withColumnRenamed("_n", "n")


def role_missing_means(panel: DataFrame, roles: DataFrame) -> DataFrame:
    miss = F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0))
    site = panel.groupBy(*SERIES).agg(miss.alias("rate"))
    return site.join(roles, "site").groupBy("role", "variable").agg(F.avg("rate").alias("mean_missing_rate"), F.count(F.lit(1)).alias("n_sites"))
