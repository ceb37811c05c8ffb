"""Per-site weighting, bootstrap intervals, paired tests and rank statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.exprs import pearson, ratio
from gapweave.functions.ranks import running_counts
from gapweave.operators.resample import bootstrap_means


def site_scores(d: DataFrame, metric: str = "NMAE", extra: Sequence[str] = (), site: str = "site", model: str = "model") -> DataFrame:
    """Sum(metric * n) / sum(n) per model, site and extras; rows without the metric do not count."""
    d = d.where(F.col(metric).isNotNull())
    return d.groupBy(model, site, *extra).agg(ratio(F.sum(F.col(metric) * F.col("n_eval")), F.sum("n_eval")).alias(metric))


def summary(d: DataFrame, metric: str = "NMAE", extra: Sequence[str] = (), draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Over sites: mean, sd (ddof 1), 95 % percentile bootstrap interval of the mean, number of sites."""
    s = site_scores(d, metric, extra)
    return summarize_sites(s, metric, extra, draws, seed)


def summarize_sites(s: DataFrame, metric: str = "NMAE", extra: Sequence[str] = (), draws: int = 10_000, seed: int = 42) -> DataFrame:
    keys = ["model", *extra]
    base = s.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("sd"), F.count(F.lit(1)).alias("n_sites"))
    boots = bootstrap_means(s, keys, [metric], draws, seed)
    ci = boots.groupBy(*keys).agg(F.percentile(metric, F.lit(0.025)).alias("low"), F.percentile(metric, F.lit(0.975)).alias("high"))
    return base.join(ci, keys).select(*keys, "mean", "sd", "low", "high", "n_sites")


def _signed_rank(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wilcoxon sums on (keys, diff): zero differences dropped, average ranks for ties.

    Ranks come from running counts of the distinct absolute differences, taken slice by slice, so no
    group is ordered in one task.
    """
    nz = d.where("diff <> 0").select(*keys, F.round(F.abs("diff"), 12).alias("a"), F.signum("diff").alias("sg"))
    t = nz.groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("sg") > 0).alias("pos"))
    t = running_counts(t, keys, "a", "c").withColumn("avg_rank", F.col("upto") - (F.col("c") - 1) / 2.0)
    c = F.col("c").cast("double")
    return t.groupBy(*keys).agg(
        F.sum("c").alias("n"),
        F.sum(F.col("avg_rank") * F.col("pos")).alias("w_plus"),
        F.sum(c * c * c - c).alias("ties"),
    )


def _normal_cdf(z: Column) -> Column:
    """Rational approximation 26.2.17 of Abramowitz and Stegun for z <= 0; absolute error up to 7.5e-8, so smaller values only mean "below 1e-7"."""
    a = -z
    t = 1.0 / (1.0 + 0.2316419 * a)
    # fixed values: the polynomial's published coefficients
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-a * a / 2.0) * 0.3989422804014327 * poly


def wilcoxon_p(d: DataFrame, keys: Sequence[str], method: str = "auto") -> DataFrame:
    """Two-sided signed-rank p per key and the ``method`` that gave it.

    ``exact`` uses subset-sum counts of the null (groups with ties have none and get a NULL p; counts grow as n squared), ``approx`` the
    normal approximation with tie correction, ``auto`` the exact test up to 50 differences without ties and
    the approximation otherwise. No non-zero difference gives p = 1.
    """
    if method not in ("auto", "exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    s = _signed_rank(d, keys)
    total = F.col("n") * (F.col("n") + 1) / 2.0
    stat = F.least("w_plus", total - F.col("w_plus"))
    s = s.withColumns({"_w": stat, "_t": total})
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    z = ratio(F.col("_w") - F.col("_t") / 2, F.sqrt(var))
    approx = F.least(F.lit(1.0), 2.0 * _normal_cdf(z))
    exactly = {"exact": F.col("ties") == 0, "approx": F.lit(False), "auto": (F.col("ties") == 0) & (F.col("n") <= 50)}[method]
    s = s.withColumn("_exact", exactly)
    null = signed_rank_null(s.where("_exact").select("n").distinct())
    s = s.join(null, "n", "left")
    upto = F.aggregate(
        F.slice("counts", F.lit(1), F.floor("_w").cast("int") + 1), F.lit(0.0), lambda a, x: a + x
    )
    exact = F.least(F.lit(1.0), 2.0 * upto / F.pow(F.lit(2.0), F.col("n")))
    keysdf = d.select(*keys).distinct()
    p = F.when(F.col("n").isNull(), F.lit(1.0)).when(F.col("_exact"), exact)
    p = p if method == "exact" else p.otherwise(approx)
    used = F.when(F.col("n").isNull(), "none").when(F.col("_exact"), "exact").otherwise("none" if method == "exact" else "approx")
    return keysdf.join(s, list(keys), "left").select(*keys, p.alias("p"), used.alias("method"))


def signed_rank_null(ns: DataFrame) -> DataFrame:
    """counts[w] = number of sign patterns of ranks 1..n with positive-rank sum w (n (n + 1) / 2 + 1 entries)."""

    def add(acc: Column, r: Column) -> Column:
        # new[w] = old[w] + old[w - r]
        return F.transform(acc, lambda x, i: x + F.when(i >= r, F.get(acc, (i - r).cast("int"))).otherwise(F.lit(0.0)))

    top = (F.col("n") * (F.col("n") + 1) / 2).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), top))
    counts = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), start, add)
    return ns.select("n", counts.alias("counts"))


def holm(d: DataFrame, p: str = "p", family: Sequence[str] = (), tie: Sequence[str] = ("model", "reference")) -> DataFrame:
    """Holm step-down adjustment inside a family of comparisons (a handful of rows per family)."""
    fam = [F.col(c) for c in family] or [F.lit(0)]
    w = Window.partitionBy(*fam).orderBy(p, *tie)
    m = F.count(F.lit(1)).over(Window.partitionBy(*fam))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    d = d.withColumn("_s", step)
    return d.withColumn("holm_p", F.least(F.lit(1.0), F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_s")


def pair_sites(s: DataFrame, pairs: DataFrame, metric: str = "NMAE", extra: Sequence[str] = (), unit: str = "site") -> DataFrame:
    """pairs (model, reference) joined to both scores on their common sites: x, y."""
    a = s.select("model", unit, *extra, F.col(metric).alias("x"))
    b = s.select(F.col("model").alias("reference"), unit, *extra, F.col(metric).alias("y"))
    return pairs.join(a, "model").join(b, ["reference", unit, *extra]).where("x is not null and y is not null")


def paired_compare(s: DataFrame, pairs: DataFrame, metric: str = "NMAE", extra: Sequence[str] = (), draws: int = 10_000, seed: int = 42, method: str = "auto") -> DataFrame:
    """Reduction 100 (1 - mean a / mean b) with a paired bootstrap interval, Wilcoxon p (``p_method`` says by which test, see ``wilcoxon_p``) and Holm p."""
    keys = ["model", "reference", *extra]
    xy = pair_sites(s, pairs, metric, extra)
    reduction = lambda x, y: 100.0 * (1.0 - ratio(x, y))
    base = xy.groupBy(*keys).agg(
        F.avg("x").alias("mean_model"),
        F.avg("y").alias("mean_reference"),
        F.count(F.lit(1)).alias("n_sites"),
        F.count_if(F.col("x") < F.col("y")).alias("sites_improved"),
    )
    base = base.withColumn("reduction", reduction(F.col("mean_model"), F.col("mean_reference")))
    boots = bootstrap_means(xy, keys, ["x", "y"], draws, seed).withColumn("_r", reduction(F.col("x"), F.col("y")))
    ci = boots.groupBy(*keys).agg(F.percentile("_r", F.lit(0.025)).alias("low"), F.percentile("_r", F.lit(0.975)).alias("high"))
    p = wilcoxon_p(xy.withColumn("diff", F.col("x") - F.col("y")), keys, method).withColumnRenamed("method", "p_method")
    d = base.join(ci, keys).join(p, keys)
    d = holm(d, family=extra)
    return d.select(*keys, "reduction", "low", "high", "p", "p_method", "holm_p", "n_sites", "sites_improved", "mean_model", "mean_reference")


def cell_level_compare(cells: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("case_id", "variable", "pos"), method: str = "auto") -> DataFrame:
    """On identical cells: n, mean absolute-error difference, win rate and Wilcoxon p with its ``p_method``.

    Cells are grouped once into a map of errors by model; pairs are read off it, so no table of cells is joined to itself. A model's cells are unique by ``keys``.
    """
    e = F.struct("model", F.abs(F.col("pred") - F.col("value")).alias("err"))
    named = pairs.select("model", "reference").distinct().agg(F.collect_list(F.struct("model", "reference")).alias("_p"))  # one row: the comparisons asked for
    cell = cells.groupBy(*keys).agg(F.map_from_entries(F.collect_list(e)).alias("_e")).join(named)
    xy = cell.select(*keys, "_e", F.inline("_p")).select(*keys, "model", "reference", F.element_at("_e", F.col("model")).alias("x"), F.element_at("_e", F.col("reference")).alias("y"))
    xy = xy.where("x is not null and y is not null").withColumn("diff", F.col("x") - F.col("y"))
    g = xy.groupBy("model", "reference").agg(
        F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_difference"), F.avg(F.when(F.col("diff") < 0, 1.0).otherwise(0.0)).alias("win_rate")
    )
    return g.join(wilcoxon_p(xy, ["model", "reference"], method).withColumnRenamed("method", "p_method"), ["model", "reference"])


def average_rank(d: DataFrame, col: str, keys: Sequence[str], out: str) -> DataFrame:
    """Average rank of ``col`` (without NULLs) in its group: running counts of the distinct values, slice by slice, so no group is ordered in one task."""
    counts = d.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running_counts(counts, keys, col, "_c", "_upto").select(*keys, col, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))
    return d.join(ranks, [*keys, col])


def spearman(d: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    r = average_rank(average_rank(d.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys, "_a"), y, keys, "_b")
    a, b = F.col("_a"), F.col("_b")
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(a).alias("sx"),
        F.sum(b).alias("sy"),
        F.sum(a * a).alias("sxx"),
        F.sum(b * b).alias("syy"),
        F.sum(a * b).alias("sxy"),
    )
    return s.select(*keys, pearson(*[F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")]).alias("rho"), F.col("n").cast("bigint").alias("n_sites"))


def pairs_frame(spark, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(pairs), "model string, reference string")
