"""Scores of predictions on hidden and truly observed cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import metric_columns, r6, ratio, season, time_of_day
from gapweave.functions.ranks import exact_quantiles

CASE_KEYS = ("case_id", "model", "site", "scenario", "vars_key", "gap_len", "repeat", "variable")


def _with_nmae(d: DataFrame, ranges: DataFrame) -> DataFrame:
    """NMAE = MAE / full range of the site-variable, else the evaluated truth's range, else NULL."""
    denom = F.when(F.col("full_range") > 1e-8, F.col("full_range")).when(F.col("truth_range") > 1e-8, F.col("truth_range"))
    return d.join(ranges, ["site", "variable"], "left").withColumn("NMAE", ratio(F.col("MAE"), denom))


def case_metrics(cells: DataFrame, keys: Sequence[str], truth: str = "value", pred: str = "pred") -> DataFrame:
    m = metric_columns(F.col(truth), F.col(pred))
    span = (F.max(truth) - F.min(truth)).alias("truth_range")
    return cells.where(~F.isnan(pred) & F.col(pred).isNotNull()).groupBy(*keys).agg(*[c.alias(k) for k, c in m.items()], span)


def case_scores(cells: DataFrame, ranges: DataFrame, keys: Sequence[str] = CASE_KEYS) -> DataFrame:
    """One row per model, case and variable, physical units, metrics rounded to six decimals."""
    d = _with_nmae(case_metrics(cells, keys), ranges)
    return d.select(*keys, *[r6(F.col(c)).alias(c) for c in ("MSE", "MAE", "RMSE", "nRMSE", "R2", "NMAE")], "n_eval")


def stratified_scores(cells: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("model", "case_id", "site", "variable")) -> DataFrame:
    """The same metrics under every label: all, season, time of day and their combination."""
    lab = lambda t, v: F.struct(F.lit(t).alias("group_type"), v.alias("group_value"))
    s, t = season("ts"), time_of_day("ts")
    labels = F.array(lab("all", F.lit("all")), lab("season", s), lab("time_of_day", t), lab("season_tod", F.concat_ws("_", s, t)))
    d = cells.withColumn("_g", F.explode(labels)).select(*keys, "value", "pred", "_g.group_type", "_g.group_value")
    k = [*keys, "group_type", "group_value"]
    d = _with_nmae(case_metrics(d, k), ranges)
    return d.select(*k, *[r6(F.col(c)).alias(c) for c in ("MSE", "MAE", "RMSE", "nRMSE", "R2", "NMAE")], "n_eval")


def norm_ranges(panel: DataFrame, frac: float = 0.8) -> DataFrame:
    """Full range, training-prefix range and P01-P99 range of every series."""
    n = panel.groupBy("site").agg(F.floor(F.lit(frac) * (F.max("pos") + 1)).cast("bigint").alias("cut"))
    d = panel.join(n, "site")
    v, pre = F.col("value"), F.when(F.col("pos") < F.col("cut"), F.col("value"))
    g = d.groupBy("site", "variable").agg(
        F.count(v).alias("n_observations"),
        (F.max(v) - F.min(v)).alias("full_range"),
        (F.max(pre) - F.min(pre)).alias("prefix_range"),
    )
    g = g.join(exact_quantiles(panel, ("site", "variable"), v, {"p01": 0.01, "p99": 0.99}).drop("_n"), ["site", "variable"], "left")
    g = g.withColumn("robust_range", F.col("p99") - F.col("p01"))
    ok = F.coalesce((F.col("full_range") > 0) & (F.col("robust_range") > 0), F.lit(False))
    return g.withColumns({"ratio": F.when(F.col("robust_range") > 0, F.col("full_range") / F.col("robust_range")), "common_valid": ok})
