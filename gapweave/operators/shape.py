"""Projections, filters and reshaping. B3, B6 and the calendar labels also accept a streaming frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.exprs import r6

# Valid sensor ranges, bounds inclusive.
SENSOR_BOUNDS = {
    "Tin": (-30.0, 70.0),
    "Tout": (-30.0, 70.0),
    "RH": (0.0, 100.0),
    "CO2": (0.0, 5000.0),
    "Rad": (0.0, 2000.0),
    "WindSpeed": (0.0, 60.0),
    "RadIn": (0.0, 2000.0),
}


def _lookup(col: Column, table: Mapping[str, object]) -> Column:
    """CASE over a small parameter table; no join, so it also works on a stream."""
    expr = None
    for key, out in table.items():
        expr = F.when(col == key, F.lit(out)) if expr is None else expr.when(col == key, F.lit(out))
    return expr if expr is not None else F.lit(None)


def select_targets(obs: DataFrame, names: Mapping[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """Rename source headers to short names and drop sites lacking any required variable."""
    renamed = obs.withColumn("variable", _lookup(F.col("variable"), names)).where("variable is not null")
    required = [v for v in names.values() if v not in set(optional)]
    full = (
        renamed.where(F.col("variable").isin(required))
        .groupBy("site")
        .agg(F.count_distinct("variable").alias("n"))
        .where(F.col("n") == len(required))
    )
    return renamed.join(full.select("site"), "site", "left_semi")


def attach_covariates(obs: DataFrame, targets: Sequence[str], optional: Sequence[str]) -> DataFrame:
    """Targets plus whichever optional variables exist; absent ones are simply not there."""
    kind = F.when(F.col("variable").isin(list(targets)), "target").otherwise("covariate")
    return obs.where(F.col("variable").isin([*targets, *optional])).withColumn("kind", kind)


def range_screen(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = SENSOR_BOUNDS, value: str = "value") -> DataFrame:
    """NULL values outside the inclusive bounds of their variable; unlisted variables are untouched."""
    lo = _lookup(F.col("variable"), {k: b[0] for k, b in bounds.items()})
    hi = _lookup(F.col("variable"), {k: b[1] for k, b in bounds.items()})
    v = F.col(value)
    return df.withColumn(value, F.when(F.coalesce((v < lo) | (v > hi), F.lit(False)), F.lit(None)).otherwise(v))


def range_screen_report(df: DataFrame, bounds: Mapping[str, tuple[float, float]] = SENSOR_BOUNDS) -> DataFrame:
    kept = range_screen(df.withColumn("_v", F.col("value")), bounds, "_v")
    return kept.groupBy("site", "variable").agg(
        F.count("value").alias("n_before"),
        F.count("_v").alias("n_after"),
        (F.count("value") - F.count("_v")).alias("n_removed"),
    )


def to_wide(panel: DataFrame, variables: Sequence[str], value: str = "value") -> DataFrame:
    return panel.groupBy("site", "pos", "ts").pivot("variable", list(variables)).agg(F.max(value))


def melt(wide: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Wide sensors -> long series with item id ``site::variable``."""
    long = wide.unpivot(["site", "pos", "ts"], list(variables), "variable", "value")
    return long.withColumn("item_id", F.concat_ws("::", "site", "variable"))


def pivot_scores(scores: DataFrame, index: Sequence[str], column: str, values: Sequence[str], metric: str) -> DataFrame:
    return scores.groupBy(*index).pivot(column, list(values)).agg(F.first(metric, ignorenulls=True))


def clip_to_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]], value: str) -> DataFrame:
    lo = _lookup(F.col("variable"), {k: b[0] for k, b in bounds.items()})
    hi = _lookup(F.col("variable"), {k: b[1] for k, b in bounds.items()})
    v = F.col(value)
    return df.withColumn(value, F.when(v.isNotNull(), F.greatest(lo, F.least(hi, v))))


def explode_vars(df: DataFrame, col: str = "masked_vars") -> DataFrame:
    """One row per masked variable, from a comma list or an array."""
    c = F.split(col, ",") if dict(df.dtypes)[col] == "string" else F.col(col)
    return df.withColumn("variable", F.explode(c))


def round6(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    fixed = {c: r6(F.when(~F.isnan(c), F.col(c))) for c in cols}
    return df.withColumns(fixed)


def head_per_group(df: DataFrame, group: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def derive_rmse(df: DataFrame) -> DataFrame:
    root = F.sqrt(F.greatest(F.col("MSE"), F.lit(0.0)))
    have = F.col("RMSE") if "RMSE" in df.columns else F.lit(None).cast("double")
    return df.withColumn("RMSE", F.when(F.col("MSE").isNotNull(), F.coalesce(have, root)).otherwise(have))
