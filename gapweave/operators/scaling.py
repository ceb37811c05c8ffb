"""Min-max and z-score scaling fitted by aggregation and applied by a join to a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.operators.grid import chrono_split
from gapweave.operators.impute import impute_linear
from gapweave.operators.series import CHUNK


def fit_minmax(panel: DataFrame, scope: str = "pooled_prefix", frac: float = 0.8, roles: DataFrame | None = None) -> DataFrame:
    """scaler(variable[, site], lo, hi, n_obs).

    scope ``site``: each whole series; ``train``: each site's own prefix; ``pooled_prefix``: the
    prefixes of all training sites together, one scaler per variable.
    """
    d, keys = panel, ["site", "variable"]
    if scope in ("train", "pooled_prefix"):
        d = chrono_split(d, frac).where("part = 'prefix'")
    if scope == "pooled_prefix":
        keys = ["variable"]
        if roles is not None:
            d = d.join(roles.where("role = 'train'").select("site"), "site", "left_semi")
    elif scope not in ("site", "train"):
        raise ValueError(f"unknown scope {scope!r}")
    return d.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n_obs"))


def _keys(scaler: DataFrame) -> list[str]:
    return [k for k in ("site", "variable") if k in scaler.columns]


def transform_minmax(df: DataFrame, scaler: DataFrame, value: str = "value", out: str = "z") -> DataFrame:
    """(x - lo) / range; a zero range divides by 1; a variable without data stays unscaled."""
    keys = _keys(scaler)
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    scaled = F.when(F.col("lo").isNull(), F.col(value)).otherwise((F.col(value) - F.col("lo")) / span)
    return df.join(scaler.select(*keys, "lo", "hi"), keys, "left").select(*df.columns, scaled.alias(out))


def inverse_minmax(df: DataFrame, scaler: DataFrame, value: str, out: str) -> DataFrame:
    keys = _keys(scaler)
    span = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise(F.col("hi") - F.col("lo"))
    raw = F.when(F.col("lo").isNull(), F.col(value)).otherwise(F.col(value) * span + F.col("lo"))
    return df.join(scaler.select(*keys, "lo", "hi"), keys, "left").select(*df.columns, raw.alias(out))


def fit_zscore(train: DataFrame, size: int = CHUNK) -> DataFrame:
    """Mean and sample sd of the linearly filled training series; sd 0 or undefined becomes 1."""
    filled = impute_linear(train, size=size)
    s = filled.groupBy("variable").agg(F.avg("filled").alias("mean"), F.stddev_samp("filled").alias("sd"))
    return s.withColumn("sd", F.when(F.coalesce(F.col("sd"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("sd")))


def transform_zscore(df: DataFrame, stats: DataFrame, value: str = "value", out: str = "z") -> DataFrame:
    return df.join(stats, "variable", "left").select(*df.columns, ((F.col(value) - F.col("mean")) / F.col("sd")).alias(out))


def inverse_zscore(df: DataFrame, stats: DataFrame, value: str = "z", out: str = "value") -> DataFrame:
    return df.join(stats, "variable", "left").select(*df.columns, (F.col(value) * F.col("sd") + F.col("mean")).alias(out))
