"""Exact order statistics of groups of any size.

Built-in exact percentiles keep every distinct value of a group in one task. Here a group is cut at
quantiles of a bounded sample, so each slice is ordered by its own task, and the counts of the slices
before it make the ranks exact. Two readings of the cuts must agree, or a value counts in no slice or
in two: the sample follows from the values alone, never from the order in which they arrive.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapweave.operators.series import spread

SLICES = 64
#: Distinct values up to which a group is ordered whole.
WHOLE = 10_000
#: Distinct values of a larger group that its cuts are taken from, about.
SAMPLE = 4_096


def slice_cuts(counts: DataFrame, keys: Sequence[str], value: str, slices: int = SLICES, whole: int = WHOLE) -> DataFrame:
    """``_cuts`` of every group with more than ``whole`` values, the same however the rows are dealt: exact quantiles of the values whose hash falls in a share."""
    large = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") > whole)
    share = F.pmod(F.xxhash64(value), F.ceil(F.col("_m") / SAMPLE)) == 0
    cuts = F.percentile(value, F.array(*[F.lit(i / slices) for i in range(1, slices)]))
    return counts.join(large, list(keys)).where(share).groupBy(*keys).agg(cuts.alias("_cuts"))


def running_counts(counts: DataFrame, keys: Sequence[str], value: str, count: str, out: str = "upto", slices: int = SLICES, whole: int = WHOLE) -> DataFrame:
    """Add the number of rows with a value at or below each (keys, value) row; one row per distinct value."""
    sketch = slice_cuts(counts, keys, value, slices, whole)
    slice_of = F.size(F.filter("_cuts", lambda x: x < F.col(value)))
    sliced = counts.join(sketch, list(keys), "left").withColumn("_s", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(slice_of)).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*keys, "_s").agg(F.sum(count).alias("_t"))
    totals = totals.select(*keys, "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_s").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = spread(sliced, *keys, "_s").withColumn("_in", F.sum(count).over(inside)).join(totals, [*keys, "_s"])
    return d.select(*counts.columns, (F.col("_before") + F.col("_in")).alias(out))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Mapping[str, float], slices: int = SLICES, whole: int = WHOLE) -> DataFrame:
    """Linear-interpolation quantiles per key: ``keys``, one column per name in ``probs`` and the count ``_n``."""
    vals = df.select(*keys, value.alias("_v")).where(F.col("_v").isNotNull())
    counts = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    d = running_counts(counts, keys, "_v", "_c", "_e", slices, whole)
    d = d.join(counts.groupBy(*keys).agg(F.sum("_c").alias("_n")), list(keys))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_e") - F.col("_c")) & (rank < F.col("_e")), F.col("_v")))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    g = d.groupBy(*keys, "_n").agg(*aggs)

    def between(name: str, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return lo + (hi - lo) * (pos - F.floor(pos))

    return g.select(*keys, *[between(k, p).alias(k) for k, p in probs.items()], "_n")
