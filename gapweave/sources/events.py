"""Adapter from an event table to observations: site buckets, time steps and a fixed-point mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapweave.functions.exprs import floor_ts


def event_observations(events: DataFrame, n_sites: int, step_us: int) -> DataFrame:
    """site = user bucket, variable = event type, ts floored to the step, value = mean.

    Values have two decimals, so they are summed as integer hundredths: the mean does not depend on
    the order rows arrive in, and a recomputed partition gives the same bits.
    """
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    site = F.concat(F.lit("s"), F.pmod("user_id", F.lit(n_sites)).cast("string"))
    return events.groupBy(
        site.alias("site"), F.col("event_type").alias("variable"), floor_ts("ts", step_us).alias("ts")
    ).agg((cents.cast("double") / (F.count(F.lit(1)) * 100).cast("double")).alias("value"))
