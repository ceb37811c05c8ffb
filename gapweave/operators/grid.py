"""Complete time grids, frequency and calendar operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapweave.functions.exprs import calendar, from_micros, micros, season, time_of_day
from gapweave.functions.ranks import exact_quantiles
from gapweave.operators.series import CHUNK, SERIES, shift, spread

HOUR = 3_600_000_000


def grid_violations(obs: DataFrame, step_us: int = HOUR) -> DataFrame:
    """Per site: null stamps, duplicate (variable, stamp) rows and stamps that are not on the step."""
    stamps = obs.groupBy("site", "variable", "ts").agg(F.count(F.lit(1)).alias("n"))
    return stamps.groupBy("site").agg(
        F.coalesce(F.sum(F.when(F.col("ts").isNull(), F.col("n"))), F.lit(0)).alias("null_stamps"),
        F.coalesce(F.sum(F.when(F.col("ts").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.pmod(micros("ts"), F.lit(step_us)) != 0).alias("off_grid_stamps"),
    )


def regularize(obs: DataFrame, step_us: int = HOUR, size: int = CHUNK) -> DataFrame:
    """Observations (site, variable, ts, value) -> panel on each site's complete grid.

    Grid slots and observations meet in one aggregation keyed by the absolute slot number, so the
    observations are shuffled once and never joined to the site table. A null, duplicate or
    off-grid stamp fails the job: duplicates are errors, never averaged.
    """
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("site"))).cast("bigint")
    us = micros("ts")
    slot = F.when(F.col("ts").isNull(), fail("null timestamp at ")).when(
        F.pmod(us, F.lit(step_us)) != 0, fail("off-grid timestamp at ")
    ).otherwise(F.floor(us / step_us))
    seen = obs.select(
        "site",
        "variable",
        slot.alias("slot"),
        F.when(~F.isnan("value"), F.col("value")).alias("value"),
        F.lit(None).cast("bigint").alias("lo"),
        F.lit(1).alias("_obs"),
    )
    cells = (
        spread(grid_slots(obs, step_us, size).unionByName(seen), "site", "variable", "slot")
        .groupBy("site", "variable", "slot")
        .agg(F.max("value").alias("value"), F.sum("_obs").alias("_obs"), F.max("lo").alias("lo"))
    )
    value = F.when(F.col("_obs") > 1, fail("duplicate timestamp at ").cast("double")).otherwise(F.col("value"))
    ts = from_micros(F.col("slot") * F.lit(step_us))
    return cells.select("site", "variable", (F.col("slot") - F.col("lo")).alias("pos"), ts.alias("ts"), value.alias("value"))


def grid_slots(obs: DataFrame, step_us: int, size: int = CHUNK) -> DataFrame:
    """Every slot of every (site, variable), generated chunk by chunk so no site is one task's work."""
    slot = F.floor(micros("ts") / step_us)
    series = obs.groupBy("site", "variable").agg(F.min(slot).alias("_a"), F.max(slot).alias("_b"))
    span = series.groupBy("site").agg(F.min("_a").alias("lo"), F.max("_b").alias("hi"))
    chunks = series.select("site", "variable").join(span, "site")
    chunks = chunks.withColumn("_ck", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(hi - lo) div {size}"))))
    first = F.col("lo") + F.col("_ck") * size
    cells = F.sequence(first, F.least(first + size - 1, F.col("hi")))
    return spread(chunks, "site", "variable", "_ck").select(
        "site", "variable", F.explode(cells).alias("slot"), F.lit(None).cast("double").alias("value"), "lo", F.lit(0).alias("_obs")
    )


def regularize_report(obs: DataFrame, step_us: int = HOUR) -> DataFrame:
    """source_rows: distinct stamps read; inserted_rows: stamps the grid added."""
    per_site = obs.groupBy("site").agg(
        F.count_distinct("ts").alias("source_rows"), F.min(micros("ts")).alias("lo"), F.max(micros("ts")).alias("hi")
    )
    rows = F.expr(f"(hi - lo) div {step_us} + 1")
    return per_site.select("site", rows.alias("rows"), "source_rows", (rows - F.col("source_rows")).alias("inserted_rows"))


def assert_grid(panel: DataFrame, step_us: int = HOUR, size: int = CHUNK) -> DataFrame:
    """Per series: number of adjacent differences and how many differ from the step."""
    d = shift(panel, {"prev_ts": ("ts", -1)}, size=size).where(F.col("prev_ts").isNotNull())
    step = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts"))
    return d.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("steps"), F.count_if(step != step_us).alias("violations"))


def detect_freq(stamps: DataFrame) -> DataFrame:
    """Label of the median adjacent difference per site: 1min, 5min, 10min or 1H.

    The gap to the next stamp is taken inside hour buckets plus a copy of each bucket's first stamp
    in the bucket before it, so no site is ordered in one task.
    """
    bucket = F.expr(f"{_us()} div {HOUR}")
    d = stamps.select("site", "ts").distinct().withColumn("_b", bucket)
    w = Window.partitionBy("site", "_b").orderBy("ts")
    within = d.select("site", "_b", "ts", F.lead("ts").over(w).alias("next_ts"))
    # the bucket edges come from the same shuffled rows, so the stamps are read once
    edges = within.groupBy("site", "_b").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    nxt = Window.partitionBy("site").orderBy("_b")
    across = edges.select("site", F.col("last_ts").alias("ts"), F.lead("first_ts").over(nxt).alias("next_ts"))
    gaps = within.drop("_b").unionByName(across).where("next_ts is not null")
    minutes = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next_ts")) / 60e6
    med = exact_quantiles(gaps, ["site"], minutes, {"median_minutes": 0.5}).drop("_n")
    freq = (
        F.when(F.col("median_minutes") <= 1.5, "1min")
        .when(F.col("median_minutes") <= 6, "5min")
        .when(F.col("median_minutes") <= 11, "10min")
        .otherwise("1H")
    )
    sites = edges.select("site").distinct()
    return sites.join(med, "site", "left").select("site", "median_minutes", freq.alias("freq"))


def _us() -> str:
    return "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar(ts))


def group_labels(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(
        {
            "season": season(ts),
            "time_of_day": time_of_day(ts),
            "season_tod": F.concat_ws("_", season(ts), time_of_day(ts)),
        }
    )


def chrono_split(panel: DataFrame, frac: float = 0.8) -> DataFrame:
    """part = 'prefix' for the first int(frac * n) positions of the site, else 'suffix'."""
    n = panel.groupBy("site").agg((F.max("pos") + 1).alias("n"))
    cut = F.floor(F.lit(float(frac)) * F.col("n")).cast("bigint")
    d = panel.join(n.withColumn("cut", cut), "site")
    return d.withColumn("part", F.when(F.col("pos") < F.col("cut"), "prefix").otherwise("suffix")).drop("n")


def mask_start_month(cases: DataFrame) -> DataFrame:
    n_vars = F.size("masked_vars").cast("bigint")
    return (
        cases.withColumns({"start_month": F.date_format("start_ts", "yyyy-MM"), "n_vars": n_vars})
        .groupBy("start_month", "scenario", "gap_len")
        .agg(
            F.count(F.lit(1)).alias("mask_cases"),
            F.count_distinct("site").alias("n_sites"),
            F.sum("n_vars").alias("variable_cases"),
            F.sum(F.col("gap_len") * F.col("n_vars")).alias("evaluated_variable_steps"),
        )
    )
