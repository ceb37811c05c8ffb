"""Column expressions shared by the operators (all JVM-side built-ins)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def literal(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hash_order(*parts) -> Column:
    """Deterministic 32-bit order key: the first 8 hex digits of md5 over '|'-joined parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_unit(*parts) -> Column:
    """hash_order scaled to [0, 1)."""
    return hash_order(*parts) / F.lit(4294967296.0)


def micros(ts) -> Column:
    """Microseconds since the epoch for a TIMESTAMP_NTZ column."""
    c = ts if isinstance(ts, Column) else F.col(ts)
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), c)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def floor_ts(ts, step_us: int) -> Column:
    us = micros(ts)
    return from_micros(us - F.pmod(us, F.lit(step_us)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or NULL (ANSI division would fail the job)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def r6(c: Column, digits: int = 6) -> Column:
    """Reported metrics carry six decimals; missing stays missing.

    The small guard settles exact ties upward, so the order in which a cluster adds up a sum can
    never decide a reported digit.
    """
    return F.round(c + F.lit(1e-9), digits)


def calendar(ts) -> dict[str, Column]:
    """Sine and cosine of the hour of day and of the day of year."""
    c = ts if isinstance(ts, Column) else F.col(ts)
    hour = F.hour(c) * (2 * math.pi / 24.0)
    doy = F.dayofyear(c) * (2 * math.pi / 365.25)
    return {
        "hour_sin": F.sin(hour),
        "hour_cos": F.cos(hour),
        "doy_sin": F.sin(doy),
        "doy_cos": F.cos(doy),
    }


def season(ts) -> Column:
    m = F.month(ts)
    return (
        F.when(m.isin(6, 7, 8), "summer")
        .when(m.isin(12, 1, 2), "winter")
        .when(m.isin(3, 4, 5), "spring")
        .otherwise("fall")
    )


def time_of_day(ts) -> Column:
    return F.when(F.hour(ts) < 12, "AM").otherwise("PM")


def pearson(n, sx, sy, sxx, syy, sxy) -> Column:
    """Pearson r from moment sums; NULL when either side has no variance."""
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    ok = (n >= 2) & (vx > 1e-12) & (vy > 1e-12)
    return F.when(ok, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy)))


def metric_columns(truth: Column, pred: Column) -> dict[str, Column]:
    """Aggregates over scored cells: MSE, MAE, RMSE, nRMSE, R2 and n_eval (NULLs if fewer than two)."""
    n = F.count(truth)
    err = pred - truth
    sse = F.sum(err * err)
    mean = F.avg(truth)
    tot = F.sum(truth * truth) - n * mean * mean
    span = F.max(truth) - F.min(truth)
    enough = n >= 2
    return {
        "MSE": F.when(enough, sse / n),
        "MAE": F.when(enough, F.avg(F.abs(err))),
        "RMSE": F.when(enough, F.sqrt(sse / n)),
        "nRMSE": F.when(enough & (span > 1e-8), F.try_divide(F.sqrt(sse / n), span)),
        "R2": F.when(enough & (tot > 1e-12), F.lit(1.0) - F.try_divide(sse, tot)),
        "n_eval": F.when(enough, n).otherwise(F.lit(0)).cast("bigint"),
    }
