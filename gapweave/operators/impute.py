"""Linear, limited and seasonal imputers: on a whole panel, and per masked case.

A case hides one interval, so its fill needs only the nearest observations outside that interval.
Those are looked up in one table built from the panel: O(panel + hidden cells), whatever the number
of cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.operators.series import CHUNK, SERIES, carry, observed_neighbours
from gapweave.plans.storage import materialize

CASE_VAR = ("case_id", "site", "variable")


def _line(pos: Column, p0: str, v0: str, p1: str, v1: str) -> Column:
    """Linear in position between two anchors; one anchor is held constant; none stays NULL."""
    p0c, v0c, p1c, v1c = (F.col(c) for c in (p0, v0, p1, v1))
    mid = v0c + (v1c - v0c) * F.try_divide((pos - p0c).cast("double"), (p1c - p0c).cast("double"))
    return F.when(p0c.isNull(), v1c).when(p1c.isNull(), v0c).when(p0c == p1c, v0c).otherwise(mid)


def impute_linear(panel: DataFrame, value: str = "value", out: str = "filled", keys=SERIES, size: int = CHUNK) -> DataFrame:
    d = observed_neighbours(panel, keys, value, size)
    fill = F.coalesce(F.col(value), _line(F.col("pos"), "prev_pos", "prev_val", "next_pos", "next_val"))
    return d.select(*panel.columns, fill.alias(out))


def impute_linear_limited(panel: DataFrame, limit: int = 3, value: str = "value", out: str = "filled", size: int = CHUNK) -> DataFrame:
    """Linear fill of only the first and last ``limit`` points of each missing run, however long it is."""
    d = observed_neighbours(panel, SERIES, value, size)
    line = _line(F.col("pos"), "prev_pos", "prev_val", "next_pos", "next_val")
    # comparisons against a missing anchor are NULL, not false: test each side on its own
    left = F.coalesce(F.col("pos") - F.col("prev_pos") <= limit, F.lit(False))
    right = F.coalesce(F.col("next_pos") - F.col("pos") <= limit, F.lit(False))
    fill = F.coalesce(F.col(value), F.when(left | right, line))
    return d.select(*panel.columns, fill.alias(out))


def phase_neighbours(panel: DataFrame, season: int, value: str = "value", size: int = CHUNK) -> DataFrame:
    """Nearest same-phase observation at or before (s_prev_*) and at or after (s_next_*) each position."""
    at = F.when(F.col(value).isNotNull(), F.col("pos"))
    return carry(
        panel.withColumn("phase", F.col("pos") % season),
        [*SERIES, "phase"],
        prev={"s_prev_pos": at, "s_prev_val": F.col(value)},
        next={"s_next_pos": at, "s_next_val": F.col(value)},
        size=size * season,
    )


def _seasonal_pick(run_start: Column, run_end: Column, n: Column, ctx: int) -> Column:
    early = F.when(F.col("s_prev_pos") >= F.greatest(F.lit(0), run_start - ctx), F.col("s_prev_val"))
    late = F.when(F.col("s_next_pos") < F.least(n, run_end + 1 + ctx), F.col("s_next_val"))
    return F.coalesce(early, late)


def impute_seasonal(panel: DataFrame, season: int = 24, ctx: int = 1440, value: str = "value", out: str = "filled", size: int = CHUNK) -> DataFrame:
    """Nearest earlier same-phase observation within ``ctx`` of the run, else the nearest later, else linear.

    Only original observations are sources; a filled cell never feeds another seasonal fill. Neighbours and the first fill are written, since
    every carry reads what it is given twice.
    """
    n = panel.groupBy(*SERIES).agg((F.max("pos") + 1).alias("n"))
    phases = materialize(phase_neighbours(panel, season, value, size), "phase-neighbours")
    d = observed_neighbours(phases, SERIES, value, size).join(n, list(SERIES))
    run_start = F.coalesce(F.col("prev_pos") + 1, F.lit(0))
    run_end = F.coalesce(F.col("next_pos") - 1, F.col("n") - 1)
    d = d.withColumn("_f", F.coalesce(F.col(value), _seasonal_pick(run_start, run_end, F.col("n"), ctx)))
    return impute_linear(materialize(d.select(*panel.columns, "_f"), "seasonal-cells"), "_f", out, size=size).drop("_f")


def merged_spans(cases: DataFrame, panel: DataFrame, value: str = "value", size: int = CHUNK) -> DataFrame:
    """Case x variable with the anchors outside the hidden interval and the merged missing run.

    left_*/right_* are the nearest observations outside [start_pos, end_pos]; run_start..run_end is
    the maximal missing run that contains the hidden interval.
    """
    near = observed_neighbours(panel, SERIES, value, size)
    n = panel.groupBy(*SERIES).agg((F.max("pos") + 1).alias("n"))
    cv = cases.withColumn("variable", F.explode("masked_vars"))
    left = near.select(*SERIES, (F.col("pos") + 1).alias("start_pos"), F.col("prev_pos").alias("left_pos"), F.col("prev_val").alias("left_val"))
    right = near.select(*SERIES, (F.col("pos") - 1).alias("end_pos"), F.col("next_pos").alias("right_pos"), F.col("next_val").alias("right_val"))
    d = cv.join(n, list(SERIES)).join(left, [*SERIES, "start_pos"], "left").join(right, [*SERIES, "end_pos"], "left")
    return d.select(
        *cases.columns,
        "variable",
        "n",
        "left_pos",
        "left_val",
        "right_pos",
        "right_val",
        F.coalesce(F.col("left_pos") + 1, F.lit(0)).alias("run_start"),
        F.coalesce(F.col("right_pos") - 1, F.col("n") - 1).alias("run_end"),
    )


def merged_span_report(spans: DataFrame) -> DataFrame:
    merged = F.col("run_end") - F.col("run_start") + 1
    hidden = F.col("end_pos") - F.col("start_pos") + 1
    return spans.select(
        "case_id",
        "site",
        "variable",
        hidden.alias("hidden_len"),
        "run_start",
        "run_end",
        merged.alias("run_len"),
        (F.col("run_start") == 0).alias("leading"),
        (merged > hidden).alias("extended"),
    )


def case_linear(spans: DataFrame) -> DataFrame:
    """Predictions (case_id, site, variable, pos, y_hat) by linear interpolation over the hidden cells."""
    cells = spans.withColumn("pos", F.explode(F.sequence("start_pos", "end_pos")))
    return cells.select(*CASE_VAR, "pos", _line(F.col("pos"), "left_pos", "left_val", "right_pos", "right_val").alias("y_hat"))


def case_seasonal(spans: DataFrame, panel: DataFrame, season: int = 24, ctx: int = 1440, value: str = "value", size: int = CHUNK) -> DataFrame:
    """Seasonal fill of each case's merged run, reported on the hidden cells."""
    look = phase_neighbours(panel, season, value, size)
    cells = spans.withColumn("pos", F.explode(F.sequence("run_start", "run_end"))).withColumns(
        {
            "_p0": F.expr(f"pos - {season} * ((pos - run_start) div {season} + 1)"),
            "_p1": F.expr(f"pos + {season} * ((run_end - pos) div {season} + 1)"),
        }
    )
    before = look.select(*SERIES, F.col("pos").alias("_p0"), "s_prev_pos", "s_prev_val")
    after = look.select(*SERIES, F.col("pos").alias("_p1"), "s_next_pos", "s_next_val")
    d = cells.join(before, [*SERIES, "_p0"], "left").join(after, [*SERIES, "_p1"], "left")
    d = d.withColumn("_f", _seasonal_pick(F.col("run_start"), F.col("run_end"), F.col("n"), ctx))
    # cells without a same-phase source interpolate between filled neighbours and the run's anchors
    at = F.when(F.col("_f").isNotNull(), F.col("pos"))
    d = carry(
        d.select(*CASE_VAR, "pos", "start_pos", "end_pos", "left_pos", "left_val", "right_pos", "right_val", "_f"),
        CASE_VAR,
        prev={"_pp": at, "_pv": F.col("_f")},
        next={"_np": at, "_nv": F.col("_f")},
        size=size,
    )
    d = d.withColumns(
        {
            "_pv": F.when(F.col("_pp").isNull(), F.col("left_val")).otherwise(F.col("_pv")),
            "_nv": F.when(F.col("_np").isNull(), F.col("right_val")).otherwise(F.col("_nv")),
            "_pp": F.coalesce("_pp", "left_pos"),
            "_np": F.coalesce("_np", "right_pos"),
        }
    )
    y = F.coalesce(F.col("_f"), _line(F.col("pos"), "_pp", "_pv", "_np", "_nv"))
    return d.where("pos between start_pos and end_pos").select(*CASE_VAR, "pos", y.alias("y_hat"))


def final_fill(pred: DataFrame, fallback: DataFrame) -> DataFrame:
    """Residual missing predictions take the linear fill (which holds the ends)."""
    fb = fallback.select(*CASE_VAR, "pos", F.col("y_hat").alias("_fb"))
    d = fb.join(pred.select(*CASE_VAR, "pos", "y_hat"), [*CASE_VAR, "pos"], "left")
    return d.select(*CASE_VAR, "pos", F.coalesce("y_hat", "_fb").alias("y_hat"))
