"""Forecast-based fills: context arrays, built-in forecasters, bidirectional fusion and refinement.

A run's context is at most ``ctx`` positions per side. Built-in forecasters have a closed form: a context is summed up by run and phase, and every cell of the run, however
long, is an expression of those few numbers and its distance from the run's edge. A user forecaster is an Arrow-batched function and gets the context as an array.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.functions.exprs import calendar
from gapweave.operators.impute import CASE_VAR
from gapweave.operators.masking import home_bucket, home_rows, interval_join
from gapweave.operators.series import CHUNK, SERIES, observed_neighbours, spread

Forecaster = Callable[[Column, Column], Column]

# ---------------------------------------------------------------- built-in univariate forecasters


def _steps(h: Column) -> Column:
    return F.sequence(F.lit(0), (h - 1).cast("int"))


def _at(arr: Column, i0: Column) -> Column:
    return F.get(arr, i0.cast("int"))


@dataclass(frozen=True)
class ClosedForm:
    """A built-in forecaster. ``value(state, i)`` is the value of step ``i`` (from 0) by the state of a context (``context_states``); ``arrays`` the same over a context array.

    A state has ``n`` (cells), ``last`` and ``first`` (nearest to the run and farthest from it), and by phase of ``season``, 0 being that of step 0, the ``mean`` and the ``nearest`` value.
    """

    season: int
    value: Callable[[dict[str, Column], Column], Column]
    arrays: Forecaster

    def __call__(self, ctx: Column, h: Column) -> Column:
        return self.arrays(ctx, h)


def _slope(n: Column, last: Column, first: Column) -> Column:
    return F.when(n > 1, F.try_divide(last - first, (n - 1).cast("double"))).otherwise(F.lit(0.0))


def _drift_array(ctx: Column, h: Column) -> Column:
    slope = _slope(F.size(ctx), F.element_at(ctx, -1), _at(ctx, F.lit(0)))
    return F.transform(_steps(h), lambda i: F.element_at(ctx, -1) + slope * (i + 1))


last_value = ClosedForm(1, lambda s, i: s["last"], lambda ctx, h: F.array_repeat(F.element_at(ctx, -1), h.cast("int")))

#: Last value plus the average step of the context.
drift = ClosedForm(1, lambda s, i: s["last"] + _slope(s["n"], s["last"], s["first"]) * (i + 1), _drift_array)


def seasonal_last(m: int) -> ClosedForm:
    """The value one season (or the needed multiple) back; short contexts repeat the last value."""

    def arrays(ctx: Column, h: Column) -> Column:
        n = F.size(ctx)
        return F.transform(_steps(h), lambda i: F.when(n >= m, _at(ctx, n - m + i % m)).otherwise(F.element_at(ctx, -1)))

    return ClosedForm(m, lambda s, i: F.when(s["n"] >= m, F.element_at(s["nearest"], (i % m).cast("int"))).otherwise(s["last"]), arrays)


def seasonal_mean(m: int) -> ClosedForm:
    """Mean of the context values in the same phase; a phase without values takes the last value."""

    def arrays(ctx: Column, h: Column) -> Column:
        n = F.size(ctx)
        phases = F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda p: F.aggregate(
                F.filter(ctx, lambda x, j: F.pmod(j - n - p, F.lit(m)) == 0),
                F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("c")),
                lambda a, x: F.struct((a["s"] + x).alias("s"), (a["c"] + 1).alias("c")),
                lambda a: F.coalesce(F.try_divide(a["s"], a["c"].cast("double")), F.element_at(ctx, -1)),
            ),
        )
        return F.transform(_steps(h), lambda i: _at(phases, i % m))

    return ClosedForm(m, lambda s, i: F.coalesce(F.element_at(s["mean"], (i % m).cast("int")), s["last"]), arrays)


def user_forecaster(fn: Callable[[np.ndarray, int], np.ndarray], on_error: str = "null") -> Forecaster:
    """Wrap ``fn(context, horizon) -> values`` as an Arrow-batched forecaster.

    Output shorter than the horizon is padded with its last value. With ``on_error="null"`` a failing call gives no rows, which the
    caller's final fill replaces by the linear fill (cells of the spans without a forecast count them); with ``"raise"`` it ends the job.
    """
    if on_error not in ("null", "raise"):
        raise ValueError(f"unknown on_error {on_error!r}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(ctx: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for c, k in zip(ctx, h, strict=True):
            try:
                y = np.asarray(fn(np.asarray(c, dtype=float), int(k)), dtype=float).ravel()[: int(k)]
                out.append(np.pad(y, (0, int(k) - len(y)), mode="edge") if len(y) else None)
            except Exception:  # noqa: BLE001 - a failed forecast falls back unless asked otherwise
                if on_error == "raise":
                    raise
                out.append(None)
        return pd.Series(out)

    return lambda ctx, h: run(ctx, h)


# ---------------------------------------------------------------- contexts


def _context_rows(spans: DataFrame, panel: DataFrame, ctx: int, value: str, size: int, runs: Sequence[str]) -> DataFrame:
    """Cells of the two contexts of every run: ``runs``, ``_side`` (L, R), ``away`` (1 next to the run) and the value ``v``.

    Missing cells take the previous observation inside the context, else the next, else zero.
    """
    d = observed_neighbours(panel, SERIES, value, size).select(*SERIES, "pos", "prev_pos", "prev_val", "next_pos", "next_val")
    iv = spans.select(*runs, "run_start", "run_end") if "run_start" not in runs else spans.select(*runs)
    iv = iv.withColumn("_side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    is_left = F.col("_side") == "L"
    iv = iv.withColumns(
        {
            "_lo": F.when(is_left, F.greatest(F.col("run_start") - ctx, F.lit(0))).otherwise(F.col("run_end") + 1),
            "_hi": F.when(is_left, F.col("run_start") - 1).otherwise(F.col("run_end") + ctx),
        }
    ).where("_lo <= _hi")
    rows = interval_join(iv, d, "_lo", "_hi", SERIES)
    clean = (
        F.when(F.col("prev_pos") >= F.col("_lo"), F.col("prev_val"))
        .when(F.col("next_pos") <= F.col("_hi"), F.col("next_val"))
        .otherwise(F.lit(0.0))
    )
    away = F.when(is_left, F.col("run_start") - F.col("pos")).otherwise(F.col("pos") - F.col("run_end"))
    return rows.select(*runs, "_side", away.alias("away"), clean.alias("v"))


STATE = ("n", "last", "first", "mean", "nearest")


def context_states(spans: DataFrame, panel: DataFrame, ctx: int, season: int, value: str = "value", size: int = CHUNK, runs: Sequence[str] = CASE_VAR) -> DataFrame:
    """``spans`` with the states of their contexts for closed-form forecasters, as columns ``left_n``, ``left_last``, ... ``right_nearest``; NULL for a context without cells."""
    rows = _context_rows(spans, panel, ctx, value, size, runs).withColumn("phase", F.pmod(-F.col("away"), F.lit(season)).cast("int"))
    by_phase = rows.groupBy(*runs, "_side", "phase").agg(
        F.count(F.lit(1)).alias("c"), F.sum("v").alias("s"), F.min(F.struct("away", "v")).alias("near"), F.max(F.struct("away", "v")).alias("far")
    )
    entries = lambda v: F.map_from_entries(F.collect_list(F.struct("phase", v)))
    state = by_phase.groupBy(*runs, "_side").agg(
        F.sum("c").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"), entries(F.col("s") / F.col("c")).alias("mean"), entries(F.col("near.v")).alias("nearest")
    )
    state = state.select(*runs, "_side", "n", F.col("near.v").alias("last"), F.col("far.v").alias("first"), "mean", "nearest")
    one = lambda side, c: F.first(F.when(F.col("_side") == side, F.col(c)), ignorenulls=True)
    both = state.groupBy(*runs).agg(*[one(side, c).alias(f"{name}_{c}") for side, name in (("L", "left"), ("R", "right")) for c in STATE])
    return spans.drop(*[f"{name}_{c}" for name in ("left", "right") for c in STATE]).join(both, list(runs), "left")


def _state(side: str) -> dict[str, Column]:
    return {c: F.col(f"{side}_{c}") for c in STATE}


def _cells_of(d: DataFrame, lo: Column, hi: Column, size: int = CHUNK) -> DataFrame:
    """One row per position from ``lo`` to ``hi``, made in pieces of ``size`` so that no array is as long as a run."""
    d = d.withColumns({"_lo": lo, "_hi": hi}).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_hi - _lo) div {size}"))))
    first = F.col("_lo") + F.col("_piece") * size
    return d.withColumn("pos", F.explode(F.sequence(first, F.least(first + size - 1, F.col("_hi"))))).drop("_lo", "_hi", "_piece")


def _closed_cells(d: DataFrame, fc: ClosedForm, use_left: Column, use_right: Column, whole_run: bool, keys: Sequence[str] = CASE_VAR) -> DataFrame:
    """Forward and reversed closed-form forecasts of a run's cells (of the hidden ones unless ``whole_run``), fused by position; no row where neither side is used."""
    d = d.withColumns({"_l": use_left, "_r": use_right}).where("_l or _r")
    cells = _cells_of(d, F.col("run_start") if whole_run else F.col("start_pos"), F.col("run_end") if whole_run else F.col("end_pos"))
    ahead, behind = F.col("pos") - F.col("run_start"), F.col("run_end") - F.col("pos")
    y = fuse_cell(F.when(F.col("_l"), fc.value(_state("left"), ahead)), F.when(F.col("_r"), fc.value(_state("right"), behind)), ahead, ahead + behind + 1)
    keep = [c for c in ("start_pos", "end_pos") if c in d.columns and whole_run]
    return cells.select(*keys, "pos", *keep, y.alias("y_hat"))


def context_arrays(spans: DataFrame, panel: DataFrame, ctx: int, value: str = "value", size: int = CHUNK, runs: Sequence[str] = CASE_VAR) -> DataFrame:
    """Attach ``left`` and ``right`` context arrays of every run, the cell next to the run last ("most recent")."""
    rows = _context_rows(spans, panel, ctx, value, size, runs).withColumn("_v", F.struct((-F.col("away")).alias("o"), "v"))
    pack = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.col("_v")))), lambda s: s["v"])
    arrays = rows.groupBy(*runs).agg(pack("L").alias("left"), pack("R").alias("right"))
    empty = F.array().cast("array<double>")
    d = spans.join(arrays, list(runs), "left")
    return d.withColumns({"left": F.coalesce("left", empty), "right": F.coalesce("right", empty)})


def context_slices(spans: DataFrame, panel: DataFrame, lengths: Sequence[int], value: str = "value", size: int = CHUNK) -> DataFrame:
    """Per case x variable x context length: what the last ``c`` positions before the run hold.

    Filled inside the slice only: a missing cell never borrows from before the slice.
    """
    c = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in lengths]))
    d = spans.select(*CASE_VAR, "run_start", "run_end").withColumn("context", c)
    d = d.withColumns({"_lo": F.greatest(F.col("run_start") - F.col("context"), F.lit(0)), "_hi": F.col("run_start") - 1}).where("_lo <= _hi")
    near = observed_neighbours(panel, SERIES, value, size).select(*SERIES, "pos", value, "prev_pos", "prev_val", "next_pos", "next_val")
    rows = interval_join(d, near, "_lo", "_hi", SERIES)
    f = F.when(F.col("prev_pos") >= F.col("_lo"), F.col("prev_val")).when(F.col("next_pos") <= F.col("_hi"), F.col("next_val"))
    return rows.withColumn("_f", f).groupBy("case_id", "variable", "context").agg(
        F.count(F.lit(1)).alias("actual"), F.avg("_f").alias("mean_context"), F.max_by("_f", "pos").alias("last_context"), F.count(value).alias("observed")
    )


def _horizon() -> Column:
    return (F.col("run_end") - F.col("run_start") + 1).cast("int")


def _emit(d: DataFrame, values: Column, keys: Sequence[str] = CASE_VAR) -> DataFrame:
    """Run arrays -> one row per cell of the run, with the hidden bounds when present."""
    # exploding a NULL array gives no row, so no filter has to evaluate the forecast a second time
    e = d.withColumn("_y", values).select("*", F.posexplode("_y").alias("_i", "y_hat"))
    e = e.withColumn("pos", F.col("run_start") + F.col("_i"))
    return e.select(*keys, "pos", *[c for c in ("start_pos", "end_pos") if c in d.columns], "y_hat")


def _hidden_only(e: DataFrame) -> DataFrame:
    return e.where("pos between start_pos and end_pos").select(*CASE_VAR, "pos", "y_hat")


def _rolling(ctx: Column, h: Column, fc: Forecaster, chunk: int, keep: int) -> Column:
    """Chunked forecast: each chunk's output joins the context of the next."""
    rounds = F.sequence(F.lit(0), ((h - 1) / F.lit(chunk)).cast("int"))
    zero = F.struct(ctx.alias("c"), F.array().cast("array<double>").alias("o"))

    def step(acc: Column, _i: Column) -> Column:
        y = fc(acc["c"], F.lit(chunk))
        grown = F.concat(acc["c"], y)
        return F.struct(F.slice(grown, F.greatest(F.size(grown) - keep + 1, F.lit(1)), F.lit(keep)).alias("c"), F.concat(acc["o"], y).alias("o"))

    return F.slice(F.aggregate(rounds, zero, step)["o"], F.lit(1), h)


def impute_forecast(
    spans: DataFrame, panel: DataFrame, fc: Forecaster, ctx: int, mode: str = "full_gap", horizon: int = 48, value: str = "value",
    whole_run: bool = False, size: int = CHUNK,
) -> DataFrame:
    """Forecast each merged run from its left context, or from the reversed right one if there is none."""
    if mode == "full_gap" and isinstance(fc, ClosedForm):
        d = context_states(spans, panel, ctx, fc.season, value, size)
        return _closed_cells(d, fc, F.col("left_n").isNotNull(), F.col("left_n").isNull() & F.col("right_n").isNotNull(), whole_run)
    d = context_arrays(spans, panel, ctx, value, size)
    src = F.when(F.size("left") > 0, F.col("left")).when(F.size("right") > 0, F.col("right"))
    h = _horizon()
    y = fc(src, h) if mode == "full_gap" else _rolling(src, h, fc, horizon, ctx)
    if mode == "full_gap":
        y = F.when(F.size("left") > 0, y).otherwise(F.reverse(y))
    e = _emit(d, F.when(src.isNotNull(), y))
    return e if whole_run else _hidden_only(e)


def natural_forecast(panel: DataFrame, fc: Forecaster, ctx: int, value: str = "value", size: int = CHUNK) -> DataFrame:
    """Base fill: every natural missing run of the panel forecast from its own context."""
    from gapweave.operators.quality import find_gaps

    runs = find_gaps(panel, value, size).withColumnsRenamed({"start_pos": "run_start", "end_pos": "run_end"})
    keys = (*SERIES, "run_start", "run_end")
    if isinstance(fc, ClosedForm):
        d = context_states(runs, panel, ctx, fc.season, value, size, keys)
        return _closed_cells(d, fc, F.col("left_n").isNotNull(), F.col("left_n").isNull() & F.col("right_n").isNotNull(), True, SERIES)
    d = context_arrays(runs, panel, ctx, value, size, keys)
    src = F.when(F.size("left") > 0, F.col("left")).when(F.size("right") > 0, F.col("right"))
    y = fc(src, _horizon())
    y = F.when(F.size("left") > 0, y).otherwise(F.reverse(y))
    return _emit(d, F.when(src.isNotNull(), y), SERIES)


def repredict_hidden_only(
    spans: DataFrame, panel: DataFrame, base: DataFrame, fc: Forecaster, ctx: int, margin: int, value: str = "value", size: int = CHUNK
) -> DataFrame:
    """Merged runs are forecast afresh; every other cell around the case reuses the base fill."""
    fresh = impute_forecast(spans, panel, fc, ctx, value=value, whole_run=True, size=size)
    iv = spans.select(*CASE_VAR, "start_pos", "end_pos", "run_start", "run_end").withColumns(
        {"_lo": F.greatest(F.col("run_start") - margin, F.lit(0)), "_hi": F.col("run_end") + margin}
    )
    around = interval_join(iv, panel.select(*SERIES, "pos", value), "_lo", "_hi", SERIES)
    d = around.join(base.select(*SERIES, "pos", F.col("y_hat").alias("_b")), [*SERIES, "pos"], "left")
    d = d.join(fresh.select(*CASE_VAR, "pos", F.col("y_hat").alias("_f")), [*CASE_VAR, "pos"], "left")
    inside = F.col("pos").between(F.col("run_start"), F.col("run_end"))
    y = F.when(inside, F.col("_f")).otherwise(F.coalesce(F.col(value), F.col("_b")))
    origin = F.when(inside, "forecast").when(F.col(value).isNotNull(), "observed").otherwise("base")
    return d.select(*CASE_VAR, "pos", origin.alias("origin"), y.alias("y_hat"))


def _weights(h: Column) -> Column:
    """Forward weights 1 -> 0 over the run; a single point gets one half."""
    return F.transform(_steps(h), lambda i: F.when(h > 1, F.lit(1.0) - F.try_divide(i.cast("double"), (h - 1).cast("double"))).otherwise(F.lit(0.5)))


def fuse_cell(fwd: Column, bwd: Column, i: Column, n: Column) -> Column:
    """``fuse`` for one cell: the ``i``-th of a run of ``n``."""
    w = F.when(n > 1, F.lit(1.0) - F.try_divide(i.cast("double"), (n - 1).cast("double"))).otherwise(F.lit(0.5))
    return F.coalesce(w * fwd + (1 - w) * bwd, fwd, bwd)


def fuse(fwd: Column, bwd: Column, h: Column) -> Column:
    both = F.transform(F.arrays_zip(_weights(h).alias("w"), fwd.alias("f"), bwd.alias("b")), lambda s: s["w"] * s["f"] + (1 - s["w"]) * s["b"])
    return F.when(fwd.isNull(), bwd).when(bwd.isNull(), fwd).otherwise(both)


def bidirectional_init(
    spans: DataFrame, panel: DataFrame, fc: Forecaster, ctx: int, min_side: int = 48, value: str = "value", bidirectional: bool = True,
    max_horizon: int | None = None, whole_run: bool = False, size: int = CHUNK,
) -> DataFrame:
    """Forward and time-reversed forecasts, each from a long enough side, fused by position.

    If neither side is long enough, whichever is not empty is used (left first). ``max_horizon`` is for a forecaster
    that cannot go further: longer runs then give no rows and are left to the caller's fill.
    """
    if isinstance(fc, ClosedForm):
        d = context_states(spans, panel, ctx, fc.season, value, size)
        d = d if max_horizon is None else d.where(_horizon() <= max_horizon)
        cells = lambda side: F.coalesce(f"{side}_n", F.lit(0))
        left_ok, right_ok = cells("left") >= min_side, (cells("right") >= min_side) & F.lit(bidirectional)
        none = ~left_ok & ~right_ok
        return _closed_cells(d, fc, left_ok | (none & (cells("left") > 0)), right_ok | (none & (cells("left") == 0) & (cells("right") > 0)), whole_run)
    d = context_arrays(spans, panel, ctx, value, size)
    h = _horizon()
    left_ok, right_ok = F.size("left") >= min_side, (F.size("right") >= min_side) & F.lit(bidirectional)
    none = ~left_ok & ~right_ok
    use_l = left_ok | (none & (F.size("left") > 0))
    use_r = right_ok | (none & (F.size("left") == 0) & (F.size("right") > 0))
    d = d.withColumns({"_fw": F.when(use_l, fc(F.col("left"), h)), "_bw": F.when(use_r, F.reverse(fc(F.col("right"), h)))})
    y = fuse(F.col("_fw"), F.col("_bw"), h)
    if max_horizon is not None:
        y = F.when(h <= max_horizon, y)
    e = _emit(d, y)
    return e if whole_run else _hidden_only(e)


# ---------------------------------------------------------------- covariate forecasts and refinement

CovForecaster = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def ridge_forecaster(alpha: float = 1.0) -> CovForecaster:
    """Ridge of the target on its covariates, fitted on the context: (y, X_past, X_gap) -> y_gap."""

    def fc(y: np.ndarray, x: np.ndarray, xg: np.ndarray) -> np.ndarray:
        mx, my = x.mean(axis=0), y.mean()
        c = x - mx
        beta = np.linalg.solve(c.T @ c + alpha * np.eye(x.shape[1]), c.T @ (y - my))
        return my + (xg - mx) @ beta

    return fc


def covariate_cells(
    spans: DataFrame, panel: DataFrame, ctx: int, value: str, refs: DataFrame | None = None, use_calendar: bool = True, max_horizon: int | None = None,
) -> DataFrame:
    """Static design rows: every position of a run and its two contexts, with covariates as an array.

    ``max_horizon`` is for a forecaster that cannot go further: longer runs then get no rows and keep the estimate they came with.

    Columns: case_id, site, variable, run_start, run_end, pos, side (L, G, R), vals (map variable -> value), fixed
    (calendar and reference values).
    """
    within = spans if max_horizon is None else spans.where(_horizon() <= max_horizon)
    iv = within.select(*CASE_VAR, "run_start", "run_end", F.greatest(F.col("run_start") - ctx, F.lit(0)).alias("_lo"), (F.col("run_end") + ctx).alias("_hi"))
    return interval_cells(iv, panel, value, refs, use_calendar)


def interval_cells(iv: DataFrame, panel: DataFrame, value: str, refs: DataFrame | None = None, use_calendar: bool = True, reach: int | None = None) -> DataFrame:
    """Design rows of ``iv(case_id, site, variable, run_start, run_end, _lo, _hi)``, see ``covariate_cells``.

    ``refs`` are pieces as ``references.reference_windows`` gives them, or rows case_id, site, variable, pos, rank, ref_value. A piece is cut to its interval and travels with
    it to the panel, so no design row is shuffled. With ``reach``, the most positions of an interval, all rows of an interval are in one task, dealt by site and a bucket ``_bk`` that
    rows keep: a group that has these among its keys is not shuffled.
    """
    wide = panel.groupBy("site", "pos", "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", value)))).alias("vals")
    )
    fixed = F.array(*(calendar("ts").values() if use_calendar else [])).cast("array<double>")
    if reach is not None:
        iv = iv.withColumn("_bk", home_bucket("_lo", reach))
    if refs is not None:
        iv = _with_pieces(iv, refs)
        fixed = F.concat(fixed, F.coalesce(F.expr("transform(_r, v -> v[int(pos - _at)])"), F.array().cast("array<double>")))
    if reach is None:
        d = interval_join(iv, wide, "_lo", "_hi", ("site",))
    else:
        keys = ("site", "_bk")
        d = spread(iv, *keys).join(spread(home_rows(wide, reach), *keys), list(keys)).where("pos between _lo and _hi")
    side = F.when(F.col("pos") < F.col("run_start"), "L").when(F.col("pos") > F.col("run_end"), "R").otherwise("G")
    return d.select(*[c for c in iv.columns if c not in ("_lo", "_hi", "_r", "_at")], "pos", side.alias("side"), "vals", fixed.alias("fixed"))


def _with_pieces(iv: DataFrame, refs: DataFrame) -> DataFrame:
    """``iv`` cut at the pieces of its references: ``_r`` holds an array a rank that begins at ``_at``; NULL where a case has none."""
    keys = list(CASE_VAR)
    if "values" not in refs.columns:
        one = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref_value"))), lambda s: F.array(s["ref_value"]))
        cells = refs.groupBy(*keys, "pos").agg(one.alias("values"))
        d = iv.withColumn("first", F.explode(F.sequence("_lo", "_hi"))).join(cells.withColumnRenamed("pos", "first"), [*keys, "first"], "left").withColumn("_last", F.col("first"))
    else:
        last = F.col("first") + F.size(F.col("values")[0]) - 1
        d = iv.join(refs.select(*keys, "first", "values", last.alias("_last")), keys, "left")
    d = d.withColumns({"_lo": F.greatest("_lo", F.coalesce("first", "_lo")), "_hi": F.least("_hi", F.coalesce("_last", "_hi"))}).where("_lo <= _hi")
    cut = F.expr("transform(values, v -> slice(v, int(_lo - first) + 1, int(_hi - _lo) + 1))")
    return d.withColumns({"_r": cut, "_at": F.col("_lo")}).drop("first", "values", "_last")


def covariate_pass(
    cells: DataFrame, snapshot: DataFrame, variables: Sequence[str], fc: CovForecaster, min_side: int = 48, bidirectional: bool = True,
) -> DataFrame:
    """One synchronous pass: every run re-forecast from one frozen snapshot of the estimates.

    ``snapshot`` (case_id, site, variable, pos, y_hat) overrides the panel inside the case's runs.
    A run with no long enough side keeps its previous estimate. For forecasters of the user; the built-in ridge has its own way (``moments``).
    """
    snap = snapshot.groupBy("case_id", "site", "pos").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("variable", "y_hat")))).alias("snap")
    )
    none = F.create_map().cast("map<string,double>")
    d = cells.join(snap, ["case_id", "site", "pos"], "left").withColumn("snap", F.coalesce("snap", none))
    est = F.array(*[F.coalesce(F.element_at("snap", F.lit(v)), F.element_at("vals", F.lit(v))) for v in variables])
    d = d.select(*CASE_VAR, "pos", "side", est.alias("est"), "fixed")
    names = list(variables)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t = names.index(key[2])
        e = np.array(pdf["est"].tolist(), dtype=float)
        fixed = np.array(pdf["fixed"].tolist(), dtype=float).reshape(len(pdf), -1)
        x = np.hstack([np.delete(e, t, axis=1), fixed])
        side = pdf["side"].to_numpy()
        gap, left, right = side == "G", side == "L", side == "R"
        xg = x[gap]
        fwd = fc(e[left, t], x[left], xg) if left.sum() >= min_side else None
        bwd = None
        if bidirectional and right.sum() >= min_side:
            bwd = fc(e[right, t][::-1], x[right][::-1], xg[::-1])[::-1]
        n = int(gap.sum())
        none = [None] * n
        return pd.DataFrame(
            {"case_id": key[0], "site": key[1], "variable": key[2], "pos": pdf["pos"].to_numpy()[gap], "i": np.arange(n), "n": n,
             "fwd": none if fwd is None else fwd, "bwd": none if bwd is None else bwd}
        )

    schema = "case_id long, site string, variable string, pos long, i long, n long, fwd double, bwd double"
    # a group is one run with its two contexts
    new = d.groupBy(*CASE_VAR).applyInPandas(solve, schema)
    new = new.select(*CASE_VAR, "pos", fuse_cell(F.col("fwd"), F.col("bwd"), F.col("i"), F.col("n")).alias("y_hat"))
    keys = [*CASE_VAR, "pos"]
    old = snapshot.select(*keys, F.col("y_hat").alias("_old"))
    return old.join(new, keys, "left").select(*keys, F.coalesce("y_hat", "_old").alias("y_hat"))


@dataclass(frozen=True)
class Step:
    """One synchronous pass of a method: ``run(snapshot, active)`` re-forecasts all ``runs(case_id, site, variable)``, or those of ``active``, and keeps the rest."""

    runs: DataFrame
    run: Callable[[DataFrame, DataFrame | None], DataFrame]

    def __call__(self, snapshot: DataFrame, active: DataFrame | None = None) -> DataFrame:
        return self.run(snapshot, active)


def covariate_step(cells: DataFrame, variables: Sequence[str], fc: CovForecaster, min_side: int = 48, bidirectional: bool = True) -> Step:
    """Passes of a user's covariate forecaster over the design rows of ``covariate_cells``."""

    def run(snapshot: DataFrame, active: DataFrame | None = None) -> DataFrame:
        some = cells if active is None else cells.join(active, list(CASE_VAR), "left_semi")
        return covariate_pass(some, snapshot, variables, fc, min_side, bidirectional)

    return Step(cells.select(*CASE_VAR).distinct(), run)


def refine_rounds(init: DataFrame, step: Step, passes: int, written: bool = False) -> list[DataFrame]:
    """Estimates after 0, 1, ... ``passes`` synchronous passes, each written out; ``written`` says that ``init`` is a table already."""
    from gapweave.plans.storage import materialize

    rounds = [init if written else materialize(init, "init")]
    for i in range(passes):
        rounds.append(materialize(step(rounds[-1]), f"pass{i + 1}"))
    return rounds


def refine_trace(init: DataFrame, step: Step, passes: int, written: bool = False) -> DataFrame:
    """Every round as one table: case_id, site, variable, pos, round, y_hat, before. Rounds after 0 have only the cells that changed, with their estimate ``before``."""
    rounds = refine_rounds(init, step, passes, written)
    keys, at = [*CASE_VAR, "pos"], lambda i: F.lit(i).cast("bigint").alias("round")
    out = rounds[0].select(*keys, at(0), "y_hat", F.lit(None).cast("double").alias("before"))
    for i, (old, new) in enumerate(zip(rounds[:-1], rounds[1:], strict=True), 1):
        d = new.join(old.select(*keys, F.col("y_hat").alias("before")), keys).where(~F.col("y_hat").eqNullSafe(F.col("before")))
        out = out.unionByName(d.select(*keys, at(i), "y_hat", "before"))
    return out


def refine_sync(
    init: DataFrame, cells: DataFrame, variables: Sequence[str], fc: CovForecaster, passes: int, min_side: int = 48, bidirectional: bool = True,
) -> DataFrame:
    """``passes`` synchronous refinement passes of a user's forecaster; 0 returns the initial estimate."""
    from gapweave.plans.storage import materialize

    if passes == 0:
        return init
    return refine_rounds(init, covariate_step(materialize(cells, "refine-cells"), variables, fc, min_side, bidirectional), passes)[-1]


def converge(
    init: DataFrame, linear: DataFrame, step: Step, tol: float = 1e-3, var_tol: float = 5e-4, max_passes: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """Passes for each case until its pseudo-RMSE against the linear fill stops moving.

    A variable of a case whose last RMS change fell below ``var_tol`` keeps its estimate and is not forecast again; a case stops when its
    relative change falls below ``tol`` or no variable moves, whatever other cases do. Only the number of moving
    (case, variable) pairs comes back to the driver. The log has one row per case and round.
    """
    from gapweave.plans.storage import materialize, materialize_all

    init, linear = materialize_all({"init": lambda: init, "linear": lambda: linear}, "converge")
    keys = [*CASE_VAR, "pos"]
    lin = linear.select(*keys, F.col("y_hat").alias("_l"))
    rms = lambda a, b: F.sqrt(F.avg((F.col(a) - F.col(b)) * (F.col(a) - F.col(b))))
    score = lambda d, name: d.join(lin, keys).groupBy("case_id").agg(rms("y_hat", "_l").alias(name))
    cur, active = init, step.runs
    before = materialize(score(cur, "before"), "converge-score")
    logs = []
    for i in range(1, max_passes + 1):
        nxt = materialize(step(cur, active), f"round{i}")
        delta = nxt.join(cur.select(*keys, F.col("y_hat").alias("_o")), keys).groupBy(*CASE_VAR).agg(rms("y_hat", "_o").alias("rms"))
        change = F.coalesce(F.try_divide(F.abs(F.col("after") - F.col("before")), F.col("before")), F.lit(0.0))
        case = before.join(score(nxt, "after"), "case_id").withColumn("rel_change", change)
        pairs = active.join(case, "case_id").join(delta, list(CASE_VAR))
        pairs = materialize(pairs.select(*CASE_VAR, "after", "rel_change", "rms"), f"converge{i}")
        logs.append(pairs.groupBy("case_id").agg(F.lit(i).alias("round"), F.count(F.lit(1)).cast("int").alias("active_variables"), F.max("after").alias("pseudo_rmse"), F.max("rel_change").alias("rel_change")))
        cur, before = nxt, materialize(case.select("case_id", F.col("after").alias("before")), "converge-score")
        active = pairs.where((F.col("rel_change") >= tol) & (F.col("rms") >= var_tol)).select(*CASE_VAR)
        if active.count() == 0:
            break
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return cur, log


def refine_until_converged(
    init: DataFrame, linear: DataFrame, cells: DataFrame, variables: Sequence[str], fc: CovForecaster, min_side: int = 48,
    tol: float = 1e-3, var_tol: float = 5e-4, max_passes: int = 5,
) -> tuple[DataFrame, DataFrame]:
    """``converge`` with forward-only passes of a user's forecaster."""
    from gapweave.plans.storage import materialize

    step = covariate_step(materialize(cells, "converge-cells"), variables, fc, min_side, bidirectional=False)
    return converge(init, linear, step, tol, var_tol, max_passes)


def covariate_once(init: DataFrame, step: Step, spans: DataFrame) -> DataFrame:
    """One pass over a univariate fill; a run starting at position 0 keeps the fill."""
    new = step(init)
    keys = [*CASE_VAR, "pos"]
    lead = spans.where("run_start = 0").select(*CASE_VAR).withColumn("_lead", F.lit(True))
    d = new.join(init.select(*keys, F.col("y_hat").alias("_i")), keys, "left").join(lead, list(CASE_VAR), "left")
    return d.select(*keys, F.when(F.col("_lead"), F.col("_i")).otherwise(F.col("y_hat")).alias("y_hat"))


def impute_covariate_once(init: DataFrame, cells: DataFrame, spans: DataFrame, variables: Sequence[str], fc: CovForecaster, min_side: int = 48) -> DataFrame:
    """``covariate_once`` with a forward-only pass of a user's forecaster."""
    return covariate_once(init, covariate_step(cells, variables, fc, min_side, bidirectional=False), spans)


# ---------------------------------------------------------------- windowed overlap


#: A window's prediction from the window before it: array with NULL for missing cells -> array as long.
WindowPredictor = Callable[[Column], Column]


def phase_mean_window(window: int, season: int) -> WindowPredictor:
    """Mean of the context's values in the same phase of the season."""

    def predict(ctx: Column) -> Column:
        in_phase = lambda p: F.filter(ctx, lambda x, j: x.isNotNull() & (F.pmod(j - window - p, F.lit(season)) == 0))
        mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v))
        phases = F.transform(F.sequence(F.lit(0), F.lit(season - 1)), lambda p: mean(in_phase(p)))
        return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: _at(phases, i % season))

    return predict


def user_window(fn: Callable[[np.ndarray, int], np.ndarray], window: int) -> WindowPredictor:
    """Wrap a user's model ``fn(contexts, horizon) -> predictions``: the windows of many series are one matrix (a row each, NaN for missing cells) per Arrow batch.

    Non-finite predictions count as none.
    """

    def run(ctx: pa.Array) -> pa.Array:
        flat = ctx.flatten().to_numpy(zero_copy_only=False).astype(float)
        y = np.asarray(fn(flat.reshape(len(ctx), window), window), dtype=float)
        if y.shape != (len(ctx), window):
            raise ValueError(f"a window model gave shape {y.shape} for {len(ctx)} windows of {window}")
        y = y.ravel()
        values = pa.array(y, mask=~np.isfinite(y))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(ctx) + 1) * window, pa.int32()), values)

    batch = F.arrow_udf(run, T.ArrayType(T.DoubleType()))
    return lambda ctx: batch(ctx)


def impute_windowed_overlap(panel: DataFrame, window: int, patch: int, predictor: WindowPredictor, value: str = "value", min_bias: int = 2, size: int = CHUNK) -> DataFrame:
    """Half-overlapping windows predicted by ``predictor``, per-patch bias correction, overlaps averaged.

    A window's context is the window before it, NULL where the panel is missing or has not begun. A patch with at least ``min_bias`` observations shifts by their
    mean residual. Missing cells take the average over the windows covering them, the rest the linear fill.
    """
    from gapweave.operators.impute import impute_linear

    half = window // 2
    if window % 2 or not window:
        raise ValueError("the window must be even")
    last = F.expr(f"pos div {half}")
    later = panel.where(F.col(value).isNotNull()).select(*SERIES, "pos", value, F.explode(F.array(last + 1, last + 2)).alias("w"))
    at = F.col("pos") - (F.col("w") - 2) * half
    seen = later.groupBy(*SERIES, "w").agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int").alias("i"), F.col(value).alias("v")))).alias("_c"))
    ctx = F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: F.element_at("_c", i))
    # only windows with a missing cell are predicted
    gaps = panel.where(F.col(value).isNull()).select(*SERIES, F.explode(F.array(last - 1, last)).alias("w")).where("w >= 0").distinct()
    made = seen.join(gaps, [*SERIES, "w"], "left_semi").select(*SERIES, "w", ctx.alias("_c"))
    made = made.select(*SERIES, "w", F.posexplode(predictor(F.col("_c"))).alias("_i", "_pm")).withColumn("pos", F.col("w") * half + F.col("_i"))
    d = made.where("_pm is not null").join(panel.select(*SERIES, "pos", value), [*SERIES, "pos"])
    d = d.withColumn("patch", F.expr(f"_i div {patch}"))
    res = F.col(value) - F.col("_pm")
    bias = d.groupBy(*SERIES, "w", "patch").agg(F.when(F.count(res) >= min_bias, F.avg(res)).otherwise(F.lit(0.0)).alias("_bias"))
    p = d.where(F.col(value).isNull()).join(bias, [*SERIES, "w", "patch"])
    p = p.groupBy(*SERIES, "pos").agg(F.avg(F.col("_pm") + F.col("_bias")).alias("_y"))
    out = panel.join(p, [*SERIES, "pos"], "left").withColumn("_f", F.coalesce(F.col(value), F.col("_y")))
    return impute_linear(out.select(*panel.columns, "_f"), "_f", "filled", size=size).drop("_f")


def reference_features(window: DataFrame, panel: DataFrame, values: DataFrame, variables: Sequence[str], k: int = 3, local_only: bool = False) -> DataFrame:
    """Channels of every window position: sensors, calendar, and k references per variable with a presence count.

    ``values`` are the references' pieces over the windows (``references.reference_windows``). They meet the sensors in one aggregate a window position.
    The local-only control keeps the shape and zeroes the reference channels.
    """
    zero, keys = F.lit(0.0), ["case_id", "site", "pos"]
    stamps = panel.select("site", "pos", "ts").distinct()
    own = window.select(*keys, "variable", "x", F.array().cast("array<double>").alias("r"))
    pieces = values.select("case_id", "site", "variable", "first", "values", F.posexplode(F.col("values")[0]).alias("_i", "_v"))
    refs = pieces.select("case_id", "site", (F.col("first") + F.col("_i")).alias("pos"), "variable", F.lit(None).cast("double").alias("x"), F.expr("transform(values, v -> v[_i])").alias("r"))
    of = lambda v, c: F.max(F.when(F.col("variable") == v, c))
    cols = [of(v, F.col("x")).alias(f"x_{v}") for v in variables]
    cols += [F.coalesce(of(v, F.get("r", F.lit(i - 1))), zero).alias(f"ref{i}_{v}") for v in variables for i in range(1, k + 1)]
    present = F.coalesce(F.sum(F.size(F.array_compact("r"))), F.lit(0)).cast("bigint").alias("refs_present")
    d = own.unionByName(refs).groupBy(*keys).agg(*cols, present).join(stamps, ["site", "pos"]).withColumns(calendar("ts"))
    names = [f"ref{i}_{v}" for v in variables for i in range(1, k + 1)]
    keep = [zero.alias(n) if local_only else F.col(n) for n in names]
    count = F.lit(0).cast("bigint").alias("refs_present") if local_only else F.col("refs_present")
    return d.select(*keys, *[f"x_{v}" for v in variables], "hour_sin", "hour_cos", "doy_sin", "doy_cos", *keep, count)
