"""Joint forecasts of all variables of a site from their common past: vector autoregression.

A run is forecast from the cells before it alone; no value of any variable inside the run is read. The lagged values of all variables
are the covariates of each, so one set of block normal equations gives all coefficients. Coefficients form a companion matrix, and the cell ``h`` steps
into the run is its ``h``-th power times the last known state. Runs of a site that begin at the same position have the same past, so they share one fit;
fits and powers of many pasts are products of stacked matrices inside a task, and a past meets the panel in one task without being shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gapweave.operators.impute import CASE_VAR
from gapweave.operators.masking import home_bucket, home_rows
from gapweave.operators.series import CHUNK, SERIES, observed_neighbours, spread

#: Pasts that are fitted, and runs that are forecast, at a time; cells of a run that are made before they are handed on.
PASTS, RUNS, CELLS = 1024, 2048, 512


def past_vectors(spans: DataFrame, panel: DataFrame, ctx: int, value: str, variables: Sequence[str], size: int = CHUNK) -> DataFrame:
    """(site, run_start, z): values of all ``variables`` at each of the ``ctx`` positions before every start of a run, one array a past in order of positions.

    A missing cell takes the previous observation inside the context, else the next one before the run, else zero.
    """
    near = observed_neighbours(panel, SERIES, value, size)
    one = F.struct("variable", F.struct("prev_pos", "prev_val", "next_pos", "next_val").alias("v"))
    wide = near.groupBy("site", "pos").agg(F.map_from_entries(F.collect_list(one)).alias("near"))
    starts = spans.select("site", "run_start").distinct().withColumns({"_lo": F.greatest(F.col("run_start") - ctx, F.lit(0)), "_hi": F.col("run_start") - 1}).where("_lo <= _hi")
    keys = ("site", "_bk")
    starts = spread(starts.withColumn("_bk", home_bucket("_lo", ctx)), *keys)
    d = starts.join(spread(home_rows(wide, ctx), *keys), list(keys)).where("pos between _lo and _hi")

    def filled(v: str) -> Column:
        c = F.element_at("near", F.lit(v))
        return F.coalesce(F.when(c["prev_pos"] >= F.col("_lo"), c["prev_val"]).when(c["next_pos"] <= F.col("_hi"), c["next_val"]), F.lit(0.0))

    cell = F.struct("pos", F.array(*[filled(v) for v in variables]).alias("z"))
    past = d.groupBy(*keys, "run_start").agg(F.array_sort(F.collect_list(cell)).alias("_z"))
    return past.select("site", "run_start", F.flatten(F.transform("_z", lambda c: c["z"])).alias("z"))


def fit(z: np.ndarray, lags: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Companion matrices and last states of many pasts ``z`` (pasts x positions x variables, more positions than ``lags``): a state is 1, then ``lags`` vectors, newest first."""
    count, n = z.shape[2], z.shape[1]
    k = count * lags
    x = np.concatenate([np.ones((len(z), n - lags, 1)), *[z[:, lags - i : n - i] for i in range(1, lags + 1)]], axis=2)
    turned = x.transpose(0, 2, 1)
    penalty = alpha * np.eye(k + 1)
    penalty[0, 0] = 0
    m = np.zeros((len(z), k + 1, k + 1))
    m[:, 0, 0] = 1
    m[:, 1 : count + 1] = np.linalg.solve(turned @ x + penalty, turned @ z[:, lags:]).transpose(0, 2, 1)
    rest = np.arange(k - count)
    m[:, count + 1 + rest, 1 + rest] = 1
    return m, np.concatenate([np.ones((len(z), 1)), z[:, : n - lags - 1 : -1].reshape(len(z), k)], axis=1)


def _ahead(m: np.ndarray, s: np.ndarray, h: np.ndarray) -> np.ndarray:
    """States ``h`` steps (1 at least) on: a product for every bit of ``h``."""
    s, left = s.copy(), h.copy()
    while True:
        odd = (left & 1) == 1
        s[odd] = (m[odd] @ s[odd][:, :, None])[:, :, 0]
        left >>= 1
        if not left.any():
            return s
        m = m @ m


def impute_multivariate_past(
    spans: DataFrame, panel: DataFrame, ctx: int, value: str, variables: Sequence[str], lags: int = 1, alpha: float = 1.0, min_side: int = 48, size: int = CHUNK,
) -> DataFrame:
    """Hidden cells forecast jointly with all ``variables`` from the ``ctx`` positions before their run, ridge penalty ``alpha``.

    Runs with fewer than ``min_side`` positions before them, or no more than ``lags``, get no rows and are left to the caller's fill. Values should be scaled.
    """
    count, place = len(variables), {v: i + 1 for i, v in enumerate(variables)}
    hidden = F.struct("case_id", "variable", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))
    runs = spans.where(F.col("variable").isin(list(variables))).groupBy("site", F.col("run_start").cast("long").alias("run_start")).agg(F.collect_list(hidden).alias("runs"))
    past = past_vectors(spans, panel, ctx, value, variables, size).where(F.size("z") >= count * max(min_side, lags + 1))
    src = spread(runs.join(past, ["site", "run_start"]), "site", "run_start").select("site", "run_start", "z", "runs")
    schema = T.StructType([*[T.StructField(c, spans.schema[c].dataType) for c in CASE_VAR], T.StructField("pos", T.LongType()), T.StructField("y_hat", T.DoubleType())])

    def forecast(sites: list, starts: np.ndarray, z: np.ndarray, runs: pa.Array) -> Iterator[pa.RecordBatch]:
        m, s = fit(z, lags, alpha)
        flat, of = runs.flatten(), np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
        ids, names = flat.field("case_id"), flat.field("variable").to_pylist()
        first, last = (flat.field(f).to_numpy() for f in ("start_pos", "end_pos"))
        at = np.array([place[v] for v in names])
        for lo in range(0, len(of), RUNS):
            mine = slice(lo, lo + RUNS)
            own, a, b = of[mine], first[mine], last[mine]
            step, state = m[own], _ahead(m[own], s[own], a - starts[own] + 1)
            while True:
                n = int(min((b - a).max() + 1, CELLS))
                y = np.zeros((len(own), n))
                for i in range(n):
                    y[:, i] = state[np.arange(len(own)), at[mine]]
                    state = (step @ state[:, :, None])[:, :, 0]
                pos = a[:, None] + np.arange(n)
                run, cell = np.nonzero(pos <= b[:, None])
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(lo + run)), pa.array([sites[own[r]] for r in run]), pa.array([names[lo + r] for r in run]), pa.array(pos[run, cell]), pa.array(y[run, cell])], names=schema.names
                )
                a = a + n
                if not (a <= b).any():
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("z").value_lengths().to_numpy()
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for lo in range(0, len(rows), PASTS):
                    part = batch.take(pa.array(rows[lo : lo + PASTS]))
                    z = part.column("z").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1, count)
                    for out in forecast(part.column("site").to_pylist(), part.column("run_start").to_numpy(), z, part.column("runs")):
                        yield out.cast(pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema]))

    return src.mapInArrow(run, schema)
