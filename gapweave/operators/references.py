"""Cross-site references: alignment, per-case selection and ridge regression.

Statistics of a case leave out its hidden interval. They are never recomputed per case: the sums
over the whole series are computed once and the sums inside the interval are subtracted.

Pair sums are products of matrices: targets and their cases on one side, up to 256 references on the other form a tile that is read block by block of time;
counts, sums and products of all its pairs are small matrix products. No pair of series meets stamp by stamp, and a tile tells a case's best references alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gapweave.functions.exprs import micros
from gapweave.operators.impute import CASE_VAR
from gapweave.operators.series import SERIES, spread

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _bank(panel: DataFrame, roles: DataFrame, value: str) -> DataFrame:
    train = panel.join(roles.where("role = 'train'").select("site"), "site", "left_semi")
    return train.where(F.col(value).isNotNull()).select(F.col("site").alias("ref"), "variable", "ts", F.col(value).alias("y"))


#: References of a tile; target series, or cases of them, of a tile; cases of one row of a target. Stamps of a block lie within 30 days.
REFS, ROWS, SLICE, BLOCK_US = 256, 4096, 512, 30 * 24 * 3_600_000_000
#: Pairs of a case and a reference that are judged at a time.
PAIRS = 1 << 17


def _dense(at: pa.Array, values: pa.Array, stamps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Series as rows over ``stamps``: which stamps they have, which have a value, and the values (0 without)."""
    rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
    cols = np.searchsorted(stamps, at.flatten().to_numpy(zero_copy_only=False))
    flat = values.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((3, len(at), len(stamps)))
    out[0, rows, cols] = 1
    out[1, rows[known], cols[known]] = 1
    out[2, rows[known], cols[known]] = flat.drop_null().to_numpy(zero_copy_only=False)
    return out[0], out[1], out[2]


def _places(known: dict, names: list) -> np.ndarray:
    """Numbers of the names, new ones behind the known."""
    return np.fromiter((known.setdefault(n, len(known)) for n in names), dtype=np.int64, count=len(names))


def _grown(a: np.ndarray, *shape: int) -> np.ndarray:
    """``a`` with zeros behind it, as large as ``shape`` at least."""
    return np.pad(a, [(0, max(n - m, 0)) for n, m in zip(shape, a.shape, strict=True)])


class _Tile:
    """Sums of every target of a tile with every reference of it, and of what each case hides, added up block by block of time."""

    def __init__(self):
        self.targets, self.refs, self.cases = {}, {}, {}
        self.length, self.observed, self.full = np.zeros(0), np.zeros(0), np.zeros((7, 0, 0))
        self.hidden, self.h_observed, self.of = np.zeros((6, 0, 0)), np.zeros(0), np.zeros(0, np.int64)

    def add(self, block: pa.Table) -> None:
        column = lambda t, c: t[c].combine_chunks()
        refs = pa.compute.is_valid(block["ref"])
        a, b = block.filter(pa.compute.invert(refs)), block.filter(refs)
        ta, tb = _places(self.targets, list(zip(a["site"].to_pylist(), a["slice"].to_pylist(), strict=True))), _places(self.refs, b["ref"].to_pylist())
        lists = [column(x, c) for x in (a, b) for c in ("at", "v")]
        stamps = np.unique(np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (lists[0], lists[2])]))
        (have, mx, x), (_, my, y) = _dense(lists[0], lists[1], stamps), _dense(lists[2], lists[3], stamps)
        nt, nr = len(self.targets), len(self.refs)
        self.length, self.observed, self.full = _grown(self.length, nt), _grown(self.observed, nt), _grown(self.full, 7, nt, nr)
        self.length[ta] += have.sum(axis=1)
        self.observed[ta] += mx.sum(axis=1)
        grid = np.ix_(ta, tb)
        for s, m in zip(self.full, (have @ my.T, mx @ my.T, x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T, x @ y.T), strict=True):
            s[grid] += m
        self._hide(column(a, "cases"), column(a, "pos"), lists[0], ta, tb, stamps, (mx, x, my, y))

    def _hide(self, cases: pa.Array, pos: pa.Array, at: pa.Array, ta: np.ndarray, tb: np.ndarray, stamps: np.ndarray, series: tuple) -> None:
        """The sums inside the cases' intervals, as far as they lie in this block."""
        if not (flat := cases.flatten()):
            return
        row = np.repeat(np.arange(len(cases)), cases.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        start, end = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("start_pos", "end_pos"))
        at_case = _places(self.cases, list(zip(flat.field("case_id").to_pylist(), ta[row].tolist(), strict=True)))
        n = len(self.cases)
        self.hidden, self.h_observed, self.of = _grown(self.hidden, 6, n, len(self.refs)), _grown(self.h_observed, n), _grown(self.of, n)
        self.of[at_case] = ta[row]
        where = np.full((len(at), len(stamps)), -1, np.int64)  # positions over stamps; -1: the target has no such stamp
        rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy())
        where[rows, np.searchsorted(stamps, at.flatten().to_numpy(zero_copy_only=False))] = pos.flatten().to_numpy(zero_copy_only=False)
        mx, x, my, y = series
        yy, step = y * y, max(PAIRS // max(len(stamps), 1), 1)
        for lo in range(0, len(row), step):
            of = row[lo : lo + step]
            p = where[of]
            inside = (p >= start[lo : lo + step, None]) & (p <= end[lo : lo + step, None])
            m, v = mx[of] * inside, x[of] * inside
            self.h_observed[at_case[lo : lo + step]] += m.sum(axis=1)
            grid = np.ix_(at_case[lo : lo + step], tb)
            for s, q in zip(self.hidden, (m @ my.T, v @ my.T, m @ y.T, (v * v) @ my.T, m @ yy.T, v @ y.T), strict=True):
                s[grid] += q

    def admitted(self, min_coverage: float) -> np.ndarray:
        """Targets x references: enough coverage, a stamp in common, not the target itself."""
        sites, refs = np.array([t[0] for t in self.targets], dtype=object), np.array(list(self.refs), dtype=object)
        return (self.full[0] > 0) & (self.full[0] / self.length[:, None] >= min_coverage) & (sites[:, None] != refs[None, :])

    def pairs(self, min_coverage: float) -> dict:
        i, j = np.nonzero(self.admitted(min_coverage))
        sites, refs = [t[0] for t in self.targets], list(self.refs)
        found = {"site": [sites[k] for k in i], "ref": [refs[k] for k in j], "length": self.length[i].astype(np.int64), "observed": self.observed[i].astype(np.int64)}
        found |= {"ref_finite": self.full[0][i, j].astype(np.int64), "coverage": self.full[0][i, j] / self.length[i]}
        return found | {s: m[i, j] for s, m in zip(_SUMS, self.full[1:], strict=True)}

    def correlations(self, min_coverage: float, min_pairs: int, k: int | None) -> Iterator[dict]:
        """|r| of every case and admissible reference, or of each case's ``k`` best of this tile, a bounded number of pairs at a time."""
        ok, refs, n_refs = self.admitted(min_coverage), list(self.refs), len(self.refs)
        by_name = np.array(sorted(range(n_refs), key=lambda j: refs[j], reverse=True), dtype=np.int64)
        sites, ids = [t[0] for t in self.targets], [c for c, _ in self.cases]
        for lo in range(0, len(ids), step := max(PAIRS // max(n_refs, 1), 1)):
            of = self.of[lo : lo + step]
            n, sx, sy, sxx, syy, sxy = (f[of] - h[lo : lo + step] for f, h in zip(self.full[1:], self.hidden, strict=True))
            vx, vy = n * sxx - sx * sx, n * syy - sy * sy
            good = ok[of] & (n >= min_pairs) & ((self.observed[of] - self.h_observed[lo : lo + step]) >= min_pairs)[:, None] & (n >= 2) & (vx > 1e-12) & (vy > 1e-12)
            r = np.abs(np.divide(n * sxy - sx * sy, np.sqrt(np.where(good, vx, 1)) * np.sqrt(np.where(good, vy, 1))))
            key = np.floor(r * 1e9 + 0.5)
            if k is None or k >= n_refs:
                i, j = np.nonzero(good)
            else:  # the names settle ties: columns in falling order of names, one whole number a pair
                order = np.where(good, key, -1)[:, by_name].astype(np.int64) * n_refs + np.arange(n_refs)[::-1]
                best = by_name[np.argpartition(-order, k - 1, axis=1)[:, :k]]
                i = np.repeat(np.arange(len(of)), k)
                j = best.ravel()
                i, j = i[good[i, j]], j[good[i, j]]
            yield {"case_id": [ids[lo + q] for q in i], "site": [sites[q] for q in of[i]], "ref": [refs[q] for q in j], "pairs": n[i, j].astype(np.int64), "abs_r": r[i, j], "_key": key[i, j]}


def _tiles(series: DataFrame, bank: DataFrame, cases: DataFrame | None, finish: Callable[[_Tile], Iterator[dict]], schema: T.StructType, refs: int = REFS, rows: int = ROWS, block_us: int = BLOCK_US) -> DataFrame:
    """``finish`` of every tile: all of a block of ``series(site, variable, pos, ts, x)``, with their ``cases``, against a block of ``bank(ref, variable, ts, y)``.

    Rows of a tile arrive sorted by time, a block of it at once, and only sums over the tile's pairs are kept, so neither a long series nor many cases of
    one target meet in a group. What leaves a tile is what ``finish`` gives; sums of pairs are never shuffled.
    """
    cut, at = F.expr(f"at div {int(block_us)}").alias("_block"), micros("ts").alias("at")
    left = series.select(*SERIES, "pos", at, F.col("x").alias("v")).groupBy(*SERIES, cut).agg(F.collect_list(F.struct("at", "v", "pos")).alias("c"))
    right = bank.select("ref", "variable", at, F.col("y").alias("v")).groupBy("ref", "variable", cut).agg(F.collect_list(F.struct("at", "v")).alias("c"))
    case_type = None if cases is None else cases.schema["case_id"].dataType
    hides = T.ArrayType(T.StructType([T.StructField("case_id", case_type or T.LongType()), T.StructField("start_pos", T.LongType()), T.StructField("end_pos", T.LongType())]))
    if cases is None:
        left = left.withColumns({"slice": F.lit(0), "cases": F.lit(None).cast(hides)})
    else:
        n = cases.groupBy(*SERIES).agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("_n"))
        hidden = F.struct("case_id", F.col("start_pos").cast("long").alias("start_pos"), F.col("end_pos").cast("long").alias("end_pos"))
        sliced = cases.join(n, list(SERIES)).withColumn("slice", F.pmod(F.xxhash64("case_id"), F.col("_n")).cast("int"))
        left = left.join(sliced.groupBy(*SERIES, "slice").agg(F.collect_list(hidden).alias("cases")), list(SERIES))
    # how many rows and references a variable has; only the number of tiles follows
    weigh = cases if cases is not None else series.select(*SERIES).distinct()
    most = lambda d: int(d.groupBy("variable").agg(F.sum("_c").alias("_c")).agg(F.max("_c")).first()[0] or 0)
    n_l = max(-(-most(weigh.groupBy("variable").agg(F.count(F.lit(1)).alias("_c"))) // rows), 1)
    n_r = max(-(-most(bank.groupBy("variable").agg(F.approx_count_distinct("ref").alias("_c"))) // refs), 1)
    deal = lambda k, n: F.pmod(F.xxhash64(*k), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["variable", "_l", "_r", "_block"]
    none = lambda t: F.lit(None).cast(t)
    left = left.select("variable", deal(["site", "variable", "slice"], n_l).alias("_l"), "_block", "site", "slice", none(bank.schema["ref"].dataType).alias("ref"), "c.at", "c.v", "c.pos", "cases").withColumn("_r", every(n_r))
    right = right.select("variable", deal(["ref", "variable"], n_r).alias("_r"), "_block", none(series.schema["site"].dataType).alias("site"), none("int").alias("slice"), "ref", "c.at", "c.v", none("array<bigint>").alias("pos"), none(hides).alias("cases")).withColumn("_l", every(n_l))
    dealt = left.unionByName(right).repartition("variable", "_l", "_r").sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(name: tuple, tile: _Tile) -> Iterator[pa.RecordBatch]:
            for found in finish(tile):
                size = len(found["ref"])
                if size:
                    yield pa.RecordBatch.from_arrays([pa.array([name[0]] * size if f.name == "variable" else found[f.name], to_arrow_type(f.dataType)) for f in schema], names=schema.names)

        name, tile = None, _Tile()
        for block, rows in _runs(batches, key):
            if name != block[:3]:
                if name is not None:
                    yield from made(name, tile)
                name, tile = block[:3], _Tile()
            tile.add(rows)
        if name is not None:
            yield from made(name, tile)

    return dealt.mapInArrow(run, schema)


def _runs(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows that agree in ``names``, one table after the other."""
    held, last = [], None
    for b in batches:
        keys = list(zip(*[b.column(n).to_pylist() for n in names], strict=True))
        starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[lo] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = keys[lo]
    if held:
        yield last, pa.Table.from_batches(held)


def _able(targets: DataFrame, bank: DataFrame, min_coverage: float) -> DataFrame:
    """The bank without references that have fewer values than the shortest target of ``targets(site, variable)`` needs."""
    least = targets.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_len")).groupBy("variable").agg(F.min("_len").alias("_least"))
    able = bank.groupBy("ref", "variable").agg(F.count(F.lit(1)).alias("_have")).join(least, "variable").where(F.col("_have") >= min_coverage * F.col("_least"))
    return bank.join(able.select("ref", "variable"), ["ref", "variable"], "left_semi")


def align_references(targets: DataFrame, panel: DataFrame, roles: DataFrame, value: str = "value", min_coverage: float = 0.8) -> DataFrame:
    """Training sites' same-variable series on each target's stamps, with pair sums.

    A target is never its own reference. A reference with fewer values than the shortest target needs is left out before pairs are made.
    """
    rows = targets.select(*SERIES, "pos", "ts", F.col(value).alias("x"))
    bank = _able(rows, _bank(panel, roles, value), min_coverage)
    whole, real = T.LongType(), T.DoubleType()
    made = {**{c: rows.schema[c].dataType for c in SERIES}, "ref": bank.schema["ref"].dataType, "ref_finite": whole, **dict.fromkeys(_SUMS, real), "length": whole, "observed": whole, "coverage": real}

    def finish(tile: _Tile) -> Iterator[dict]:
        yield tile.pairs(min_coverage)

    return _tiles(rows, bank, None, finish, T.StructType([T.StructField(c, t) for c, t in made.items()]), rows=2 * REFS)


def reference_correlations(
    spans: DataFrame, panel: DataFrame, roles: DataFrame, value: str = "value", min_coverage: float = 0.8, min_pairs: int = 500, k: int | None = None, **sizes: int
) -> DataFrame:
    """|r| of every admissible reference of every case x variable, without the hidden interval; with ``k``, each tile gives a case's ``k`` best alone.

    ``_key`` is |r| in whole steps of 1e-9, by which references are ordered. ``sizes`` are those of the tiles.
    """
    rows = panel.join(spans.select(*SERIES).distinct(), list(SERIES), "left_semi").select(*SERIES, "pos", "ts", F.col(value).alias("x"))
    bank = _able(rows, _bank(panel, roles, value), min_coverage)
    made = {**{c: spans.schema[c].dataType for c in CASE_VAR}, "ref": bank.schema["ref"].dataType, "pairs": T.LongType(), "abs_r": T.DoubleType(), "_key": T.DoubleType()}
    finish = lambda tile: tile.correlations(min_coverage, min_pairs, k)
    return _tiles(rows, bank, spans.select(*CASE_VAR, "start_pos", "end_pos"), finish, T.StructType([T.StructField(c, t) for c, t in made.items()]), **sizes)


def select_references(
    spans: DataFrame,
    panel: DataFrame,
    roles: DataFrame,
    value: str = "value",
    k: int = 3,
    min_coverage: float = 0.8,
    min_pairs: int = 500,
    **sizes: int,
) -> DataFrame:
    """The ``k`` best references per case x variable, ordered by (|r|, name) descending.

    A tile hands on ``k`` references a case at most, so rows here are cases x tiles of references, never cases x references.
    """
    d = reference_correlations(spans, panel, roles, value, min_coverage, min_pairs, k, **sizes)
    # whole steps keep the order independent of the summation order; the name settles ties
    w = Window.partitionBy(*CASE_VAR).orderBy(F.col("_key").desc(), F.col("ref").desc())
    return d.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k).drop("_key")


def _solve(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Coefficients of many centred k x k ridge systems by LDL' factors. An absent reference (all zeros) gets 0."""
    safe = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y != 0)
    k = b.shape[1]
    l, d, z, w = np.zeros_like(a), np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    for j in range(k):
        d[:, j] = a[:, j, j] + alpha - (l[:, j, :j] ** 2 * d[:, :j]).sum(axis=1)
        for i in range(j + 1, k):
            l[:, i, j] = safe(a[:, j, i] - (l[:, i, :j] * l[:, j, :j] * d[:, :j]).sum(axis=1), d[:, j])
    for j in range(k):  # forward, then backward substitution
        z[:, j] = b[:, j] - (l[:, j, :j] * z[:, :j]).sum(axis=1)
    for j in reversed(range(k)):
        w[:, j] = safe(z[:, j], d[:, j]) - (l[:, j + 1 :, j] * w[:, j + 1 :]).sum(axis=1)
    return w


class _Chosen:
    """Cases of one target with their chosen references; ``block`` gets the filled references (a row each) block by block of time."""

    def __init__(self, cases: pa.Array):
        flat = cases.flatten()
        self.ids = flat.field("case_id").to_pylist()
        self.lo, self.hi = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("lo", "hi"))
        names = flat.field("refs").to_pylist()
        self.refs = {n: i for i, n in enumerate(sorted({n for r in names for n in r}))}
        self.of = [np.array([self.refs[n] for n in r], dtype=np.int64) for r in names]

    def parts(self, p: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Cases whose interval meets the positions ``p``, with the places from and to."""
        first, last = np.searchsorted(p, self.lo), np.searchsorted(p, self.hi, side="right")
        for i in np.nonzero(first < last)[0]:
            yield i, first[i], last[i]

    def block(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        raise NotImplementedError

    def finish(self) -> Iterator[dict]:
        return iter(())


class _Windows(_Chosen):
    """Values of the references over each case's interval, a piece for every block it meets."""

    def block(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        found = [(i, p[a], [[None if v != v else v for v in r] for r in y[self.of[i], a:b].tolist()]) for i, a, b in self.parts(p)]
        if found:
            yield {"case_id": [self.ids[i] for i, _, _ in found], "first": [f for _, f, _ in found], "values": [v for _, _, v in found]}


class _Ridge(_Chosen):
    """Gram sums of all references of a target, less what each case hides."""

    def __init__(self, cases: pa.Array, alpha: float, min_fit: int):
        super().__init__(cases)
        self.alpha, self.min_fit, n = alpha, min_fit, len(self.refs)
        self.m, self.sy, self.s, self.p, self.q = 0.0, 0.0, np.zeros(n), np.zeros(n), np.zeros((n, n))
        self.hidden: dict[int, list] = {}

    def block(self, p: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[dict]:
        seen = ~np.isnan(x)
        x, y = np.where(seen, x, 0.0), np.nan_to_num(y)
        self.m += seen.sum()
        self.sy += x.sum()
        self.s += y @ seen
        self.p += y @ x
        self.q += (y * seen) @ y.T
        for i, a, b in self.parts(p):
            self.hidden.setdefault(i, []).append((p[a:b], x[a:b], seen[a:b], y[self.of[i], a:b]))
        return iter(())

    def finish(self) -> Iterator[dict]:
        if not self.hidden:
            return
        of = list(self.hidden)
        cells = [[np.concatenate(c, axis=-1) for c in zip(*self.hidden[i], strict=True)] for i in of]
        n, k = len(of), max(len(self.of[i]) for i in of)
        m, sy, s, b, q = np.zeros(n), np.zeros(n), np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k, k))
        for c, (i, (_, x, seen, y)) in enumerate(zip(of, cells, strict=True)):
            r, e = self.of[i], len(self.of[i])
            m[c], sy[c] = self.m - seen.sum(), self.sy - x.sum()
            s[c, :e], b[c, :e], q[c, :e, :e] = self.s[r] - y @ seen, self.p[r] - y @ x, self.q[np.ix_(r, r)] - (y * seen) @ y.T
        size = np.maximum(m, 1)
        w = _solve(q - s[:, :, None] * s[:, None, :] / size[:, None, None], b - s * (sy / size)[:, None], self.alpha)
        w0 = (sy - (w * s).sum(axis=1)) / size
        good = [c for c in range(n) if m[c] >= self.min_fit]
        if good:
            made = [w0[c] + w[c, : len(self.of[of[c]])] @ cells[c][3] for c in good]
            at = [cells[c][0] for c in good]
            yield {"case_id": [self.ids[of[c]] for c, a in zip(good, at, strict=True) for _ in a], "pos": np.concatenate(at), "y_hat": np.concatenate(made)}


def _line_at(p: np.ndarray, at: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Linear in position between the observations ``v`` at ``at``, ends held; NaN without any."""
    if not len(at):
        return np.full(len(p), np.nan)
    j = np.searchsorted(at, p)
    hi, lo = np.minimum(j, len(at) - 1), np.maximum(np.where((j < len(at)) & (at[np.minimum(j, len(at) - 1)] == p), j, j - 1), 0)
    step = at[hi] - at[lo]
    return v[lo] + (v[hi] - v[lo]) * np.divide(p - at[lo], step, out=np.zeros(len(p)), where=step != 0)


#: Cells inside the intervals of a tile's cases.
CELLS = 1 << 18


def _with_references(
    spans: DataFrame, chosen: DataFrame, panel: DataFrame, value: str, lo: str, hi: str, make: Callable[[pa.Array], _Chosen], columns: dict[str, T.DataType], block_us: int = BLOCK_US,
) -> DataFrame:
    """``make`` of the cases of every target (at most about ``SLICE`` at once) over the target's grid with all their references filled on it.

    ``chosen`` references are read as packed blocks of time, once for a target and slice of its cases, however many cases or sets of references share them; a block has the
    nearest observations before and after it, so blocks are filled one by one and no series meets in a group. Only stamps of the target's grid count, and that is
    evenly spaced.
    """
    at, key = micros("ts"), [*SERIES, "slice"]
    ids = spans.schema["case_id"].dataType
    sets = chosen.groupBy(*CASE_VAR).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda s: s["ref"]).alias("refs"))
    cases = spans.select(*CASE_VAR, F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")).join(sets, list(CASE_VAR))
    n = cases.groupBy(*SERIES).agg(F.ceil(F.greatest(F.count(F.lit(1)) / SLICE, F.sum(F.col("hi") - F.col("lo") + 1) / CELLS)).cast("int").alias("_n"))
    cases = cases.join(n, list(SERIES)).withColumn("slice", F.pmod(F.xxhash64("case_id"), F.col("_n")).cast("int"))
    triples = cases.select(*key, F.explode("refs").alias("ref")).distinct()
    packed = cases.groupBy(*key).agg(F.collect_list(F.struct("case_id", "lo", "hi", "refs")).alias("cases"))

    cells = panel.select(*SERIES, "pos", at.alias("_at"), F.col(value).cast("double").alias("v")).withColumn("_block", F.expr(f"_at div {int(block_us)}"))
    targets = cells.join(cases.select(*SERIES).distinct(), list(SERIES), "left_semi")
    grid = targets.groupBy(*SERIES).agg(F.min("_at").alias("_t0"), F.max("_at").alias("_t1"), F.min("pos").alias("_p0"), F.max("pos").alias("_p1"))
    grid = grid.withColumn("_step", F.greatest(F.expr("(_t1 - _t0) div greatest(_p1 - _p0, 1)"), F.lit(1)))
    own = targets.groupBy(*SERIES, "_block").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("c"))
    bank = cells.where("v is not null").join(chosen.select("ref", "variable").distinct().withColumnRenamed("ref", "site"), list(SERIES), "left_semi")
    bank = bank.groupBy(F.col("site").alias("ref"), "variable", "_block").agg(F.array_sort(F.collect_list(F.struct("_at", "v"))).alias("o"))
    slots = triples.join(own.select(*SERIES, "_block").join(grid, list(SERIES)), list(SERIES))
    seen = F.expr("transform(filter(o, e -> e._at between _t0 and _t1 and (e._at - _t0) % _step = 0), e -> struct(_p0 + (e._at - _t0) div _step as pos, e.v as v))")
    slots = slots.join(bank, ["ref", "variable", "_block"], "left").select(*key, "_block", "ref", F.coalesce(seen, F.expr("array()").cast("array<struct<pos:bigint,v:double>>")).alias("c"))

    none = lambda t: F.lit(None).cast(t)
    hides = packed.schema["cases"].dataType
    left = own.join(packed.select(*key), list(SERIES)).select(*key, "_block", none("string").alias("ref"), "c", none(hides).alias("cases"))
    head = packed.select(*key, none("bigint").alias("_block"), none("string").alias("ref"), none(own.schema["c"].dataType).alias("c"), "cases")
    dealt = spread(slots.withColumn("cases", none(hides)).unionByName(left).unionByName(head), *key)
    series = lambda o: Window.partitionBy(*key, "ref").orderBy(o)
    edge = lambda o: F.last(F.when(F.size("c") > 0, F.element_at("c", -1 if o is before else 1)), ignorenulls=True).over(series(o).rowsBetween(Window.unboundedPreceding, -1))
    before, after = F.col("_block").asc_nulls_first(), F.col("_block").desc_nulls_last()
    dealt = dealt.withColumns({"_before": edge(before), "_after": edge(after)}).sortWithinPartitions(*key, "_block")
    dealt = dealt.select(*key, "_block", "ref", F.col("c.pos").alias("pos"), F.col("c.v").alias("v"), "_before", "_after", "cases")
    schema = T.StructType([T.StructField("case_id", ids), *[T.StructField(c, spans.schema[c].dataType) for c in SERIES], *[T.StructField(c, t) for c, t in columns.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(name: tuple, parts: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            for found in parts:
                found |= {c: [x] * len(found["case_id"]) for c, x in zip(SERIES, name, strict=False)}
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], to_arrow_type(f.dataType)) for f in schema], names=schema.names)

        name, tile = None, None
        for block, rows in _runs(batches, [*key, "_block"]):
            if block[:3] != name:
                if tile is not None:
                    yield from made(name, tile.finish())
                name, tile = block[:3], make(rows["cases"].combine_chunks())
                continue
            refs, (pos, v) = rows["ref"].to_pylist(), (rows[c].combine_chunks() for c in ("pos", "v"))
            near = [rows[c].to_pylist() for c in ("_before", "_after")]
            y, p, x = [None] * len(tile.refs), None, None
            arrays = [(pos[i].values.to_numpy(zero_copy_only=False), v[i].values.to_numpy(zero_copy_only=False)) for i in range(len(refs))]
            mine = refs.index(None)
            p, x = arrays[mine][0], arrays[mine][1].astype(float)
            for i, ref in enumerate(refs):
                if i != mine:
                    ends = [[e[i]] if e[i] else [] for e in near]
                    at = [np.array([e["pos"] for e in ends[0]], dtype=np.int64), arrays[i][0].astype(np.int64), np.array([e["pos"] for e in ends[1]], dtype=np.int64)]
                    of = [np.array([e["v"] for e in ends[0]]), arrays[i][1].astype(float), np.array([e["v"] for e in ends[1]])]
                    y[tile.refs[ref]] = _line_at(p, np.concatenate(at), np.concatenate(of))
            yield from made(name, tile.block(p, x, np.array(y)))
        if tile is not None:
            yield from made(name, tile.finish())

    return dealt.mapInArrow(run, schema)


def reference_windows(spans: DataFrame, chosen: DataFrame, panel: DataFrame, value: str, lo: str, hi: str, **sizes: int) -> DataFrame:
    """Chosen references filled linearly on the target's grid, over [``lo``, ``hi``] of every case x variable, in pieces.

    Columns: case_id, site, variable, ``first`` (position) and ``values``: an array for each rank, one value a position from ``first`` on.
    """
    return _with_references(spans, chosen, panel, value, lo, hi, _Windows, {"first": T.LongType(), "values": T.ArrayType(T.ArrayType(T.DoubleType()))}, **sizes)


def case_ridge(spans: DataFrame, chosen: DataFrame, panel: DataFrame, value: str = "value", alpha: float = 1.0, min_fit: int = 500, **sizes: int) -> DataFrame:
    """Ridge of the target on all its chosen references, fitted outside the gap, intercept free.

    Gram sums belong to pairs of references of a target; every case takes its own set's and subtracts its hidden interval. Nothing is as large as
    cases x positions, also where every case has a set of its own.
    """
    make = lambda cases: _Ridge(cases, alpha, min_fit)
    return _with_references(spans, chosen, panel, value, "start_pos", "end_pos", make, {"pos": T.LongType(), "y_hat": T.DoubleType()}, **sizes)


def reference_audit(spans: DataFrame, chosen: DataFrame) -> DataFrame:
    """n_references and the chosen names of every case x variable."""
    c = chosen.groupBy(*CASE_VAR).agg(
        F.count(F.lit(1)).alias("n_references"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "ref"))), lambda s: s["ref"]), ",").alias("references"),
    )
    d = spans.select(*CASE_VAR).join(c, list(CASE_VAR), "left")
    return d.select(*CASE_VAR, F.coalesce("n_references", F.lit(0)).alias("n_references"), F.coalesce("references", F.lit("")).alias("references"))


def reference_concentration(chosen: DataFrame, top: int = 5) -> tuple[DataFrame, DataFrame]:
    """Slots per reference with rank and share, overall ('all') and per variable; and the top-n share."""
    scopes = chosen.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("variable"))))
    c = scopes.groupBy("scope", "ref").agg(F.count(F.lit(1)).alias("slots"))
    total = Window.partitionBy("scope")
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.col("slots").desc(), "ref")).cast("bigint")
    c = c.select("scope", "ref", rank.alias("rank"), "slots", (F.col("slots") / F.sum("slots").over(total)).alias("share"))
    t = c.groupBy("scope").agg(F.sum(F.when(F.col("rank") <= top, F.col("share"))).alias("top_share"))
    return c, t


def same_group_fraction(chosen: DataFrame, groups: DataFrame) -> DataFrame:
    """Share of slots whose reference has the target's group (site, grp), per variable and target group."""
    a = groups.select("site", F.col("grp").alias("target_group"))
    b = groups.select(F.col("site").alias("ref"), F.col("grp").alias("ref_group"))
    d = chosen.join(a, "site").join(b, "ref")
    same = F.col("target_group") == F.col("ref_group")
    return d.groupBy("variable", "target_group").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if(same).alias("same_slots"), (F.count_if(same) / F.count(F.lit(1))).alias("same_fraction")
    )


