"""Bootstrap means: draws are counted where the values are, so neither draws nor picks are rows.

A pick is ``hash_order(seed, b, j) mod n``. The hashes of a stretch of draws are made once in a task for all groups of its tile, whatever their sizes; counting picks
gives a matrix of draws x units, and the means are one product.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from gapweave.operators.series import spread

#: Units of a row; values of a tile, unless one group has more; hashes of a task at least; tasks of a tile at most; cells of a matrix of draws x units.
BLOCK, TILE, HASHES, STRETCHES, CELLS = 4096, 1 << 21, 1 << 20, 64, 1 << 18

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = tuple(int(abs(math.sin(i + 1)) * 2**32) for i in range(64))
#: The last three of the 64 steps do not reach the first word of the digest.
_STEPS, _LANES = 61, 16_384


def _first_word(words: list[np.ndarray | np.uint32]) -> np.ndarray:
    """First word of the MD5 of one-block messages; ``words`` are the 16 words of the block, arrays of one length or single numbers."""
    size = max(np.size(w) for w in words)
    a, b, c, d = (np.full(size, x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(_STEPS):
        turn, g = i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        if np.ndim(words[g]):
            f += words[g]
            f += np.uint32(_SINES[i])
        else:
            f += np.uint32((int(words[g]) + _SINES[i]) & 0xFFFFFFFF)
        s = _SHIFTS[turn][i % 4]
        np.left_shift(f, np.uint32(s), out=t), np.right_shift(f, np.uint32(32 - s), out=f), np.bitwise_or(f, t, out=f)
        f += b
        a, d, c, b, f = d, c, b, f, a
    return b + np.uint32(_START[0])


def _widths(first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of numbers with the same count of digits, and that count."""
    width = len(str(first))
    while first < last:
        to = min(last, 10**width)
        yield first, to, width
        first, width = to, width + 1


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    return (numbers[:, None] // 10 ** np.arange(width - 1, -1, -1) % 10 + 48).astype(np.uint8)


def draw_hashes(seed: int, first: int, last: int, n: int) -> np.ndarray:
    """``hash_order(seed, b, j)`` for b from ``first`` to before ``last`` (rows) and j below ``n`` (columns)."""
    out = np.empty((last - first, n), np.uint32)
    head = np.frombuffer(f"{seed}|".encode(), np.uint8)
    for b0, b1, b_width in _widths(first, last):
        b_text = _digits(np.arange(b0, b1), b_width)
        for j0, j1, j_width in _widths(0, n):
            j_text = _digits(np.arange(j0, j1), j_width)
            middle = len(head) + b_width
            size = middle + 1 + j_width
            if size > 55:
                raise ValueError("a seed of so many digits does not fit one block")
            used, flat = -(-(size + 1) // 4), np.empty((b1 - b0) * (j1 - j0), np.uint32)
            for at in range(0, len(flat), _LANES):
                b, j = np.divmod(np.arange(at, min(len(flat), at + _LANES)), j1 - j0)
                text = np.zeros((len(b), 4 * used), np.uint8)
                text[:, : len(head)], text[:, len(head) : middle], text[:, middle] = head, b_text[b], ord("|")
                text[:, middle + 1 : size], text[:, size] = j_text[j], 0x80
                words: list[np.ndarray | np.uint32] = [np.uint32(0)] * 16
                words[:used] = np.ascontiguousarray(text.view("<u4").T)
                words[14] = np.uint32(8 * size)
                flat[at : at + len(b)] = _first_word(words).byteswap()
            out[b0 - first : b1 - first, j0:j1] = flat.reshape(b1 - b0, -1)
    return out


def _means(values: np.ndarray, picks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Means of each column (0 for NULL, which adds nothing in SQL either) over the picks of each draw."""
    finite = np.isfinite(values).all(axis=0)
    sums = counts @ np.where(finite, values, 0.0)
    for c in np.flatnonzero(~finite):  # NaN and infinity count where they are drawn, and nowhere else
        sums[:, c] = values[:, c][picks].sum(axis=1)
    return sums / len(values)


def _drawer(keys: Sequence[str], cols: Sequence[str], draws: int, seed: int, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def draw(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("_g", "ascending"), ("_k", "ascending")])
        group = rows.column("_g").to_numpy()
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = rows.column("_n").to_numpy()[starts]
        first, per = int(rows.column("_b").to_numpy()[0]), int(rows.column("_per").to_numpy()[0])
        last = min(draws, first + per)
        arrays = [pa.concat_arrays(c.chunks) if (c := rows.column(x)).num_chunks != 1 else c.chunk(0) for x in cols]
        flat = [a.flatten() for a in arrays]
        known = [np.asarray(f.is_valid()) for f in flat] if any(f.null_count for f in flat) else None
        offsets = np.r_[0, np.cumsum(arrays[0].value_lengths().to_numpy())]
        begins = offsets[starts]
        data = [f.fill_null(0.0).to_numpy(zero_copy_only=False) for f in flat]
        by_size: dict[int, list[int]] = {}
        for g, n in enumerate(sizes):
            by_size.setdefault(int(n), []).append(g)
        stack = lambda parts, n: np.stack([p[begins[g] : begins[g] + n] for g in by_size[n] for p in parts], axis=1)
        values = {n: stack(data, n) for n in by_size}
        valid = {} if known is None else {n: stack(known, n).astype(float) for n in by_size}
        out = np.empty((len(sizes), last - first, len(cols)))
        none = np.zeros(out.shape, bool)  # only NULLs were drawn
        step = max(1, CELLS // int(max(sizes)))
        for at in range(first, last, step):
            to = min(last, at + step)
            hashes = draw_hashes(seed, at, to, int(max(sizes)))
            for n, gs in by_size.items():
                shaped = lambda m: m.reshape(to - at, len(gs), len(cols)).swapaxes(0, 1)  # noqa: B023, E731
                picks = (hashes[:, :n] % np.uint32(n)).astype(np.int64)
                cells = picks + n * np.arange(to - at)[:, None]
                counts = np.bincount(cells.ravel(), minlength=n * (to - at)).reshape(to - at, n).astype(float)
                out[gs, at - first : to - first] = shaped(_means(values[n], picks, counts))
                if valid:
                    none[gs, at - first : to - first] = shaped(counts @ valid[n] == 0)
        rows_of = pa.array(np.repeat(starts, last - first))
        result = [rows.column(k).combine_chunks().take(rows_of) for k in keys] + [pa.array(np.tile(np.arange(first, last), len(sizes)), pa.int32())]
        result += [pa.array(out[:, :, c].ravel(), pa.float64(), mask=none[:, :, c].ravel()) for c in range(len(cols))]
        return pa.Table.from_arrays(result, names=schema.names).cast(schema)

    return draw


def numbered(units: DataFrame, keys: Sequence[str], unit: str, many: bool = False) -> DataFrame:
    """Units of each group numbered by name from 0 (``_i``), with their number ``_n``. ``many`` units (records, say) are written in a range sort, so no task orders a group."""
    if not many:
        group = Window.partitionBy(*keys)
        return units.withColumns({"_i": F.row_number().over(group.orderBy(unit)).cast("bigint") - 1, "_n": F.count(F.lit(1)).over(group)})
    from gapweave.plans.storage import sequential_ids

    d = sequential_ids(units, [*keys, unit], "_id", "units")
    return d.join(d.groupBy(*keys).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")), list(keys)).withColumn("_i", F.col("_id") - F.col("_first")).drop("_id", "_first")


def bootstrap_means(units: DataFrame, keys: Sequence[str], cols: Sequence[str], draws: int = 10_000, seed: int = 42, unit: str = "site", many: bool = False) -> DataFrame:
    """Mean of every column over each resample (keys, b). Columns of a row share their draws.

    Each group's units are numbered by name; draw (b, j) picks unit hash(seed, b, j) mod n. Values of the groups, packed by blocks of units, are dealt to tiles, and each
    tile to tasks by stretches of draws: what is shuffled are values, ``STRETCHES`` times at most, and one row a group and draw.
    """
    keys, cols = list(keys), list(cols)
    d = numbered(units.select(*keys, unit, *[F.col(c).cast("double").alias(c) for c in cols]), keys, unit, many)
    block = d.groupBy(*keys, "_n", F.expr(f"_i div {BLOCK}").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("_i", *cols))).alias("_v"))
    block = block.select(*keys, "_n", "_k", *[F.col(f"_v.{c}").alias(c) for c in cols])
    order = [F.col("_n").desc(), *keys]
    tile = (d if many else units).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum(F.col("_n") * len(cols)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tile = tile.withColumns({"_g": F.row_number().over(Window.orderBy(*order)), "_tile": F.floor(before / TILE)})
    tile = tile.withColumn("_top", F.max("_n").over(Window.partitionBy("_tile"))).drop("_n")
    per = F.greatest(F.ceil(F.lit(HASHES) / F.col("_top")), F.lit(-(-draws // STRETCHES))).cast("int")
    shares = block.join(tile, keys).withColumn("_per", per).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.col("_per"))))
    types = {f.name: f.dataType for f in units.schema}
    fields = [T.StructField(k, types[k]) for k in keys] + [T.StructField("b", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in cols]
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields])
    return spread(shares, "_tile", "_b").groupBy("_tile", "_b").applyInArrow(_drawer(keys, cols, draws, seed, schema), T.StructType(fields))
