"""Buckets compared in bounded tiles: a large bucket is salted into chunks and every pair of chunks is one tile."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a chunk, on average; a tile holds two chunks.
CHUNK = 1024


def deal(rows: DataFrame, size: str, item: Sequence[str], chunk: int = CHUNK) -> DataFrame:
    """Adds ``_own`` (the row's chunk of its bucket of ``size`` rows), ``_a`` and ``_b`` (the tile, a <= b): one row per tile it takes part in."""
    df = rows.withColumn("_n", F.ceil(F.col(size) / chunk).cast("int")).withColumn("_own", F.pmod(F.xxhash64(*item), F.col("_n")).cast("int"))
    df = df.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return df.withColumns({"_a": F.least("_own", "_j"), "_b": F.greatest("_own", "_j")}).drop("_n", "_j")


def scan(rows: DataFrame, keys: Sequence[str], fn: Callable[[dict], Iterator[list]], schema: T.StructType) -> DataFrame:
    """``fn`` over every group of ``keys``: rows are dealt by key, sorted, and streamed, so a task holds one group (a dict of numpy columns; lists of one length are matrices, others stay Arrow) at a time."""
    names = rows.columns
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys)
    out_names, out_types = schema.names, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def column(c: pa.Array) -> np.ndarray:
            if pa.types.is_list(c.type) and (c.value_lengths().to_numpy() != len(c[0])).any():
                return c
            if pa.types.is_list(c.type):
                return np.asarray(c.flatten().to_numpy(zero_copy_only=False)).reshape(len(c), -1) if len(c) else np.zeros((0, 0))
            return c.to_numpy(zero_copy_only=False)

        def emit(found: list[list]) -> pa.RecordBatch:
            cols = [np.concatenate(x) if isinstance(x[0], np.ndarray) else [z for y in x for z in y] for x in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=out_names)

        held: list[pa.RecordBatch] = []
        last, found, n = None, [], 0
        for b in batches:
            if not b.num_rows:
                continue
            k = [b.column(names.index(c)).to_numpy(zero_copy_only=False) for c in keys]
            cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in k], axis=0)) + 1
            edges = [0, *cut.tolist(), b.num_rows]
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(x[at] for x in k)
                if held and key != last:
                    t = pa.Table.from_batches(held).combine_chunks()
                    for out in fn({c: column(t.column(c).combine_chunks()) for c in names}):
                        found.append(out)
                        n += len(out[0])
                    held = []
                    if n >= 20_000:
                        yield emit(found)
                        found, n = [], 0
                held.append(b.slice(at, to - at))
                last = key
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            found += list(fn({c: column(t.column(c).combine_chunks()) for c in names}))
        if found:
            yield emit(found)

    return ordered.mapInArrow(run, schema)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` indexes over the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
