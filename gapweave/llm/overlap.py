"""Near copies by the overlap of word shingles: MinHash bands gather candidates, exact overlaps decide.

Texts with equal sets of shingles are one item. Two items that agree in a band of MinHash values fall into one loose component; a pair at
similarity 0.8 agrees in none of the bands with probability (1 - 0.8^5)^32 = 3e-6. Only items of loose components are cut into shingles
again, each of them once; tiles of bounded size compare them exactly and return a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common, tiles
from gapweave.llm.components import connected
from gapweave.plans.storage import materialize

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 32, 5
#: Items of a chunk, on average; shingles that are compared at a time.
CHUNK, VOCABULARY = 512, 4096


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles in rising order; a shorter text is one shingle, one without words has none."""
    import xxhash

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    line, end = b" ".join(parts), np.cumsum(size) - 1
    n = max(len(parts) - words + 1, 1)
    first, last = (end - size + 1)[:n].tolist(), (end[words - 1 :] if len(parts) >= words else end[-1:]).tolist()
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=n).view(np.int64))


class MinHash:
    """Band keys of shingle sets: ``ROWS`` minima of multiply-shift hashes each."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.shape = (bands, rows)
        self.times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, found: np.ndarray) -> list[int]:
        x, low = found.view(np.uint64), np.full(len(self.times), 0xFFFFFFFF, np.uint64)
        x = x ^ (x >> np.uint64(32))
        for at in range(0, len(x), 512):
            low = np.minimum(low, ((x[at : at + 512, None] * self.times + self.plus) >> np.uint64(32)).min(axis=0))
        mixed = np.zeros(self.shape[0], np.uint64)
        for v in low.reshape(self.shape).T:
            mixed = (mixed ^ v) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return mixed.view(np.int64).tolist()


def similar_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, level: float = SIMILAR) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a of ``i``, b of ``j``) of the sets whose Jaccard similarity is ``level`` or more."""
    both = np.unique(np.concatenate([i, j]))
    size = np.array([len(s) for s in sets])
    values, code, count = np.unique(np.concatenate([sets[k] for k in both]), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1  # a shingle of one set overlaps nothing
    owner = np.repeat(both, size[both])
    keep = count[code] > 1
    owner, code = owner[keep], shared[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    at_i, at_j = np.full(len(sets), -1), np.full(len(sets), -1)
    at_i[i], at_j[j] = np.arange(len(i)), np.arange(len(j))
    common_n = np.zeros((len(i), len(j)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, VOCABULARY):
        s, e = np.searchsorted(code, (lo, lo + VOCABULARY))
        o, c = owner[s:e], code[s:e] - lo
        x, y = np.zeros((len(i), VOCABULARY), np.float32), np.zeros((len(j), VOCABULARY), np.float32)
        mi, mj = at_i[o] >= 0, at_j[o] >= 0
        x[at_i[o[mi]], c[mi]] = 1
        y[at_j[o[mj]], c[mj]] = 1
        common_n += x @ y.T
    whole = size[i][:, None] + size[j][None, :] - common_n
    a, b = np.nonzero(common_n >= level * whole - 1e-3)
    n, of = common_n[a, b].astype(np.int64), whole[a, b].astype(np.int64)
    ok = n * 1000 >= round(level * 1000) * of
    a, b = i[a[ok]], j[b[ok]]
    return a[a != b], b[a != b]


def _items(rows: DataFrame, row_id: str) -> DataFrame:
    """``rows(row_id, doc_id, text)`` to (row_id, doc_id, item, keys)."""
    src = rows.select(row_id, "doc_id", "text")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("item", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        minhash = MinHash()
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(2)]
            item = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in found], np.uint64).view(np.int64)
            keys = [minhash.keys(s) if len(s) else [] for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(item), pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def _sets(rows: DataFrame) -> DataFrame:
    """``rows(item, loose, n, text)`` to (item, loose, n, set)."""
    src = rows.select("item", "loose", "n", "text")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t.as_py()) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return src.mapInArrow(run, schema)


def links(sets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``sets(item, loose, n, set)`` of distinct items to links ``(u, v)`` that span all similar pairs of each loose component of ``n`` items."""
    dealt = tiles.deal(sets, "n", ["item"], chunk).select("loose", "_a", "_b", "_own", "item", "set")

    def tile(g: dict) -> Iterator[list]:
        item, own = g["item"], g["_own"]
        i, j = np.flatnonzero(own == g["_a"][0]), np.flatnonzero(own == g["_b"][0])
        if not len(i) or not len(j):
            return
        held = list(g["set"]) if isinstance(g["set"], np.ndarray) else common.list_views(pa.chunked_array([g["set"]]))
        a, b = similar_pairs(held, i, j)
        root = tiles.roots(len(item), a, b)
        if (moved := np.flatnonzero(root != np.arange(len(item)))).size:
            yield [item[moved], item[root[moved]]]

    return tiles.scan(dealt, ["loose", "_a", "_b"], tile, T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())]))


def _joined(named: DataFrame, groups: DataFrame) -> DataFrame:
    """Roots of ``named(row, item, root)`` after every group of ``groups(row, group)`` has made one component of the components it meets: (root, joined) of those that change."""
    met = materialize(named.join(groups, "row").select("group", "root").distinct(), "overlap-met")
    low = met.groupBy("group").agg(F.min("root").alias("v"), F.max("root").alias("_most")).where("v <> _most").drop("_most")
    links = met.join(materialize(low, "overlap-met-low"), "group").select(F.col("root").alias("u"), "v")
    return connected(links).withColumnsRenamed({"node": "root", "component": "joined"})


def one_of_each(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each component of near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id; among rows of that id the smallest digest of the row, once.

    ``groups`` maps ``(row, doc_id, text)`` to ``(row, group)``; rows of a group are near copies too. Texts without words are copies of each
    other. A component whose ids are all NULL keeps one row too. Columns stay as they are; an empty table gives an empty result.
    """
    same = common.unique_name(docs, "_digest")
    whole = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = docs.withColumn(same, F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b")))
    cut = materialize(_items(rows, same), "overlap-items")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(same).alias("digest"))).alias("first")
    items = materialize(cut.groupBy("item").agg(first), "overlap-distinct")
    keyed = cut.select("item", F.posexplode("keys").alias("t", "key"))
    low = materialize(keyed.groupBy("t", "key").agg(F.min("item").alias("v"), F.max("item").alias("_most")).where("v <> _most").drop("_most"), "overlap-bands")
    loose = connected(keyed.join(low, ["t", "key"]).select(F.col("item").alias("u"), "v"))
    loose = materialize(loose.select(F.col("node").alias("item"), F.col("component").alias("loose")), "overlap-loose")
    sizes = materialize(loose.groupBy("loose").agg(F.count(F.lit(1)).alias("n")), "overlap-sizes")
    wanted = loose.join(sizes, "loose").join(items, "item").select("item", "loose", "n", F.col("first.digest").alias(same))
    found = rows.select(same, "text").join(materialize(wanted, "overlap-wanted"), same)
    comps = connected(links(materialize(_sets(found).dropDuplicates(["item"]), "overlap-sets")))
    named = items.join(comps.withColumnsRenamed({"node": "item", "component": "root"}), "item", "left").withColumn("root", F.coalesce("root", "item"))
    if groups is not None:
        named = materialize(named.select("item", "first", "root"), "overlap-named")
        of_row = cut.select(F.col(same).alias("row"), "item").distinct().join(named.select("item", "root"), "item")
        more = _joined(of_row, groups(rows.select(F.col(same).alias("row"), "doc_id", "text")).distinct())
        named = named.join(more, "root", "left").withColumn("root", F.coalesce("joined", "root"))
    chosen = materialize(named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.digest").alias(same)), "overlap-kept")
    return rows.join(chosen, same, "left_semi").dropDuplicates([same]).drop(same)
