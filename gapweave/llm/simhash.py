"""SimHash near-duplicates, pairs discarded by a table of distances to reference fingerprints.

Each text has a 64-bit fingerprint: the majority of every bit over the XXH64 hashes of its word shingles. A table holds the
Hamming distance of every fingerprint to many fixed reference fingerprints. By the triangle inequality two fingerprints
within k bits differ by at most k in every coordinate, so a pair with a larger difference is discarded without being compared;
survivors are verified. Distances to references alone cannot deal pairs out to a cluster (a random pair passes one of them
with probability 0.46), so pairs meet in buckets: of six blocks of bits at least three agree when at most three bits
differ, hence one of twenty tables keyed by three blocks holds both. Equal fingerprints are one item, buckets of two are settled
in columns, larger ones in tiles of bounded size that return a spanning forest and never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common, tiles
from gapweave.llm.components import connected
from gapweave.plans.storage import materialize

HASH_SEED, REFERENCES, BITS = 42, 16, 3


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(bits: int) -> list[int]:
    """Masks of all choices of ``bits`` blocks among 2 x ``bits``: two fingerprints that differ in up to ``bits`` bits agree under one of them."""
    n = max(2 * bits, 1)
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return [_signed(sum(c)) for c in combinations(blocks, n - bits)]


def references(n: int = REFERENCES, seed: int = 7) -> list[int]:
    return [int(x) for x in np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n, dtype=np.int64)]


def fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit fingerprint of a text; zero without words."""
    import xxhash

    parts = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space cuts
    if not parts:
        return 0
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    line, end = b" ".join(parts), np.cumsum(size) - 1
    n = max(len(parts) - words + 1, 1)
    last = end[words - 1 :] if len(parts) >= words else end[-1:]
    first = (end - size + 1)[:n]
    ones, h = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):
        hashes = np.fromiter((h(line[a:b], HASH_SEED) for a, b in zip(first[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)].tolist(), strict=True)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` without its text and with ``fp``; a NULL text has no words and fingerprint zero."""
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", "fp")], "text")
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), words) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)


def _near(a: Column, b: Column, refs: list[int], bits: int) -> Column:
    """The reference test, then the exact one."""
    ok = F.lit(True)
    for r in refs:
        ok &= F.abs(F.bit_count(a.bitwiseXOR(F.lit(r))) - F.bit_count(b.bitwiseXOR(F.lit(r)))) <= bits
    return ok & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def links(fps: DataFrame, bits: int = BITS, refs: list[int] | None = None, chunk: int = tiles.CHUNK) -> DataFrame:
    """Distinct ``fps(fp)`` to links ``(u, v)`` that span all pairs within ``bits`` bits (same components, not all pairs)."""
    refs = references() if refs is None else refs
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in block_masks(bits)])).alias("t", "key"))
    buckets = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    buckets = materialize(buckets, "simhash-buckets")
    two = buckets.where((F.col("n") == 2) & _near(F.col("u"), F.col("v"), refs, bits)).select("u", "v")
    many = keyed.join(buckets.where("n > 2").select("t", "key", "n"), ["t", "key"])
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("short") for r in refs])
    dealt = tiles.deal(many, "n", ["fp"], chunk).select("t", "key", "_a", "_b", "_own", "fp", table.alias("far"))

    def tile(g: dict) -> Iterator[list]:
        fp, far, own = g["fp"], g["far"], g["_own"]
        i, j = (np.flatnonzero(own == g["_a"][0]), np.flatnonzero(own == g["_b"][0]))
        if not len(i) or not len(j):
            return
        gap = np.abs(far[i, 0][:, None] - far[j, 0][None, :]) <= bits
        for k in range(1, min(4, far.shape[1])):
            gap &= np.abs(far[i, k][:, None] - far[j, k][None, :]) <= bits
        a, b = np.nonzero(gap)
        a, b = i[a], j[b]
        a, b = a[keep := a != b], b[keep]
        for k in range(4, far.shape[1]):
            ok = np.abs(far[a, k] - far[b, k]) <= bits
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        root = tiles.roots(len(fp), a[ok], b[ok])
        if (moved := np.flatnonzero(root != np.arange(len(fp)))).size:
            yield [fp[moved], fp[root[moved]]]

    schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
    return two.unionByName(tiles.scan(dealt, ["t", "key", "_a", "_b"], tile, schema))


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """Rows of ``docs`` without their text, with ``fp``, ``component_id`` and ``root``: components of fingerprints within ``bits`` bits.

    A component is named by its smallest doc_id (``root``, one of its fingerprints, tells components apart where ids are missing). A
    NULL or blank text has fingerprint zero and is linked like any other. Rows of equal id stay rows. A NULL doc_id never names a component
    unless all ids in it are NULL, then component_id is NULL. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("component_id", "root")]), words), "simhash-fp")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    comps = connected(links(fps, bits)).withColumnsRenamed({"node": "fp", "component": "root"})
    named = fps.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.join(materialize(named.join(lowest, "root").select("fp", "root", "component_id"), "simhash-components"), "fp")


def one_of_each(docs: DataFrame, words: int = 3, bits: int = BITS) -> DataFrame:
    """One row of each near-duplicate component: the smallest doc_id; among rows of that id the smallest digest of the row, once.

    A component whose ids are all NULL keeps one row too. Columns stay as they are.
    """
    same = common.unique_name(docs, "_digest")
    whole = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    rows = docs.withColumn(same, F.struct(F.xxhash64(*whole).alias("a"), F.xxhash64(F.lit(1), *whole).alias("b")))
    found = near_duplicates(rows.select("doc_id", "text", same), words, bits)
    # ids and digests only; a component is reduced before the shuffle however many rows it has
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col(same)))
    chosen = materialize(found.groupBy("root").agg(first.alias("first")).select(F.col(f"first.{same}").alias(same)), "simhash-kept")
    return rows.join(chosen, same, "left_semi").dropDuplicates([same]).drop(same)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
