"""Incremental, reversible line dedup: sharded cuckoo filters over exact reference counts.

The exact table counts, for the 128-bit hash of every line key, the documents that hold it. Keys held by ``min_docs`` documents or more
are blocked. Blocked keys also lie in cuckoo filters, one per shard of the key hash: 4-slot buckets of 32-bit fingerprints, so that a key
can be taken out again, which a Bloom filter cannot do. Inserting or deleting documents adds signed counts to the exact table; only keys that
cross the threshold touch the filters, shard by shard. A filter that overflows, or too many keys a shard, makes all filters anew from
the exact table with more shards.

Documents are cleaned in one scan without a shuffle while the filters fit a checked size: a line goes if its filter has it and the exact table does not
name it as one of the filter's false alarms (about 2e-9 of the keys). Beyond that size, and for documents that are
not in the index, lines meet the exact table by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import common
from gapweave.plans.storage import materialize

BUCKETS, SLOTS, SHARD_KEYS = 1 << 14, 4, 45_000
#: Filters and false alarms are sent to the executors up to this size in bytes.
MOST_BYTES = 64 << 20
_SPACE, _UPPER, _LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineIndex:
    """``refs(h1, h2, n)``: documents that hold a key. ``filters(shard, slots)``: bytes of one filter each."""

    refs: DataFrame
    filters: DataFrame
    shards: int = 1
    min_docs: int = 10
    min_chars: int = 1

    def blocked(self) -> DataFrame:
        return self.refs.where(F.col("n") >= self.min_docs).select("h1", "h2")


def split_lines(text: Column) -> Column:
    r"""Lines of a text, cut at \n; a NULL or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column) -> Column:
    """Keys of the lines of a text in order: white space stripped at both ends, A-Z in lower case."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.split(low, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)))


def _hash(key: Column, which: int) -> Column:
    return F.xxhash64(key) if which == 1 else F.xxhash64(F.lit(1), key)


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint and the two buckets of every key; either bucket leads to the other with the fingerprint alone."""
    h = h.view(np.uint64)
    fp = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))
    at = (h & np.uint64(BUCKETS - 1)).astype(np.int64)
    return fp, at, _other(fp, at)


def _other(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
    return at ^ ((fp * np.uint32(0x5BD1E995)) >> np.uint32(18)).astype(np.int64)


def add_keys(slots: np.ndarray, h: np.ndarray, rounds: int = 400) -> bool:
    """Put keys into a filter (``BUCKETS`` x ``SLOTS`` fingerprints, 0 free), evicting where both buckets are full; False if it overflows.

    All pending keys move at once: each takes a free slot of its bucket, the rest try the other one, then one key of
    every bucket that is still full takes the place of a resident, which becomes pending.
    """
    fp, at, _ = _places(h)
    for turn in range(rounds):
        if not fp.size:
            return True
        order = np.argsort(at, kind="stable")
        fp, at = fp[order], at[order]
        rank = np.arange(fp.size) - np.searchsorted(at, at)
        taken = slots[at] != 0
        here = rank < SLOTS - taken.sum(axis=1)
        free = np.argsort(taken[here], axis=1, kind="stable")
        slots[at[here], free[np.arange(len(free)), rank[here]]] = fp[here]
        fp, at = fp[~here], at[~here]
        if turn and fp.size:
            _, first = np.unique(at, return_index=True)
            seat = (fp[first].astype(np.int64) + turn) % SLOTS
            out = slots[at[first], seat]
            slots[at[first], seat], fp[first] = fp[first], out
        at = _other(fp, at)
    return not fp.size


def remove_keys(slots: np.ndarray, h: np.ndarray) -> None:
    """Take one copy of every key's fingerprint out; a key that is not there is an error."""
    fp, one, two = _places(h)
    while fp.size:
        found = np.stack([slots[one] == fp[:, None], slots[two] == fp[:, None]], axis=1).reshape(len(fp), -1)
        if not found.any(axis=1).all():
            raise ValueError("a key to be taken out is not in its filter")
        k = found.argmax(axis=1)
        flat = np.where(k < SLOTS, one, two) * SLOTS + k % SLOTS
        _, first = np.unique(flat, return_index=True)  # keys of one fingerprint take one slot a round
        slots.reshape(-1)[flat[first]] = 0
        rest = np.ones(len(fp), dtype=bool)
        rest[first] = False
        fp, one, two = fp[rest], one[rest], two[rest]


def has_keys(slots: np.ndarray, shard: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which keys their filters may hold; ``slots`` is shards x buckets x slots."""
    fp, one, two = _places(h)
    return ((slots[shard, one] == fp[:, None]) | (slots[shard, two] == fp[:, None])).any(axis=1)


def _list(x: pa.ListScalar) -> np.ndarray:
    return np.array(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], dtype=np.int64)


def _updated(slots: pa.Array, up: pa.Array, down: pa.Array) -> pa.Array:
    """Filters (NULL: an empty one) with keys taken out and put in, and whether they overflowed."""
    out, full = [], []
    for old, add, drop in zip(slots, up, down, strict=True):
        table = np.frombuffer(old.as_py() or bytes(4 * BUCKETS * SLOTS), dtype=np.uint32).reshape(BUCKETS, SLOTS).copy()
        remove_keys(table, _list(drop))
        full.append(not add_keys(table, _list(add)))
        out.append(table.tobytes())
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()), pa.array(full, pa.bool_())], ["slots", "full"])


def empty(spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
    return LineIndex(spark.createDataFrame([], "h1 long, h2 long, n long"), spark.createDataFrame([], "shard int, slots binary"), 1, min_docs, min_chars)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with the rows of ``docs`` added; every row is a document of its own, whatever its doc_id."""
    return _change(index, docs, 1)


def delete(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index as if ``docs`` had never been inserted. Deleting a line more often than it was inserted raises ValueError."""
    return _change(index, docs, -1)


def _change(index: LineIndex, docs: DataFrame, sign: int) -> LineIndex:
    """Signed counts of the keys that documents hold (each once a document, combined before the shuffle) added to the exact table."""
    key = F.explode(F.filter(F.array_distinct(line_keys(F.col("text"))), lambda k: F.char_length(k) >= index.min_chars)).alias("key")
    held = docs.select(key).select(_hash(F.col("key"), 1).alias("h1"), _hash(F.col("key"), 2).alias("h2"), F.lit(0).cast("long").alias("old"), F.lit(sign).cast("long").alias("d"))
    before = index.refs.select("h1", "h2", F.col("n").alias("old"), F.lit(0).cast("long").alias("d"))
    counted = before.unionByName(held).groupBy("h1", "h2").agg(F.sum("old").alias("old"), F.sum(F.col("old") + F.col("d")).alias("n"))
    counted = materialize(counted.where("old > 0 or n <> 0"), "line-counts")
    wrong, keys = counted.agg(F.count_if(F.col("n") < 0), F.count_if(F.col("n") >= index.min_docs)).first()
    if wrong:
        raise ValueError(f"{wrong} line keys would be held by fewer than 0 documents")
    after = replace(index, refs=counted.where("n > 0").select("h1", "h2", "n"))
    if keys > index.shards * SHARD_KEYS:
        return _rebuilt(after, -(-keys * 3 // (2 * SHARD_KEYS)))
    was, is_ = F.col("old") >= index.min_docs, F.col("n") >= index.min_docs
    return _with_filters(after, index.filters, counted.where(was != is_).select("h1", "h2", is_.alias("up")), index.shards)


def _rebuilt(index: LineIndex, shards: int) -> LineIndex:
    return _with_filters(index, index.filters.where("false"), index.blocked().withColumn("up", F.lit(True)), shards)


def _with_filters(index: LineIndex, filters: DataFrame, crossing: DataFrame, shards: int) -> LineIndex:
    """Filters after the keys that cross the threshold; a shard has some ``SHARD_KEYS`` keys, so its lists are bounded."""
    moves = crossing.groupBy(F.pmod("h2", F.lit(shards)).cast("int").alias("shard")).agg(
        F.collect_list(F.when(F.col("up"), F.col("h1"))).alias("up"), F.collect_list(F.when(~F.col("up"), F.col("h1"))).alias("down")
    )
    update = F.arrow_udf(_updated, "slots binary, full boolean")
    done = filters.join(moves, "shard", "full").select("shard", update("slots", "up", "down").alias("f"))
    done = materialize(done.select("shard", "f.slots", "f.full"), "line-filters")
    if done.where("full").head(1):
        return _rebuilt(index, 2 * shards)
    return replace(index, filters=done.select("shard", "slots"), shards=shards)


def _with_hashes(docs: DataFrame, index: LineIndex, h1: str, h2: str) -> DataFrame:
    """Both hashes of every line; NULL where a key is too short to be counted."""
    counted = lambda k, which: F.when(F.char_length(k) >= index.min_chars, _hash(k, which))
    keys = line_keys(F.col("text"))
    return docs.withColumns({h1: F.transform(keys, lambda k: counted(k, 1)), h2: F.transform(keys, lambda k: counted(k, 2))})


def _false_alarms(index: LineIndex, test) -> DataFrame:
    """Keys of the exact table that a filter holds although they are not blocked."""
    free = index.refs.where(F.col("n") < index.min_docs).select("h1", "h2")
    return free.where(F.get(test(F.array("h1"), F.array("h2")), F.lit(0)))


def _in_scan(index: LineIndex, docs: DataFrame, h1: str, h2: str, gone: str, most: int) -> DataFrame | None:
    """``docs`` with the flags of dropped lines from filters held by every task; None if filters and false alarms exceed ``most`` bytes."""
    spark = docs.sparkSession
    if index.shards * BUCKETS * SLOTS * 4 > most:
        return None
    slots = np.zeros((index.shards, BUCKETS, SLOTS), dtype=np.uint32)
    for r in index.filters.collect():
        slots[r.shard] = np.frombuffer(r.slots, dtype=np.uint32).reshape(BUCKETS, SLOTS)
    sent = spark.sparkContext.broadcast((slots, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)))

    def tester(sent):
        @F.arrow_udf("array<boolean>")
        def test(a: pa.Array, b: pa.Array) -> pa.Array:
            slots, no1, no2 = sent.value
            flat1, flat2 = a.flatten(), b.flatten()
            known = flat1.is_valid().to_numpy(zero_copy_only=False)
            x, y = (np.ascontiguousarray(f.fill_null(0).to_numpy(zero_copy_only=False)) for f in (flat1, flat2))
            hit = np.zeros(len(x), dtype=bool)
            for at in range(0, len(x), 1 << 16):
                s = slice(at, at + (1 << 16))
                hit[s] = known[s] & has_keys(slots, y[s] % len(slots), x[s])
            for i in np.flatnonzero(hit & np.isin(x, no1)) if len(no1) else ():
                hit[i] = not ((no1 == x[i]) & (no2 == y[i])).any()
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(a.value_lengths().to_numpy())]), pa.int32()), pa.array(hit))

        return test

    wrong = materialize(_false_alarms(index, tester(sent)), "line-false-alarms")
    if 16 * wrong.count() > most:
        return None
    rows = wrong.collect()
    sent = spark.sparkContext.broadcast((slots, np.array([r.h1 for r in rows], dtype=np.int64), np.array([r.h2 for r in rows], dtype=np.int64)))
    return docs.withColumn(gone, tester(sent)(h1, h2))


def _by_join(index: LineIndex, docs: DataFrame, h1: str, h2: str, gone: str) -> DataFrame:
    """``docs`` with the flags of dropped lines from the exact table; texts are told apart by 128 bits, so copies are looked up once."""
    t1, t2 = common.unique_name(docs, "_t1"), common.unique_name(docs, "_t2")
    docs = docs.withColumns({t1: F.xxhash64(F.coalesce("text", F.lit(""))), t2: F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    once = docs.select(F.col(t1).alias("t1"), F.col(t2).alias("t2"), F.col(h1).alias("a"), F.col(h2).alias("b")).dropDuplicates(["t1", "t2"])
    lines = once.select("t1", "t2", F.posexplode(F.arrays_zip("a", "b"))).select("t1", "t2", "pos", F.col("col.a").alias("h1"), F.col("col.b").alias("h2"))
    flags = lines.join(index.blocked().withColumn("gone", F.lit(True)), ["h1", "h2"], "left")
    per = flags.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("gone").isNotNull().alias("gone")))).alias("flags"))
    per = per.select(F.col("t1").alias(t1), F.col("t2").alias(t2), F.col("flags.gone").alias(gone))
    return docs.join(materialize(per, "line-flags"), [t1, t2]).drop(t1, t2)


def drop_lines(index: LineIndex, docs: DataFrame, indexed: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``docs`` with ``kept`` (the text without blocked lines), ``n_lines`` and ``n_dropped``; columns of these names are replaced.

    ``indexed`` says that every row of ``docs`` was inserted; others are compared with the exact table. A NULL text is an empty line and stays so.
    Lines shorter than ``min_chars`` once stripped stay. All other columns, NULLs in them and repeated rows pass through; an empty table gives an empty result.
    """
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")])
    h1, h2, gone = (common.unique_name(src, c) for c in ("_h1", "_h2", "_gone"))
    hashed = _with_hashes(src, index, h1, h2)
    flagged = _in_scan(index, hashed, h1, h2, gone, most_bytes) if indexed else None
    if flagged is None:
        flagged = _by_join(index, hashed, h1, h2, gone)
    n_gone = F.size(F.filter(gone, lambda g: g)).cast("long")
    kept = F.array_join(F.filter(split_lines(F.col("text")), lambda _, i: ~F.get(gone, i)), "\n")
    return flagged.select(*[F.col(f"`{c}`") for c in src.columns], kept.alias("kept"), F.size(gone).cast("long").alias("n_lines"), n_gone.alias("n_dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that ten or more documents hold, dropped everywhere."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = drop_lines(insert(empty(spark), docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT n, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d),
    k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
    c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT n) >= 10),
    g AS (SELECT n, count(*) AS n_lines, count(c.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '') AS kept
        FROM k LEFT JOIN c USING (key) GROUP BY n)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (n)
"""
