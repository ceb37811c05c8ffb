"""Spelling variants by dense prefix-suffix tiling.

Two words are near if one inserted, deleted or replaced code point turns one into the other, which is so exactly when common prefix and common
suffix together reach the longer length minus one. Words of lengths m and m - 1 meet in buckets of a window: they share the ``a`` code points before
and the ``c`` after it, and the edit lies in the ``m - a - c`` places between. The first two windows are the halves. A bucket
whose tiles would be too large is cut into the two halves of its window, and so on; a window of one place holds at most one word per letter,
so no bucket stays large, whatever many words have in common. Within a bucket blocks of padded code-point matrices are
compared in dense tiles. A pair counts in the one window that its common prefix ends in, so nothing is counted twice and tiles return
a count and the best partner of each word, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common
from gapweave.plans.storage import materialize

#: Cells (words x words x places) of a bucket before its window is cut, rows of a block, cells that are compared at once.
BUCKET_CELLS, BLOCK, TILE_CELLS = 1 << 22, 64, 1 << 22
_LETTERS, _UPPER, _LOWER = "a-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = 1) -> Column:
    """Maximal runs of at least ``least`` letters (A-Z in lower case, Latin-1 letters) of a text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"[{_LETTERS}]{{{least},}}"), F.lit(0))


def _windows(rows: DataFrame) -> DataFrame:
    """Both halves of every row's window: the edit lies in the first half, or the first half is shared."""
    half = F.expr("w div 2").cast("int")
    left = F.struct(F.col("a").alias("a"), (F.col("c") + F.col("w") - half).alias("c"), half.alias("w"))
    right = F.struct((F.col("a") + half).alias("a"), F.col("c").alias("c"), (F.col("w") - half).alias("w"))
    cut = rows.select("word", "n", "m", F.inline(F.array(left, right)))
    word, a, c = F.col("word"), F.col("a"), F.col("c")
    return cut.withColumn("key", F.xxhash64("m", "a", "c", F.left(word, a), F.right(word, c)))


def _dense(left: np.ndarray, right: np.ndarray, one: np.ndarray, two: np.ndarray, w: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of rows in tiles ``one[t]`` x ``two[t]`` (row numbers, -1 for none); ``left`` and ``right`` hold the windows' code points from either end."""
    prefix = np.logical_and.accumulate(left[one][:, :, None, :] == left[two][:, None, :, :], axis=3).sum(axis=3)
    suffix = np.logical_and.accumulate(right[one][:, :, None, :] == right[two][:, None, :, :], axis=3).sum(axis=3)
    i, j = np.broadcast_arrays(one[:, :, None], two[:, None, :])
    wide = w[one[:, :1]][:, :, None]
    ok = (i >= 0) & (j >= 0) & (i < j) & (long[i] | long[j]) & (prefix < wide) & (prefix + suffix >= wide - 1)
    return i[ok], j[ok]


def near_rows(word: list[str], m: np.ndarray, a: np.ndarray, c: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (row numbers) of whole buckets; rows of a bucket stand together."""
    w, length = m - a - c, np.fromiter(map(len, word), dtype=np.int64, count=len(word))
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, len(word)])
    side = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 2))).astype(int), BLOCK)
    wide = 1 << np.ceil(np.log2(np.maximum(w[first], 1))).astype(int)
    out_i, out_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for s, z in sorted(set(zip(side.tolist(), wide.tolist(), strict=True))):
        here = np.flatnonzero((side == s) & (wide == z))
        rows = np.concatenate([np.arange(f, f + k) for f, k in zip(first[here], size[here], strict=True)])
        place = np.full(len(word), -1)
        place[rows] = np.arange(len(rows))
        # the short word's window has one place less: its neighbour on the far side is compared instead, so that a common prefix is known up to the window's end
        ahead = [word[r][a[r] : m[r] - c[r]] for r in rows.tolist()]
        behind = [word[r][max(a[r] - (m[r] - length[r]), 0) : length[r] - c[r]][::-1] for r in rows.tolist()]
        left, right = (np.array(x, dtype=f"U{z}").view(np.uint32).reshape(len(rows), z) for x in (ahead, behind))
        tiles: list[tuple[np.ndarray, np.ndarray]] = []
        for f, k in zip(place[first[here]].tolist(), size[here].tolist(), strict=True):
            blocks = [np.r_[f + np.arange(b, min(b + s, k)), np.full(max(b + s - k, 0), -1)] for b in range(0, k, s)]
            tiles += [(blocks[p], blocks[q]) for p in range(len(blocks)) for q in range(p, len(blocks))]
        step = max(TILE_CELLS // (s * s * z), 1)
        for at in range(0, len(tiles), step):
            one, two = (np.stack(x) for x in zip(*tiles[at : at + step], strict=True))
            i, j = _dense(left, right, one, two, w[rows], length[rows] == m[rows])
            out_i.append(rows[i])
            out_j.append(rows[j])
    return np.concatenate(out_i), np.concatenate(out_j)


def _best(word: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray) -> list:
    """Of every row with near ones: its word, their number and of these the most frequent (ties: smallest)."""
    i, j = np.r_[i, j], np.r_[j, i]
    seen = np.unique(j)
    place = np.empty(len(seen), dtype=np.int64)
    place[sorted(range(len(seen)), key=lambda k: word[seen[k]])] = np.arange(len(seen))
    order = np.lexsort((place[np.searchsorted(seen, j)], -n[j], i))
    i, j = i[order], j[order]
    rows, first, count = np.unique(i, return_index=True, return_counts=True)
    return [[word[k] for k in rows.tolist()], count, n[j[first]], [word[k] for k in j[first].tolist()]]


def _tiled(rows: DataFrame) -> DataFrame:
    """Partial ``(word, near, best_n, best)`` of whole buckets, streamed bucket after bucket."""
    schema = T.StructType([T.StructField(c, t) for c, t in (("word", T.StringType()), ("near", T.LongType()), ("best_n", T.LongType()), ("best", T.StringType()))])
    names = schema.names

    def compare(held: pa.Table) -> pa.RecordBatch:
        word = held["word"].to_pylist()
        n, m, a, c, key = (held[x].to_numpy().astype(np.int64) for x in ("n", "m", "a", "c", "key"))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(_best(word, n, *near_rows(word, m, a, c, key)), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            key = b["key"].to_numpy()
            other = np.flatnonzero(key != key[-1])
            if other.size:  # all but the last bucket are whole
                cut = int(other[-1]) + 1
                yield compare(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
        if held:
            yield compare(pa.Table.from_batches(held))

    return rows.select("word", "n", "m", "a", "c", "key").repartition("key").sortWithinPartitions("m", "key").mapInArrow(run, schema)


def near_words(words: DataFrame, cells: int = BUCKET_CELLS) -> DataFrame:
    """Distinct ``words(word, n)`` with ``n_near`` (words one edit away) and of these the most frequent: ``best`` with ``best_n`` (ties: smallest by code points).

    NULL words are dropped, an empty word is near words of one letter. Words without near ones have 0 and NULLs.
    """
    words = words.where("word is not null").select("word", F.col("n").cast("long").alias("n"))
    size = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m")).where("m > 0")
    pending, parts = _windows(whole.select("*", F.lit(0).alias("a"), F.lit(0).alias("c"), F.col("m").alias("w"))), []
    while True:
        pending = materialize(pending.where("w > 0"), "spelling-windows")
        buckets = pending.groupBy("key", "m", "w").agg(F.count(F.lit(1)).alias("k"), F.max(F.char_length("word")).alias("longest"))
        buckets = materialize(buckets.where("k > 1 and longest = m").withColumn("big", (F.col("k") * F.col("k") * F.col("w") > cells) & (F.col("w") > 1)), "spelling-buckets")
        parts.append(_tiled(pending.join(buckets.where("not big").select("key", "m", "w"), ["key", "m", "w"], "left_semi")))
        if not buckets.where("big").head(1):
            break
        pending = _windows(pending.join(buckets.where("big").select("key", "m", "w"), ["key", "m", "w"], "left_semi"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    top = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("near").alias("n_near"), top.alias("top"))
    return words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("top.less")).alias("best_n"), F.col("top.word").alias("best"))


def variants(words: DataFrame, ratio: int = 10, cells: int = BUCKET_CELLS) -> DataFrame:
    """``words(word, n)`` with ``n_near``, ``form`` (the best near word, if it is ``ratio`` times as frequent), ``form_n`` and ``root`` (the last form).

    Each form is ``ratio`` times as frequent as its word, so chains are short and have no circles; every round doubles the steps taken.
    """
    near = near_words(words, cells)
    formed = F.col("best_n") >= ratio * F.col("n")
    near = near.select("word", "n", "n_near", F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    near = materialize(near, "spelling-forms")
    links = near.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if not links.where("moved").head(1):
            break
        links = links.select("word", "root")
    return near.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


MIN_CHARS, MIN_COUNT, RATIO, SLIP = 7, 2, 10, 31


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with slips by the contract's rule, and the forms they are variants of. A NULL doc_id or text makes no slip or no word."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("d"), F.explode(runs(F.col("text"), MIN_CHARS)).alias("run"))
    docs = docs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    slipped = F.concat(F.left("run", at), F.substring("run", at + 2, F.char_length("run")))
    words = docs.select(F.when(F.col("h") % SLIP == 0, slipped).otherwise(F.col("run")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = materialize(words.where((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_CHARS)), "spelling-words")
    return variants(words, RATIO).select("word", "form", "root", "n", "n_near", "form_n")


#: By deletion neighbourhoods: near words share a pattern with one place open, or one is the other with a place taken out.
OP13_SQL = f"""
WITH RECURSIVE {common.CRC_SQL},
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[{_LETTERS}]{{{MIN_CHARS},}}')) AS run FROM documents),
    g AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
    u AS (SELECT run, k, {common.crc32_sql("(doc_id::VARCHAR || ':' || run)")} AS h FROM g JOIN crc ON true),
    s AS (SELECT k, CASE WHEN h % {SLIP} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM u),
    w AS (SELECT word, sum(k)::BIGINT AS n FROM s WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(k) >= {MIN_COUNT}),
    o AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
    e AS (SELECT x.word, y.word AS other, y.n FROM o x JOIN o y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
        UNION SELECT x.word, y.word, y.n FROM o x JOIN w y ON x.less = y.word UNION SELECT y.word, x.word, x.n FROM o x JOIN w y ON x.less = y.word),
    b AS (SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, (-n, other)) AS best FROM e GROUP BY word),
    f AS (SELECT word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {RATIO} * w.n THEN best END AS form, CASE WHEN best_n >= {RATIO} * w.n THEN best_n END AS form_n FROM w LEFT JOIN b USING (word)),
    c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT c.word, c.root FROM c JOIN f ON c.root = f.word WHERE f.form IS NULL) USING (word)
"""
