"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The words of a source form a line of blocks of ``block_tokens`` words. All blocks of the mix are handed to sources
by highest quotients target / (2s + 1), a source's blocks to its shards the same way by shard size, and a
shard's quota is filled by whole rounds over its line plus one run of blocks from a seeded start, cyclic;
documents lie on the line in seeded hash order. With the default block of one word every source is
within a word of its target. Only counts per source and hash bucket are aggregated before the documents are
placed, and the quotients enumerated are at most two and a bit per party, however many blocks there are.
DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gapweave.llm import common
from gapweave.plans.storage import materialize

BUCKETS, SHARD_DOCS, SEED, MOST = 4096, 1024, "mix", 3


def _level(amount: Column, group: Sequence[str], party: Sequence[str], weight: str, cap: str) -> Column:
    """Level at which the sum of least(cap, level x weight) over a group is ``amount``; NULL if the caps do not hold so much.

    Parties fill in order of cap / weight; the first whose share of what is left fits below its cap sets the level.
    """
    ratio = F.col(cap) / F.col(weight)
    order = Window.partitionBy(*group).orderBy(ratio, *party)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = (amount - before) / F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.when(ratio >= own, F.struct(F.row_number().over(order).alias("at"), own.alias("level")))


def _with_level(df: DataFrame, name: str, amount: Column, group: Sequence[str], party: Sequence[str], weight: str, cap: str) -> DataFrame:
    df = df.withColumn(name, _level(amount, group, party, weight, cap))
    return df.withColumn(name, F.min(name).over(Window.partitionBy(*group))["level"])


def highest_quotients(parties: DataFrame, group: Sequence[str], party: Sequence[str], weight: str, cap: str, seats: str) -> DataFrame:
    """Sainte-Laguë seats of each party: the ``seats`` of its group go to the highest weight / (2s + 1), s < cap; ties to the first party.

    The levels at which n/2 + 1 seats fewer and as many more would be shared out exactly bound every party's seats from both sides;
    only the quotients between them are ranked. Adds ``won``. Parties without weight or cap win nothing.
    """
    w = Window.partitionBy(*group)
    live = parties.where((F.col(weight) > 0) & (F.col(cap) > 0)).withColumn("_n", F.count(F.lit(1)).over(w) / 2 + 1)
    live = _with_level(live, "_few", F.col(seats) - F.col("_n"), group, party, weight, cap)
    live = _with_level(live, "_many", F.col(seats) + F.col("_n"), group, party, weight, cap)
    rounded = lambda level: F.greatest(F.least(F.col(cap), F.floor(F.col(level) * F.col(weight) + 0.5)), F.lit(0))
    at = lambda level: F.when(F.col(level).isNull(), F.col(cap)).otherwise(rounded(level)).cast("long")
    live = live.withColumns({"_lo": at("_few"), "_hi": at("_many")}).withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    band = live.where("_hi > _lo").withColumn("_s", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    order = Window.partitionBy(*group).orderBy(F.desc(F.col(weight) / (2 * F.col("_s") + 1)), *party, "_s")
    keys = [*group, *party]
    more = band.withColumn("_r", F.row_number().over(order)).where("_r <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_more"))
    won = live.select(*keys, "_lo").join(more, keys, "left").select(*keys, (F.col("_lo") + F.coalesce("_more", F.lit(0))).cast("long").alias("won"))
    return parties.join(won, keys, "left").withColumn("won", F.coalesce("won", F.lit(0).cast("long")))


def source_targets(sources: DataFrame, weights: Sequence[int], most: int = MOST) -> DataFrame:
    """Adds ``target``: weights repeat over sources by code point (NULL last) and share all words; none passes ``most`` x its size.

    One row per source, so the windows here run over sources, never over documents.
    """
    pos = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    df = sources.withColumn("_pos", pos).withColumn("_all", F.lit(0)).withColumn("_cap", most * F.col("source_size"))
    df = df.withColumn("_weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod("_pos", F.lit(len(weights))) + 1))
    df = df.withColumn("_sum", F.sum("source_size").over(Window.partitionBy("_all")))
    df = _with_level(df, "_level", F.col("_sum"), ["_all"], ["_pos"], "_weight", "_cap")
    return df.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight"))).drop("_level", "_sum", "_all")


def _hash_order(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), block_tokens: int = 1, seed: str = SEED, most: int = MOST) -> DataFrame:
    """All rows and columns of ``docs`` (with text, source, doc_id) plus size, source_size, target, taken, copies.

    ``taken`` counts the words that the mix takes from the row, repeats included; ``copies`` how often the mix takes its
    middle word, that is how often a mix of whole documents holds it. A NULL text has size 0 and takes nothing; a NULL source
    is a source, the last one; rows of equal id are placed by size, equal rows are interchangeable; an empty table gives an
    empty result. Columns that are named like a new one are replaced.
    """
    made = {"size", "source_size", "target", "taken", "copies"}
    rest = [c for c in docs.columns if c.lower() not in made]
    key = {"_key": F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null")), "_hash": _hash_order(F.col("doc_id"), seed)}
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], common.n_words(F.col("text")).alias("size")).withColumns(key)
    rows = rows.withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))

    counts = rows.groupBy("_key", F.col("source"), "_bucket").agg(F.count(F.lit(1)).alias("_docs"), F.sum("size").alias("_words"))
    counts = materialize(counts, "mix-counts")
    sources = counts.groupBy("_key", "source").agg(F.sum("_docs").alias("_docs"), F.sum("_words").alias("source_size"))
    sources = source_targets(sources, weights, most)
    shards = F.least(F.greatest(F.ceil(F.col("_docs") / SHARD_DOCS), F.lit(1)), F.lit(BUCKETS))
    sources = sources.withColumn("_shards", shards.cast("int"))
    per_shard = counts.join(sources.select("_key", "_shards"), "_key").withColumn("_shard", F.pmod("_bucket", F.col("_shards")))
    per_shard = per_shard.groupBy("_key", "_shard").agg(F.sum("_words").alias("_words")).withColumn("_blocks", F.ceil(F.col("_words") / block_tokens))
    per_shard = per_shard.withColumn("_most", most * F.col("_blocks"))

    # sources at their limit take exactly that; the rest of the blocks are apportioned among the others
    blocks = per_shard.groupBy("_key").agg(F.sum("_blocks").alias("_blocks"))
    sources = sources.join(blocks, "_key").withColumn("_full", F.col("target") >= F.col("_cap"))
    one = Window.partitionBy("_all")
    sources = sources.withColumn("_all", F.lit(0)).withColumn("_limit", most * F.col("_blocks"))
    all_blocks = F.floor(F.sum("source_size").over(one) / block_tokens + 0.5) - F.sum(F.when(F.col("_full"), F.col("_limit")).otherwise(0)).over(one)
    sources = sources.withColumn("_seats", F.greatest(all_blocks, F.lit(0)))
    sources = sources.withColumns({"_w": F.when(F.col("_full"), F.lit(0.0)).otherwise(F.col("target"))})
    sources = highest_quotients(sources.withColumnRenamed("_w", "_share"), ["_all"], ["_pos"], "_share", "_limit", "_seats")
    sources = sources.withColumn("_quota", F.when(F.col("_full"), F.col("_limit")).otherwise(F.col("won")).cast("long")).select("_key", "_shards", "source_size", "target", "_quota")
    sources = materialize(sources, "mix-sources")
    per_shard = highest_quotients(per_shard.join(sources.select("_key", "_quota"), "_key"), ["_key"], ["_shard"], "_blocks", "_most", "_quota")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("_key"), F.col("_shard").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    line = materialize(per_shard.where("_blocks > 0").select(
        "_key", "_shard", "_words", F.col("won").alias("_won"), F.floor(F.col("won") / F.col("_blocks")).alias("_rounds"), F.pmod("won", "_blocks").alias("_extra"), F.pmod(start, F.col("_blocks")).alias("_start"), "_blocks"), "mix-shards")

    placed = rows.join(sources.drop("_quota"), "_key").withColumn("_shard", F.pmod("_bucket", F.col("_shards")))
    order = Window.partitionBy("_key", "_shard").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_off", F.coalesce(F.sum("size").over(order), F.lit(0))).join(line, ["_key", "_shard"], "left")
    b, end = F.lit(block_tokens), F.col("_off") + F.col("size")
    first = F.least((F.col("_start") + F.col("_extra")) * b, F.col("_words"))
    again = F.greatest(F.col("_start") + F.col("_extra") - F.col("_blocks"), F.lit(0)) * b
    shared = lambda lo, hi: F.greatest(F.least(end, hi) - F.greatest(F.col("_off"), lo), F.lit(0))
    middle = F.col("_off") + F.floor(F.col("size") / 2)
    inside = ((middle >= F.col("_start") * b) & (middle < first)) | (middle < again)
    taken = F.col("_rounds") * F.col("size") + shared(F.col("_start") * b, first) + shared(F.lit(0), again)
    return placed.select(
        *[F.col(f"`{c}`") for c in rest], "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target",
        F.coalesce(taken, F.lit(0)).cast("long").alias("taken"), F.coalesce(F.col("_rounds") + inside.cast("int"), F.lit(0)).cast("int").alias("copies"))


def whole_documents(mixed: DataFrame) -> DataFrame:
    """Rows of ``mix`` repeated ``copies`` times: the mix as whole documents."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_copy")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all documents takes from each, sources weighing 5, 2, 1 in turn."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same by enumerating every quotient and every word position.
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce('s' || source, 'null') AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
    src AS (SELECT k, any_value(source) AS source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
    w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
        row_number() OVER (ORDER BY source NULLS LAST) AS pos, least(greatest(ceil(docs / {SHARD_DOCS}), 1), {BUCKETS})::INT AS shards FROM src),
    f AS (SELECT *, 3 * source_size / weight AS ratio,
        ((SELECT sum(source_size) FROM w) - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY 3 * source_size / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
    t AS (SELECT f.*, least((3 * source_size)::DOUBLE, (SELECT level FROM f WHERE ratio >= level ORDER BY ratio, pos LIMIT 1) * weight) AS target FROM f),
    seats AS (SELECT k, count(*) AS won FROM (SELECT k, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, pos, s) AS r
        FROM (SELECT k, pos, target, unnest(range(3 * source_size)) AS s FROM t WHERE target < 3 * source_size AND target > 0))
        WHERE r <= (SELECT sum(source_size) - sum(CASE WHEN target >= 3 * source_size THEN 3 * source_size ELSE 0 END) FROM t) GROUP BY k),
    q AS (SELECT t.*, CASE WHEN target >= 3 * source_size THEN 3 * source_size ELSE coalesce(won, 0) END AS quota FROM t LEFT JOIN seats USING (k)),
    p AS (SELECT d.*, ('0x' || h[1:3])::INT % shards AS shard, source_size, target, quota FROM d JOIN q USING (k)),
    sh AS (SELECT k, shard, sum(size)::BIGINT AS words, any_value(quota) AS quota FROM p GROUP BY k, shard),
    ss AS (SELECT k, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY words / (2 * s + 1) DESC, shard, s) AS r
        FROM (SELECT *, unnest(range(3 * words)) AS s FROM sh)) WHERE r <= quota GROUP BY k, shard),
    ln AS (SELECT k, shard, words, coalesce(won, 0) // words AS rounds, coalesce(won, 0) % words AS extra,
        ('0x' || md5('{SEED}:' || k || ':' || shard)[1:8])::BIGINT % words AS start FROM sh LEFT JOIN ss USING (k, shard) WHERE words > 0),
    o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY k, shard ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p)
SELECT doc_id, size, source_size, target, coalesce(rounds * size + greatest(least(off + size, start + extra, words) - greatest(off, start), 0)
    + greatest(least(off + size, start + extra - words) - off, 0), 0)::BIGINT AS taken FROM o LEFT JOIN ln USING (k, shard)
"""
