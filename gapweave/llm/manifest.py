"""Merkle manifest of a dataset with octopus multiproofs.

Every row is a leaf; leaves of one group (``lang``) form a binary tree in order of their ids, the roots of the groups form a tree in turn.
Positions come from a range sort that is written once, so no group is gathered, and interior nodes are made ten levels at a
time from aligned blocks of 1,024 nodes; all nodes are kept as tables, ten levels in each.

Proofs are made by blocks of leaves. A block works out level by level which sibling coordinates cannot be derived from the leaves that it
is asked for: the smallest union that proves all of them. Those are fetched by one join against the node tables (a node that many blocks ask for stands
there in as many copies, so that at most 1,024 requests meet one row), interiors shared by its leaves are derived in the block, and every leaf's own path
is read off the merged levels.

A digest is lowercase hex sha256. A proof is ``sides``, one letter a level from the leaf up (L or R: where the sibling stands, -: a node without sibling), and
``sibs``, the siblings' digests in that order, 64 characters each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import common
from gapweave.plans.storage import materialize, sequential_ids

#: Levels of a block, and of requests that share one copy of a node.
HEIGHT = 10
_NODES = "array<struct<level:int,pos:long,digest:string>>"


@dataclass(frozen=True)
class Forest:
    """``leaves(tree, n, pos, digest, ...)`` with ``n`` leaves in their tree; ``tiers``: tables ``(tree, n, level, pos, digest)``, leaves first."""

    leaves: DataFrame
    tiers: tuple[DataFrame, ...]

    def roots(self) -> DataFrame:
        at_top = [t.where(F.col("level") == _depth(F.col("n"))).select("tree", "digest") for t in self.tiers]
        out = at_top[0]
        for t in at_top[1:]:
            out = out.unionByName(t)
        return out


@dataclass(frozen=True)
class Manifest:
    """``forest``: one tree a group; ``trees(tree, <group>, subroot)``; ``top``: the tree of their roots; ``root(root)``: one row, none for an empty table."""

    forest: Forest
    trees: DataFrame
    top: Forest
    root: DataFrame


def _depth(n: Column) -> Column:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _up(left: str, right: str = "") -> str:
    return sha256((left + right).encode()).hexdigest()


def _interiors(digests: pa.Array, n: pa.Array, block: pa.Array, base: int, height: int) -> pa.Array:
    """Nodes above consecutive nodes of level ``base``, up to the top of their block or tree."""
    out = []
    for d, size, b in zip(digests, n.to_pylist(), block.to_pylist(), strict=True):
        now, found = d.as_py(), []
        for k in range(1, min(height, (size - 1).bit_length() - base) + 1):
            now = [_up(*now[i : i + 2]) for i in range(0, len(now), 2)]
            first = b << (height - k)
            found += [(base + k, first + i, x) for i, x in enumerate(now)]
        out.append(found)
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in out])])
    level, pos, digest = zip(*(x for f in out for x in f), strict=True) if sizes[-1] else ((), (), ())
    flat = pa.StructArray.from_arrays([pa.array(level, pa.int32()), pa.array(pos, pa.int64()), pa.array(digest, pa.string())], ["level", "pos", "digest"])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)


def build(leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """All nodes above ``leaves(tree, n, pos, digest)``; positions of a tree run from 0 to n - 1."""
    most = leaves.agg(F.max("n")).first()[0] or 1
    now = leaves.select("tree", "n", F.lit(0).alias("level"), "pos", "digest")
    tiers = [now]
    for base in range(0, (most - 1).bit_length(), height):
        block = F.shiftright("pos", height).alias("block")
        blocks = now.where(_depth(F.col("n")) > base).groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("x"))
        made = F.arrow_udf(lambda digests, n, block, base=base: _interiors(digests, n, block, base, height), _NODES)
        tiers.append(materialize(blocks.select("tree", "n", F.inline(made(F.col("x.digest"), "n", "block"))), "merkle-nodes"))
        now = tiers[-1].where(F.col("level") == base + height)
    return Forest(leaves, tuple(tiers))


def missing(pos: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Coordinates (level, position) of the fewest nodes that, with the leaves at ``pos``, give the root of a tree of ``n`` leaves."""
    known, width, out = np.unique(pos), n, []
    for level in range((n - 1).bit_length()):
        sib = known ^ 1
        out += [(level, int(p)) for p in sib[(sib < width) & ~np.isin(sib, known)]]
        known, width = np.unique(known >> 1), -(-width // 2)
    return out


def _requests(pos: pa.Array, n: pa.Array) -> pa.Array:
    rows = [missing(p.values.to_numpy(), size) for p, size in zip(pos, n.to_pylist(), strict=True)]
    return pa.array([[{"level": a, "pos": b} for a, b in r] for r in rows], pa.list_(pa.struct([("level", pa.int32()), ("pos", pa.int64())])))


def paths(pos: np.ndarray, digest: np.ndarray, fetched: list[dict], n: int) -> tuple[list[str], list[str]]:
    """``sides`` and ``sibs`` of every leaf of a block from its leaves and the fetched nodes."""
    m, depth = len(pos), (n - 1).bit_length()
    sides, sibs = np.full((m, depth), b"-", dtype="S1"), np.zeros((m, depth), dtype="S64")
    have, first = np.unique(pos, return_index=True)
    hashes, width = digest[first], n
    for level in range(depth):
        more = [(f["pos"], f["digest"]) for f in fetched if f["level"] == level]
        at = np.concatenate([have, np.array([p for p, _ in more], dtype=np.int64)])
        d = np.concatenate([hashes, np.array([x for _, x in more], dtype="S64")])
        order = np.argsort(at)
        at, d = at[order], d[order]
        own = pos >> level
        paired = (own ^ 1) < width
        sides[paired, level] = np.where(own[paired] & 1, b"L", b"R")
        sibs[paired, level] = d[np.searchsorted(at, own[paired] ^ 1)]
        have, text = np.unique(have >> 1), d.astype("U64")
        i = np.searchsorted(at, 2 * have)
        two = 2 * have + 1 < width
        hashes = np.array([_up(text[k], text[k + 1] if t else "") for k, t in zip(i.tolist(), two.tolist(), strict=True)], dtype="S64")
        width = -(-width // 2)
    return [b"".join(r).decode() for r in sides.tolist()], [b"".join(r).decode() for r in sibs.tolist()]


def _expanded(pos: pa.Array, digest: pa.Array, fetched: pa.Array, n: pa.Array) -> pa.Array:
    out = []
    for p, d, f, size in zip(pos, digest, fetched, n.to_pylist(), strict=True):
        sides, sibs = paths(p.values.to_numpy(), np.array(d.as_py(), dtype="S64"), f.as_py() or [], size)
        out.append([{"sides": a, "sibs": b} for a, b in zip(sides, sibs, strict=True)])
    return pa.array(out, pa.list_(pa.struct([("sides", pa.string()), ("sibs", pa.string())])))


def _fetch(forest: Forest, asked: DataFrame, height: int) -> DataFrame:
    """``(tree, block, fetched)``: the nodes that every block asks for, each asked for once."""
    wants = F.arrow_udf(_requests, "array<struct<level:int,pos:long>>")
    requests = materialize(asked.select("tree", "block", F.inline(wants(F.col("asked.pos"), "n"))), "merkle-requests")
    copies = F.pow(F.lit(2), F.greatest(F.col("level") - 2 * height, F.lit(0))).cast("long")
    salted = requests.withColumn("copy", F.pmod(F.shiftright("block", height), copies))
    first, found = requests.agg(F.min("level")).first()[0], []
    for k, tier in enumerate(forest.tiers):
        # whole blocks ask for nothing below their own roots, so the wide low tiers are not read for them
        if first is not None and k * height >= first:
            nodes = tier.select("tree", "level", "pos", "digest", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
            found.append(salted.join(nodes, ["tree", "level", "pos", "copy"]).select("tree", "block", "level", "pos", "digest"))
    if not found:
        return asked.select("tree", "block").limit(0).withColumn("fetched", F.lit(None).cast(_NODES))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("tree", "block").agg(F.collect_list(F.struct("level", "pos", "digest")).alias("fetched"))


def prove(forest: Forest, wanted: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``wanted`` (rows ``(tree, n, pos, digest, ...)`` of the forest's leaves, any subset, repeated rows stay) with ``sides`` and ``sibs`` up to the tree's root."""
    rest = [c for c in wanted.columns if c not in ("tree", "n", "sides", "sibs")]
    block = F.shiftright("pos", height).alias("block")
    asked = wanted.groupBy("tree", "n", block).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("asked"))
    asked = materialize(asked, "merkle-asked")
    expand = F.arrow_udf(_expanded, "array<struct<sides:string,sibs:string>>")
    both = asked.join(_fetch(forest, asked, height), ["tree", "block"], "left")
    done = both.withColumn("proofs", expand(F.col("asked.pos"), F.col("asked.digest"), "fetched", "n"))
    rows = done.select("tree", "n", F.explode(F.arrays_zip("asked", "proofs")).alias("r"))
    return rows.select("tree", "n", *[F.col(f"r.asked.`{c}`").alias(c) for c in rest], "r.proofs.sides", "r.proofs.sibs")


def fold(leaf: Column, sides: Column, sibs: Column) -> Column:
    """Root that a leaf and its proof lead to."""

    def step(acc: Column, i: Column) -> Column:
        side, sib = F.substring(sides, i, F.lit(1)), F.substring(sibs, acc["at"], F.lit(64))
        both = F.when(side == "L", F.concat(sib, acc["d"])).when(side == "R", F.concat(acc["d"], sib)).otherwise(acc["d"])
        return F.struct(F.sha2(both, 256).alias("d"), (acc["at"] + F.when(side == "-", 0).otherwise(64)).alias("at"))

    levels = F.sequence(F.lit(1), F.greatest(F.length(sides), F.lit(1)))
    return F.when(F.length(sides) == 0, leaf).otherwise(F.aggregate(levels, F.struct(leaf.alias("d"), F.lit(1).alias("at")), step, lambda acc: acc["d"]))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field ``-`` if NULL, else its UTF-8 byte count, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def manifest(rows: DataFrame, group: str, order: str, height: int = HEIGHT) -> Manifest:
    """Trees over ``rows``, which hold their ``digest``: one for each value of ``group`` (a NULL one first, others by UTF-8 bytes), leaves in ``order``.

    NULLs of ``order`` come first, ties are ordered by digest, and rows equal in both are the same leaf at different places. All columns of ``rows`` stay
    beside the leaves; those named ``tree``, ``n`` or ``pos`` are replaced. Equal rows are spread over the sort by their place in the input.
    """
    src = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("tree", "n", "pos")])
    salt, seq = common.unique_name(src, "_salt"), common.unique_name(src, "_seq")
    placed = sequential_ids(src.withColumn(salt, F.monotonically_increasing_id()), [group, order, "digest", salt], seq, "merkle-leaves").drop(salt)
    groups = materialize(placed.groupBy(F.col(group).alias("g")).agg(F.min(seq).alias("first"), F.count(F.lit(1)).alias("n")), "merkle-groups")
    groups = materialize(sequential_ids(groups, ["g"], "tree", "merkle-group-order"), "merkle-trees")
    leaves = placed.join(groups, placed[group].eqNullSafe(groups["g"])).select("tree", "n", (F.col(seq) - F.col("first")).alias("pos"), *[F.col(f"`{c}`") for c in src.columns])
    forest = build(materialize(leaves, "merkle-placed"), height)
    trees = materialize(groups.select("tree", F.col("g").alias(group)).join(forest.roots().withColumnRenamed("digest", "subroot"), "tree"), "merkle-subroots")
    top = trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("subroot").alias("digest"))
    top = build(materialize(top.join(trees.agg(F.count(F.lit(1)).alias("n"))), "merkle-top"), height)
    return Manifest(forest, trees, top, top.roots().select(F.col("digest").alias("root")))


def prove_rows(made: Manifest, wanted: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``wanted`` rows of the manifest's leaves with ``subroot``, ``root`` and the proof (``sides``, ``sibs``) from the leaf to the root."""
    upper = prove(made.top, made.top.leaves, height).select(F.col("pos").alias("tree"), F.col("sides").alias("_sides"), F.col("sibs").alias("_sibs"))
    upper = materialize(made.trees.select("tree", "subroot").join(upper, "tree").join(made.root), "merkle-upper")
    low = prove(made.forest, wanted.select(*[F.col(f"`{c}`") for c in wanted.columns if c not in ("subroot", "root")]), height)
    both = low.join(upper, "tree").withColumns({"sides": F.concat("sides", "_sides"), "sibs": F.concat("sibs", "_sibs")})
    return both.drop("_sides", "_sibs")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof digest of every document, and what a leaf that may be tampered with folds to.

    Every row is a leaf. A NULL doc_id comes first in its tree and is never tampered with; a NULL lang is a tree of its own. One document alone has the digest of no sibling.
    """
    docs = common.table(spark, sf_dir, "documents")
    tampered = F.when(common.fold(F.col("doc_id"), 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    as_is, other = ([tampered if t and f == "n_chars" else F.col(f) for f in FIELDS] for t in (False, True))
    rows = docs.select("doc_id", "lang", leaf_digest(as_is).alias("digest"), leaf_digest(other).alias("shown"))
    made = manifest(rows, "lang", "doc_id")
    proven = prove_rows(made, made.forest.leaves)
    folded = proven.withColumn("folded_root", fold(F.col("shown"), F.col("sides"), F.col("sibs")))
    return folded.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2("sibs", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_LEAF = " || ".join("coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".replace("{0}", "{" + f + "}") for f in FIELDS)
_AS_IS = {f: f for f in FIELDS}
#: One recursion for the trees and one for the tree above them; a path is joined level by level.
OP12_SQL = f"""
WITH RECURSIVE {common.CRC_SQL},
    d AS (SELECT doc_id, lang, sha256({_LEAF.format(**_AS_IS)}) AS leaf,
        CASE WHEN {common.crc32_sql("doc_id::VARCHAR")} % 7 = 0 THEN sha256({_LEAF.format(**{**_AS_IS, "n_chars": "(n_chars + 1)"})}) ELSE sha256({_LEAF.format(**_AS_IS)}) END AS shown FROM documents JOIN crc ON true),
    g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM d)),
    p AS (SELECT doc_id, tree, leaf, shown, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN g ON d.lang IS NOT DISTINCT FROM g.lang),
    low(tree, level, pos, d, n) AS (SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM p UNION ALL
        SELECT tree, level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY tree, level, pos // 2),
    sub AS (SELECT tree, d AS subroot FROM low WHERE n = 1),
    high(level, pos, d, n) AS (SELECT 0, tree, subroot, count(*) OVER () FROM sub UNION ALL
        SELECT level + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
    every AS (SELECT tree, level, pos, d, n, 0 AS part FROM low UNION ALL SELECT -1, level, pos, d, n, 1 FROM high),
    walk(doc_id, leaf, key, part, tree, own, level, pos, sibs, now) AS (SELECT doc_id, leaf, tree || ':' || pos, 0, tree, tree, 0, pos, '', shown FROM p UNION ALL
        SELECT w.doc_id, w.leaf, w.key, CASE WHEN e.n = 1 THEN w.part + 1 ELSE w.part END, CASE WHEN e.n = 1 THEN -1 ELSE w.tree END, w.own,
            CASE WHEN e.n = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN e.n = 1 THEN w.own ELSE w.pos // 2 END, w.sibs || coalesce(s.d, ''),
            CASE WHEN e.n = 1 THEN w.now WHEN w.pos % 2 = 1 THEN sha256(s.d || w.now) ELSE sha256(w.now || coalesce(s.d, '')) END
        FROM walk w JOIN every e ON e.part = w.part AND e.tree = w.tree AND e.level = w.level AND e.pos = w.pos
        LEFT JOIN every s ON s.part = w.part AND s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.part < 2)
SELECT doc_id, leaf, subroot, root, sha256(sibs) AS proof_sha256, now AS folded_root, now = root AS verified
FROM walk JOIN sub ON sub.tree = walk.own JOIN (SELECT d AS root FROM high WHERE n = 1) ON true WHERE part = 2
"""
