"""Near-duplicate vectors by spherical-cap filters.

The filter directions are structured random product codes: after a random rotation the coordinates fall into blocks, each block
has a small random code, and every combination of one code word per block is a direction. A vector is list-decoded to all
directions that exceed its cap height, the height at which ``LIST`` directions of a code do: the best words of each block
are combined pairwise, and no combination outside the best of a part can be among the best of the whole. Vectors that
share a direction meet in its bucket and are verified in double precision. Several rotations even out how well a vector is covered (two
vectors at cosine 0.95 share 25 directions on average), and the codes grow with the number of vectors, so that a bucket holds few
strangers. Equal vectors are one item with a weight. Buckets are compared in tiles of bounded size; a pair is counted
in the first direction that both vectors have, so nothing has to be deduplicated and no pairs are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common, tiles
from gapweave.llm.components import connected
from gapweave.plans.storage import materialize

#: Rotations, directions of a vector in each, directions in each per vector of the table, rows of a tile's chunk.
ROTATIONS, LIST, SPARE, CHUNK = 6, 12, 64, 512


def _top(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and scores of the ``k`` best of every row."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape), scores
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return best, np.take_along_axis(scores, best, axis=1)


def cap_share(dim: int, angle: float = 0.4) -> float:
    """Share of the sphere within ``angle`` of a direction (a little more than the angle of vectors at cosine 0.95)."""
    at = np.linspace(0, np.pi, 20_001)
    ring = np.sin(at) ** max(dim - 2, 0)
    return max(float(ring[at <= angle].sum() / ring.sum()), 1e-300)


class ProductCode:
    """Codes for vectors of ``dim`` components in a table of ``n``; everything follows from the arguments."""

    def __init__(self, dim: int, n: int, rotations: int = ROTATIONS, listed: int = LIST, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.blocks, self.listed = 4 if dim >= 16 else 2 if dim >= 4 else 1, listed
        most = max(64.0, listed / cap_share(dim))  # finer than that, the directions listed would lie closer than the vectors to be linked
        self.size = ceil(min(max(SPARE * n, 4096), most) ** (1 / self.blocks))
        self.cuts = np.array_split(np.arange(dim), self.blocks)
        self.codes = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
            words = [rng.standard_normal((self.size, len(c))) for c in self.cuts]
            self.codes.append((turn, [w / np.linalg.norm(w, axis=1, keepdims=True) for w in words]))

    def decode(self, unit: np.ndarray) -> np.ndarray:
        """Sorted directions of every row."""
        out = []
        for r, (turn, words) in enumerate(self.codes):
            x, parts = unit @ turn, []
            for c, w in zip(self.cuts, words, strict=True):
                i, s = _top(x[:, c] @ w.T, self.listed)
                parts.append((i.astype(np.int64), s))
            while len(parts) > 1:  # neighbours pairwise, so the places of the words keep their order
                (i, s), (j, t) = parts[:2]
                k, u = _top((s[:, :, None] + t[:, None, :]).reshape(len(x), -1), self.listed)
                joined = (i[:, :, None] * self.size + j[:, None, :]).reshape(len(x), -1)
                parts[:2] = [(np.take_along_axis(joined, k, axis=1), u)]
            out.append(parts[0][0] + r * self.size**self.blocks)
        return np.sort(np.concatenate(out, axis=1), axis=1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _decoded(items: DataFrame, n: int) -> DataFrame:
    schema = T.StructType([*items.schema.fields, T.StructField("directions", T.ArrayType(T.LongType()))])
    at = items.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for b in batches:
            found: list[np.ndarray] = [np.zeros(0, np.int64)] * b.num_rows
            sizes = b.column(at).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():  # vectors of another length share no direction with these
                rows = np.flatnonzero(sizes == dim)
                if dim not in codes:
                    codes[dim] = ProductCode(dim, n)
                code = codes[dim]
                for r, d in zip(rows, code.decode(_unit(common.stack_vectors(b.column(at).take(pa.array(rows))))), strict=True):
                    found[r] = d
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return items.mapInArrow(run, schema)


def _tile(least_cosine: float):
    def tile(g: dict) -> Iterator[list]:
        own, f = g["_own"], g["f"][0]
        same = g["_a"][0] == g["_b"][0]
        i = np.flatnonzero(own == g["_a"][0])
        j = i if same else np.flatnonzero(own == g["_b"][0])
        if not len(i) or not len(j):
            return
        unit = _unit(np.asarray(g["v"], dtype=np.float64))
        a, b = np.nonzero(unit[i] @ unit[j].T >= least_cosine)
        if same:
            a, b = a[a != b], b[a != b]
        if not len(a):
            return
        root = tiles.roots(len(own), i[a], j[b])
        moved = np.flatnonzero(root != np.arange(len(own)))
        item = g["item"]
        if len(moved):
            yield [item[moved], item[root[moved]], np.zeros(len(moved), np.int64)]
        # pairs that also share an earlier direction are counted there
        lists = g["directions"]
        if isinstance(lists, np.ndarray):
            flat, row = lists.ravel(), np.repeat(np.arange(len(own)), lists.shape[1])
        else:
            flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy())
        linked = np.zeros(len(own), bool)
        linked[i[a]] = linked[j[b]] = True
        early = (flat < f) & linked[row]
        _, col = np.unique(flat[early], return_inverse=True)
        has = np.zeros((len(own), int(col.max()) + 1 if len(col) else 1), np.float32)
        has[row[early], col] = 1
        met = has[i] @ has[j].T
        new = met[a, b] == 0
        n = np.zeros(len(own), np.int64)
        np.add.at(n, i[a[new]], g["weight"][j[b[new]]])
        if not same:
            np.add.at(n, j[b[new]], g["weight"][i[a[new]]])
        if (some := np.flatnonzero(n)).size:
            yield [item[some], item[some], n[some]]

    return tile


def near_vectors(rows: DataFrame, least_cosine: float = 0.95) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``rows(vec_id, embedding)``.

    NULL, empty, zero vectors and those with NULL or non-finite components link with nothing; vectors of another length are
    never compared. Equal vectors (also with equal vec_id) are links of each other. A component is named by its smallest
    vec_id; a NULL vec_id names none. An empty table gives an empty result.
    """
    v = F.col("embedding")
    rows = rows.select("vec_id", v, common.usable_vector(v).alias("ok"))
    key = {"c1": F.when(F.col("ok"), F.xxhash64(F.lit(1), v)), "c2": F.when(F.col("ok"), F.xxhash64(F.lit(2), v))}
    rows = rows.withColumns(key)
    items = rows.where("ok").groupBy("c1", "c2").agg(F.first("embedding").alias("v"), F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("low"))
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "cap-items")
    n = items.count()
    decoded = materialize(_decoded(items.select("item", "v", "weight"), n), "cap-directions")
    slim = decoded.select(F.size("v").alias("dim"), F.explode("directions").alias("f"), "item")
    shared = slim.groupBy("dim", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = tiles.deal(slim.join(shared, ["dim", "f"]), "n", ["item"], CHUNK).join(decoded, "item")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v", "n")])
    found = materialize(tiles.scan(dealt.select("dim", "f", "_a", "_b", "_own", "item", "v", "weight", "directions"), ["dim", "f", "_a", "_b"], _tile(least_cosine), schema), "cap-links")
    counts = found.where("u = v").groupBy(F.col("u").alias("item")).agg(F.sum("n").alias("n"))
    comps = connected(found.where("u <> v").select("u", "v")).withColumnsRenamed({"node": "item", "component": "root"})
    named = items.drop("v").join(counts, "item", "left").join(comps, "item", "left").withColumn("root", F.coalesce("root", "item"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component"))
    links = F.coalesce("n", F.lit(0)) + F.col("weight") - 1
    per_item = materialize(named.join(lowest, "root").select("c1", "c2", "component", links.cast("long").alias("links")), "cap-components")
    component = F.when(F.col("ok"), F.col("component")).otherwise(F.col("vec_id"))
    return rows.drop("embedding").join(per_item, ["c1", "c2"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_vectors(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
