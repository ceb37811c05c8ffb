"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

A vector is projected on a few Gaussian (2-stable) directions: the squared projected distance of two vectors is their squared
distance times a chi-square variable. A kd-tree fitted on a bounded sample cuts the projected space into cells; every row
belongs to one, and large cells are salted into chunks with a kd-tree each. A query takes the projected points nearest first and
verifies them in double precision; once the next one's squared projected distance exceeds the chi-square
quantile times the k-th squared distance found, whatever is left is farther with that confidence, and it stops. The test
is applied to cells (after a first round in the query's own cell) and to the leaves inside a chunk.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapweave.llm import common, tiles
from gapweave.plans.storage import materialize

#: Projected dimensions (even), confidence of the stopping test, rows a chunk, queries a block, rows a leaf, rows that fit the cells.
DIMS, CONFIDENCE, CHUNK, BLOCK, LEAF, SAMPLE = 8, 0.99, 4096, 1024, 32, 8192


def chi_square_quantile(p: float, dims: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection of the closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        x = (lo + hi) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        lo, hi = (x, hi) if cdf < p else (lo, x)
    return hi


def projection(dim: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, DIMS))


class KdTree:
    """Median splits on the widest side down to ``leaf`` rows; boxes of all nodes."""

    def __init__(self, y: np.ndarray, leaf: int):
        self.order, self.kids, self.span, lo, hi = np.arange(len(y)), [], [], [], []
        todo = [(0, len(y), -1)]
        while todo:
            a, b, parent = todo.pop()
            me = len(self.span)
            if parent >= 0:
                self.kids[parent].append(me)
            rows = self.order[a:b]
            lo.append(y[rows].min(axis=0))
            hi.append(y[rows].max(axis=0))
            self.kids.append([])
            self.span.append((a, b))
            if b - a > leaf and (wide := int((hi[-1] - lo[-1]).argmax())) >= 0 and hi[-1][wide] > lo[-1][wide]:
                mid = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(y[rows, wide], mid)]
                todo += [(a, a + mid, me), (a + mid, b, me)]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from ``q`` to the box of every node."""
        return (np.maximum(np.maximum(self.lo - q, q - self.hi), 0) ** 2).sum(axis=1)


def cut_planes(y: np.ndarray, cells: int) -> list[tuple[int, int, float]]:
    """Heap-ordered (node, side, median) of a kd-tree of at most ``cells`` leaves over sample rows."""
    planes, todo = [], [(1, np.arange(len(y)))]
    while todo:
        node, rows = todo.pop()
        if 2 * node > 2 * cells - 1 or len(rows) < 4:
            continue
        side = int(np.ptp(y[rows], axis=0).argmax())
        at = float(np.median(y[rows, side]))
        below = y[rows, side] < at
        if below.any() and not below.all():
            planes.append((node, side, at))
            todo += [(2 * node, rows[below]), (2 * node + 1, rows[~below])]
    return planes


def _cell_of(y: np.ndarray, planes: list[tuple[int, int, float]]) -> np.ndarray:
    cell = np.ones(len(y), np.int64)
    for node, side, at in sorted(planes):  # parents before children
        here = cell == node
        cell[here] = 2 * node + (y[here, side] >= at)
    return cell


def _indexed(rows: DataFrame, planes: dict[int, list]) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.LongType()), T.StructField("y", T.ArrayType(T.DoubleType()))])
    at = rows.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(at).value_lengths().to_numpy()
            cell, y = np.zeros(len(dims), np.int64), np.zeros((len(dims), DIMS))
            for d in np.unique(dims).tolist():
                of = np.flatnonzero(dims == d)
                y[of] = common.stack_vectors(b.column(at).take(pa.array(of))) @ projection(d)
                cell[of] = _cell_of(y[of], planes.get(d, []))
            made = [pa.array(dims, pa.int32()), pa.array(cell), pa.array(list(y), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def _search(k: int, quantile: float):
    def group(g: dict) -> Iterator[list]:
        ask = g["asks"]
        p, qs = np.flatnonzero(~ask), np.flatnonzero(ask)
        if not len(p) or not len(qs):
            return
        y, x, rid, vid, none = g["y"][p], np.asarray(g["v"][p], dtype=np.float64), g["rid"][p], g["vec_id"][p], g["none"][p]
        tree = KdTree(y, LEAF)
        found: list[list] = [[], [], [], [], []]
        for q in qs:
            box, qx, me = tree.distances(g["y"][q]).tolist(), np.asarray(g["v"][q], dtype=np.float64), g["rid"][q]
            limit = g["bound"][q]
            best, near = np.zeros(0, np.int64), np.zeros(0)
            agenda = [(box[0], 0)]
            while agenda and agenda[0][0] <= quantile * limit + 1e-9:
                take: list[np.ndarray] = []
                while agenda and len(take) < 8 and agenda[0][0] <= quantile * limit + 1e-9:
                    _, node = heapq.heappop(agenda)
                    if kids := tree.kids[node]:
                        for c in kids:
                            heapq.heappush(agenda, (box[c], c))
                    else:
                        take.append(tree.order[slice(*tree.span[node])])
                if not take:
                    continue
                of = np.concatenate(take)
                of = of[rid[of] != me]
                d = ((x[of] - qx) ** 2).sum(axis=1)
                best, near = np.concatenate([best, of]), np.concatenate([near, d])
                if len(best) > k:
                    keep = np.lexsort((vid[best], near))[:k]
                    best, near = best[keep], near[keep]
                if len(near) >= k:
                    limit = min(limit, float(near.max()))
            n = len(best)
            found[0].append(np.full(n, me))
            found[1].append(rid[best])
            found[2].append(vid[best])
            found[3].append(none[best])
            found[4].append(near)
        yield [np.concatenate(c) for c in found]

    return group


def nearest(rows: DataFrame, is_query, k: int = 10, confidence: float = CONFIDENCE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row of ``rows(vec_id, embedding)`` with an id where ``is_query`` (on vec_id) holds, its k nearest other rows.

    Euclidean distance in double precision on the original vectors, ties to the smaller vec_id (NULL last). Vectors that are NULL,
    empty, zero or hold NULL or non-finite components take no part; only vectors of one length are compared. Rows of equal id stay rows, and
    only the query's own row is left out. With fewer than k candidates all are returned; an empty table gives an empty result.
    """
    quantile = chi_square_quantile(confidence, DIMS)
    rows = rows.where(common.usable_vector(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumns({"none": F.col("vec_id").isNull(), "vec_id": F.coalesce("vec_id", F.lit(2**63 - 1))})  # NULL ids come last among ties
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "ann-rows")
    n = rows.count()
    # the sample only fits the cells' planes: at most SAMPLE rows reach the driver, every row is indexed
    sample = rows.orderBy(F.xxhash64("vec_id", "rid")).limit(SAMPLE).select("v").toPandas()["v"] if n else []
    by_dim: dict[int, list] = {}
    for v in sample:
        by_dim.setdefault(len(v), []).append(v)
    cells = 1 << max(0, min(math.ceil(math.log2(max(n, 1) / CHUNK)), int(math.log2(SAMPLE)) - 3))
    planes = {d: cut_planes(np.array(v) @ projection(d), cells) for d, v in by_dim.items()}
    indexed = materialize(_indexed(rows, planes), "ann-index")
    box = [f(F.col("y")[i]) for i in range(DIMS) for f in (F.min, F.max)]
    # at most 2 x cells rows for each length of vector
    boxes = indexed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"), F.array(*box).alias("box")).toPandas()
    chunks = {(int(r.dim), int(r.cell)): max(1, math.ceil(r.n / CHUNK)) for r in boxes.itertuples()}
    per_dim = {d: (p["cell"].to_numpy(), np.array(p["box"].tolist()).reshape(-1, DIMS, 2)) for d, p in boxes.groupby("dim")} if len(boxes) else {}
    queries = indexed.where(is_query & ~F.col("none"))
    schema_asks = T.StructType([*indexed.schema.fields, T.StructField("bound", T.DoubleType()), T.StructField("chunk", T.IntegerType())])
    schema_found = T.StructType([T.StructField("asker", T.LongType()), T.StructField("rid", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("none", T.BooleanType()), T.StructField("d", T.DoubleType())])

    def to_cells(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 128):
                    b = whole.slice(lo, 128)
                    dim, cell, bound = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("dim", "cell", "bound"))
                    y = common.stack_vectors(b.column(b.schema.get_field_index("y")))
                    row, to = [], []
                    for i in range(b.num_rows):
                        names, sides = per_dim[int(dim[i])]
                        gap = (np.maximum(np.maximum(sides[:, :, 0] - y[i], y[i] - sides[:, :, 1]), 0) ** 2).sum(axis=1)
                        go = [int(cell[i])] if home else names[(gap <= quantile * bound[i] + 1e-9) & (names != cell[i])].tolist()
                        for c in go:
                            m = chunks[int(dim[i]), c]
                            row += [i] * m
                            to += [(c, x) for x in range(m)]
                    if row:
                        t = b.take(pa.array(row))
                        cols = {f.name: t.column(k) for k, f in enumerate(b.schema)}
                        cols |= {"cell": pa.array([c for c, _ in to], pa.int64()), "chunk": pa.array([x for _, x in to], pa.int32())}
                        yield pa.RecordBatch.from_arrays([cols[c] for c in schema_asks.names], names=schema_asks.names)

        return run

    keys = ["dim", "cell", "chunk", "block"]
    points = indexed.withColumn("bound", F.lit(0.0))
    sizes = indexed.groupBy("dim", "cell").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CHUNK, F.lit(1.0))).cast("int").alias("m"))
    points = materialize(points.join(sizes, ["dim", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rid"), F.col("m")).cast("int")).drop("m"), "ann-points")

    def search(asks: DataFrame, home: bool) -> DataFrame:
        routed = materialize(asks.mapInArrow(to_cells(home), schema_asks), "ann-asks")
        blocks = routed.groupBy("dim", "cell", "chunk").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        own = routed.join(blocks, ["dim", "cell", "chunk"]).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(True))
        there = points.join(blocks, ["dim", "cell", "chunk"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(False))
        cols = [*keys, "asks", "rid", "vec_id", "none", "v", "y", "bound"]
        both = own.select(*cols).unionByName(there.select(*cols))
        return tiles.scan(both, keys, _search(k, quantile), schema_found)

    order = Window.partitionBy("asker").orderBy("d", "vec_id", "rid")
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = materialize(top(search(queries.withColumn("bound", F.lit(math.inf)), True)), "ann-first")
    bound = first.groupBy("asker").agg(F.when(F.count(F.lit(1)) == k, F.max("d")).alias("far"))
    again = queries.join(bound, queries["rid"] == bound["asker"], "left").drop("asker").withColumn("bound", F.coalesce("far", F.lit(math.inf))).drop("far")
    found = top(first.drop("rank").unionByName(search(again, False)))
    names = queries.select(F.col("rid").alias("asker"), F.col("vec_id").alias("query_id"))
    return found.join(names, "asker").select("query_id", F.col("rank").cast("int").alias("rank"), F.when(~F.col("none"), F.col("vec_id")).alias("vec_id"), F.sqrt("d").alias("score"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest embeddings of every one whose vec_id is divisible by 100."""
    return nearest(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)
