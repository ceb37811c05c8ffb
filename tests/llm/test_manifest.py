import zlib
from hashlib import sha256
from itertools import groupby

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import manifest as mk

SF = "/root/testdata/sf0.001"
H = lambda s: sha256(s.encode()).hexdigest()


def leaf(row, more=0):
    row = dict(row, n_chars=None if row["n_chars"] is None else row["n_chars"] + more)
    return H("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in mk.FIELDS))


def path(nodes, i):
    """Siblings of node i up to the root, with their sides, and the root."""
    sides, sibs = "", []
    while len(nodes) > 1:
        run = nodes[i & ~1 : (i & ~1) + 2]
        sides += "-" if len(run) == 1 else "LR"[1 - i % 2]
        sibs += run[: i % 2] + run[i % 2 + 1 :]
        nodes, i = [H("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)], i // 2
    return sides, sibs, nodes[0]


def climb(d, sides, sibs):
    sibs = list(sibs)
    for s in sides:
        d = H({"L": lambda: sibs.pop(0) + d, "R": lambda: d + sibs.pop(0), "-": lambda: d}[s]())
    return d


def slow(rows):
    key = lambda r: (r["lang"] is not None, (r["lang"] or "").encode())
    rows = sorted(rows, key=lambda r: (key(r), r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [list(g) for _, g in groupby(rows, key)]
    subroots, out = [path([leaf(r) for r in t], 0)[2] for t in trees], []
    for k, t in enumerate(trees):
        leaves = [leaf(r) for r in t]
        top = path(subroots, k)
        for i, r in enumerate(t):
            low = path(leaves, i)
            shown = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            folded = climb(climb(shown, low[0], low[1]), top[0], top[1])
            out.append((r["doc_id"], leaves[i], subroots[k], top[2], H("".join(low[1] + top[1])), folded, folded == top[2]))
    return sorted(out, key=str)


def query(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return sorted((tuple(r) for r in mk.op12_manifest(spark, str(folder)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_odd_rows(spark, rows, tmp_path):
    data = [r.asDict() for r in rows.collect()] + [{"doc_id": 7 * i % 40, "text": "x" * i, "lang": None if i % 3 else "zz", "source": None, "n_chars": i if i % 5 else None, "size": 0} for i in range(37)]
    docs = spark.createDataFrame(data, rows.schema)
    got = query(spark, docs, tmp_path)
    assert got == slow(data)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_rows(spark, rows, tmp_path, n):
    data = [r.asDict() for r in rows.collect()][:n]
    assert query(spark, spark.createDataFrame(data, rows.schema), tmp_path) == slow(data)


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(tuple(r) for r in mk.op12_manifest(spark, SF).collect())
    assert got == sorted(con.execute(mk.OP12_SQL).fetchall())


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 31, 64, 100])
def test_missing_is_the_least_union(n):
    rng = np.random.default_rng(n)
    for k in {1, n, int(rng.integers(1, n + 1))}:
        pos = np.sort(rng.choice(n, k, replace=False))
        levels, width = [set(range(n))], n
        while width > 1:
            width = -(-width // 2)
            levels.append(set(range(width)))
        under = [set(p >> level for p in pos.tolist()) for level in range(len(levels))]
        want = {(level, s) for level in range(len(levels) - 1) for s in {p ^ 1 for p in under[level]} - under[level] if s in levels[level]}
        got = mk.missing(pos, n)
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_multiproofs_of_any_subset(spark, height):
    """Low blocks, so that levels lie in several tables and one node has several copies for its requests."""
    sizes = {0: 1, 1: 2, 2: 37, 3: 64, 4: 129}
    data = [(t, n, p, H(f"{t}:{p}"), p * 10) for t, n in sizes.items() for p in range(n)]
    leaves = spark.createDataFrame(data, "tree long, n long, pos long, digest string, doc long")
    forest = mk.build(leaves, height)
    all_leaves = {t: [d[3] for d in data if d[0] == t] for t in sizes}
    assert {r.tree: r.digest for r in forest.roots().collect()} == {t: path(x, 0)[2] for t, x in all_leaves.items()}
    some = leaves.where("(tree = 2 and pos % 5 = 1) or (tree = 4 and pos in (0, 1, 2, 64, 128)) or tree < 2 or (tree = 3 and pos % 2 = 0)")
    for wanted in (some, leaves, some.unionByName(some.where("pos = 1"))):
        got = mk.prove(forest, wanted, height).withColumn("back", mk.fold(F.col("digest"), F.col("sides"), F.col("sibs"))).collect()
        assert len(got) == wanted.count()
        for r in got:
            sides, sibs, root = path(all_leaves[r.tree], r.pos)
            assert (r.sides, r.sibs, r.back, r.doc) == (sides, "".join(sibs), root, r.pos * 10)
    assert mk.prove(forest, leaves.where("false"), height).count() == 0
