import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.llm import caps, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def odd(rng):
    v = rng.standard_normal(16).tolist()
    return [(900, None, 0), (901, [0.0] * 16, 0), (902, [*v[:15], None], 0), (903, [*v[:15], math.nan], 0), (904, [*v[:15], math.inf], 0), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (None, v, 0), (50, v, 1), (50, v, 1)]


def clustered(rng, n=300):
    out, base = [], rng.standard_normal((20, 16))
    for i in range(n):
        v = base[i % 20] + rng.standard_normal(16) * rng.choice([0.02, 0.15, 0.3, 1.0])
        out.append((i + 1000, (v * rng.uniform(0.1, 50)).tolist(), 0))
    return out


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [*odd(rng), *clustered(rng)]
    df = spark.createDataFrame(data, SCHEMA)
    data = [(r.vec_id, r.embedding) for r in df.collect()]
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in data]
    n = len(data)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            if i != j and ok[i] and ok[j] and len(data[i][1]) == len(data[j][1]):
                a, b = np.array(data[i][1]), np.array(data[j][1])
                link[i, j] = a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.95
    comp = np.array([math.inf if k is None else k for k, _ in data])
    while (new := np.where(link, comp[None, :], comp[:, None]).min(axis=1)).tolist() != comp.tolist():
        comp = np.minimum(comp, new)
    want = sorted((str(k), int(link[i].sum()), str(None if comp[i] == math.inf else int(comp[i]))) for i, (k, _) in enumerate(data))
    got = caps.near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_hot_group_in_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(caps, "CHUNK", 16)
    rng = np.random.default_rng(4)
    v = rng.standard_normal(32)
    data = [(i, (v + rng.standard_normal(32) * 0.01).tolist(), 0) for i in range(120)]
    got = caps.near_vectors(spark.createDataFrame(data, SCHEMA)).collect()
    assert all(r.n_links == 119 and r.component_id == 0 for r in got)


def test_codes_cover_pairs_at_the_threshold():
    rng = np.random.default_rng(5)
    for dim in (3, 8, 64):
        code = caps.ProductCode(dim, 20_000)
        x = rng.standard_normal((400, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = rng.standard_normal((400, dim))
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + math.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        assert all(len(np.intersect1d(a, b)) for a, b in zip(code.decode(x), code.decode(y)))


def test_chi_square_quantile():
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991464547) < 1e-6 and abs(neighbours.chi_square_quantile(0.99, 8) - 20.090235) < 1e-5


@pytest.mark.parametrize("chunk", [64, 4096])
def test_recall_ties_and_odd_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    data = [*odd(rng), *clustered(rng, 600)]
    df = spark.createDataFrame(data, SCHEMA)
    usable = [(r.vec_id, np.array(r.embedding, dtype=float)) for r in df.collect() if r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    got = neighbours.nearest(df, F.col("vec_id") % 10 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    for i, (k, v) in enumerate(usable):
        if k is None or k % 10 or k == 50:
            continue
        near = sorted((float(np.sqrt(((v - w) ** 2).sum())), math.inf if j is None else j) for m, (j, w) in enumerate(usable) if m != i and len(w) == len(v))[:10]
        mine = sorted(by[k])
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [s for _, _, s in mine] == sorted(s for _, _, s in mine)
        hit += len({j for _, j in near} & {math.inf if j is None else j for _, j, _ in mine})
        total += len(near)
    assert hit >= 0.9 * total
    twins = [r for r in got if r.query_id == 50 and r["rank"] <= 2]  # each of two equal rows finds the other and the row without id at distance 0
    assert len(twins) == 4 and all(r.score == 0 for r in twins)


def test_few_and_none(spark):
    few = spark.createDataFrame([(100, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (200, [1.0, 1.0, 1.0], 0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in neighbours.nearest(few, F.col("vec_id") % 100 == 0).collect()] == [(100, 1, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert neighbours.nearest(empty, F.col("vec_id") % 100 == 0).count() == 0 and caps.near_vectors(empty).count() == 0
