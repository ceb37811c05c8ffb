"""Bootstrap means against a loop over draws and picks."""

import hashlib

import numpy as np
import pytest

from gapweave.operators import resample, stats
from helpers import table


def hashed(seed, b, j):
    return int(hashlib.md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize(("seed", "first", "last", "n"), [(42, 0, 12, 123), (7, 98, 101, 1), (123456, 9_998, 10_001, 1002)])
def test_hashes_are_those_of_hash_order(seed, first, last, n):
    want = [[hashed(seed, b, j) for j in range(n)] for b in range(first, last)]
    assert resample.draw_hashes(seed, first, last, n).tolist() == want


@pytest.mark.parametrize("many", [False, True])
def test_means_match_a_loop(spark, monkeypatch, many):
    """Groups of several sizes over several blocks, tiles and stretches of draws; NULL, NaN and infinity among the values."""
    for name, x in (("BLOCK", 4), ("TILE", 30), ("HASHES", 50), ("CELLS", 40)):
        monkeypatch.setattr(resample, name, x)
    rng = np.random.default_rng(1)
    rows = [(k, f"s{i:02}", float(rng.random()), float(rng.random())) for k, n in (("a", 11), ("b", 11), ("c", 3), ("d", 1), ("e", 17)) for i in range(n)]
    odd = {("b", "s03"): (None, float("inf")), ("c", "s01"): (float("nan"), None), ("d", "s00"): (None, 2.0)}
    rows = [(k, u, *odd.get((k, u), (x, y))) for k, u, x, y in rows]
    d = spark.createDataFrame(rows[::-1], "k string, u string, x double, y double")
    got = {(r.k, r.b): (r.x, r.y) for r in resample.bootstrap_means(d, ["k"], ["x", "y"], 20, 42, "u", many).collect()}
    groups = {k: sorted(r for r in rows if r[0] == k) for k in "abcde"}
    assert set(got) == {(k, b) for k in groups for b in range(20)}
    for k, g in groups.items():
        for b in range(20):
            picks = [g[hashed(42, b, j) % len(g)] for j in range(len(g))]
            for c in (0, 1):
                have = [p[2 + c] for p in picks if p[2 + c] is not None]
                want = sum(have) / len(g) if have else None
                assert got[k, b][c] == (want if want is None else pytest.approx(want, nan_ok=True, rel=1e-12)), (k, b, c)


def test_draws_are_not_rows(spark):
    """No row a pick: the plan joins units with their tile only, and no table of draws is made beside them."""
    d = spark.createDataFrame([("m", f"s{i}", float(i)) for i in range(9)], "model string, site string, NMAE double")
    boots = stats.bootstrap_means(d, ["model"], ["NMAE"], 1000)
    plan = boots._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "md5" not in plan
    assert table(stats.summarize_sites(d), "model").n_sites.tolist() == [9]
