"""Subtractive statistics against the naive per-case recomputation."""

import numpy as np
import pandas as pd
import pytest

from gapweave.operators import impute, references
from helpers import cases, panel, table

N = 160


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(3)
    base = np.sin(np.arange(N) / 7)
    series = {}
    for i, s in enumerate(("t0", "r1", "r2", "r3", "r4")):
        x = base * (1 - 0.15 * i) + rng.normal(0, 0.1 + 0.12 * i, N)
        x[rng.random(N) < 0.1] = np.nan
        series[(s, "v")] = np.round(x, 4)
    # a reference with too little coverage, and one that only looks good inside the hidden interval
    sparse = series[("t0", "v")].copy()
    sparse[40:] = np.nan
    series[("r5", "v")] = sparse
    p = panel(spark, series)
    roles = spark.createDataFrame([(s, "test" if s == "t0" else "train") for s, _ in series], "site string, role string")
    c = cases(spark, [(0, "t0", ["v"], 20, 27), (1, "t0", ["v"], 100, 130)])
    return p, roles, impute.merged_spans(c, p), series


def naive_r(x, y, a, b):
    m = np.isfinite(x) & np.isfinite(y)
    m[a : b + 1] = False
    return abs(np.corrcoef(x[m], y[m])[0, 1]), int(m.sum())


def test_selection_equals_recomputation(spark, fixture):
    p, roles, spans, series = fixture
    got = table(references.select_references(spans, p, roles, "value", 3, 0.6, 40), "case_id", "rank")
    x = series[("t0", "v")]
    for c, a, b in ((0, 20, 27), (1, 100, 130)):
        want = sorted(((naive_r(x, series[(r, "v")], a, b), r) for r in ("r1", "r2", "r3", "r4")), reverse=True)[:3]
        g = got[got.case_id == c]
        assert g.ref.tolist() == [r for _, r in want]
        np.testing.assert_allclose(g.abs_r, [v[0] for v, _ in want], atol=1e-9)
        assert g.pairs.tolist() == [v[1] for v, _ in want]


def test_ridge_equals_numpy(spark, fixture):
    p, roles, spans, series = fixture
    chosen = references.select_references(spans, p, roles, "value", 3, 0.6, 40)
    got = table(references.case_ridge(spans, chosen, p, "value", 1.0, 40), "case_id", "pos")
    names = table(chosen, "case_id", "rank").groupby("case_id").ref.apply(list)
    y = series[("t0", "v")]
    for c, a, b in ((0, 20, 27), (1, 100, 130)):
        x = np.column_stack([pd.Series(series[(r, "v")]).interpolate(limit_direction="both") for r in names[c]])
        fit = np.isfinite(y)
        fit[a : b + 1] = False
        mx, my = x[fit].mean(0), y[fit].mean()
        beta = np.linalg.solve((x[fit] - mx).T @ (x[fit] - mx) + np.eye(3), (x[fit] - mx).T @ (y[fit] - my))
        np.testing.assert_allclose(got[got.case_id == c].y_hat, my + (x[a : b + 1] - mx) @ beta, atol=1e-9)


def test_too_few_pairs_gives_no_reference(fixture):
    p, roles, spans, _ = fixture
    assert references.select_references(spans, p, roles, "value", 3, 0.6, 500).count() == 0


@pytest.mark.parametrize("sizes", [{}, {"refs": 1, "rows": 1, "block_us": 36 * 3_600_000_000}])
def test_a_tile_hands_on_the_best_alone(spark, fixture, sizes):
    """Cases x references never leave the tiles: the choice reads ``k`` rows a case and tile, whatever the tiles' sizes."""
    p, roles, spans, series = fixture
    every = table(references.reference_correlations(spans, p, roles, "value", 0.6, 40, **sizes), "case_id", "ref")
    assert every.groupby("case_id").ref.apply(list).tolist() == [["r1", "r2", "r3", "r4"]] * 2
    best = table(references.reference_correlations(spans, p, roles, "value", 0.6, 40, k=2), "case_id", "ref")
    assert best.groupby("case_id").size().tolist() == [2, 2]
    got = table(references.select_references(spans, p, roles, "value", 2, 0.6, 40, **sizes), "case_id", "rank")
    x = series[("t0", "v")]
    for c, a, b in ((0, 20, 27), (1, 100, 130)):
        want = sorted(((naive_r(x, series[(r, "v")], a, b), r) for r in ("r1", "r2", "r3", "r4")), reverse=True)[:2]
        g = got[got.case_id == c]
        assert g.ref.tolist() == [r for _, r in want]
        np.testing.assert_allclose(g.abs_r, [v[0] for v, _ in want], atol=1e-9)


def test_names_settle_ties_in_a_tile(spark, fixture):
    p, roles, spans, series = fixture
    copies = panel(spark, series | {(f"c{i}", "v"): series[("r1", "v")] for i in range(4)})
    more = roles.union(spark.createDataFrame([(f"c{i}", "train") for i in range(4)], "site string, role string"))
    for sizes in ({}, {"refs": 2}):
        got = table(references.select_references(spans, copies, more, "value", 2, 0.6, 40, **sizes), "case_id", "rank")
        assert got.ref.tolist() == ["r1", "c3"] * 2


def test_aligned_pairs_are_counted_over_blocks(spark, fixture, monkeypatch):
    p, roles, _, series = fixture
    monkeypatch.setattr(references._tiles, "__defaults__", (1, 1, 36 * 3_600_000_000))
    got = table(references.align_references(p, p, roles, "value", 0.6), "site", "ref").set_index(["site", "ref"])
    assert len(got) == 6 * 4 - 4  # r5 has too few values to be a reference, nobody is its own
    for (site, ref), row in got.iterrows():
        x, y = series[(site, "v")], series[(ref, "v")]
        both = np.isfinite(x) & np.isfinite(y)
        assert (row.length, row.observed, row.ref_finite, row.n) == (N, np.isfinite(x).sum(), np.isfinite(y).sum(), both.sum())
        np.testing.assert_allclose(row.sxy, (x[both] * y[both]).sum(), atol=1e-9)


@pytest.mark.parametrize("sizes", [{}, {"block_us": 36 * 3_600_000_000}])
def test_windows_of_references_are_filled_over_the_whole_series(spark, fixture, monkeypatch, sizes):
    """Blocks of a day and a half, slices of one case: fills reach over blocks, and cases with different sets share what they read."""
    p, roles, spans, series = fixture
    chosen = references.select_references(spans, p, roles, "value", 3, 0.6, 40)
    long = series[("r2", "v")].copy()
    long[30:90] = np.nan  # whole blocks without an observation
    long[150:] = np.nan
    q = p.where("site <> 'r2'").unionByName(panel(spark, {("r2", "v"): long}))
    names = table(chosen, "case_id", "rank").groupby("case_id").ref.apply(list)
    if sizes:
        monkeypatch.setattr(references, "SLICE", 1)
    got = references.reference_windows(spans.selectExpr("*", "start_pos - 15 as _lo", "end_pos + 60 as _hi"), chosen, q, "value", "_lo", "_hi", **sizes).collect()
    for c, a, b in ((0, 5, 87), (1, 85, 159)):
        parts = sorted((r.first, r["values"]) for r in got if r.case_id == c)
        assert (len(parts) > 1) == bool(sizes)
        values = np.concatenate([np.array(v, dtype=float) for _, v in parts], axis=1)
        want = [pd.Series(long if r == "r2" else series[(r, "v")]).interpolate(limit_direction="both")[a : b + 1] for r in names[c]]
        assert parts[0][0] == a
        np.testing.assert_allclose(values, want, atol=1e-12)
    ridge = [table(references.case_ridge(spans, chosen, q, "value", 1.0, 40, **s), "case_id", "pos") for s in ({}, sizes)]
    pd.testing.assert_frame_equal(*ridge, check_exact=False, rtol=1e-9)
    assert len(ridge[0]) == 8 + 31


def test_ridge_never_widens_sets_by_positions(spark, fixture):
    """What is dealt to the ridge grows with targets x references, not with sets of references: 40 cases of one set deal what one case does."""
    p, roles, _, _ = fixture
    rows = []
    for n in (1, 40):
        spans = impute.merged_spans(cases(spark, [(i, "t0", ["v"], 20 + i, 27 + i) for i in range(n)]), p)
        chosen = spark.createDataFrame([(i, "t0", "v", r, k) for i in range(n) for k, r in enumerate(("r1", "r2", "r3")[i % 3 :] + ("r1", "r2", "r3")[: i % 3], 1)], "case_id long, site string, variable string, ref string, rank long")
        plan = references.case_ridge(spans, chosen, p, "value", 1.0, 40)
        assert plan.count() == 8 * n
        rows.append(references.reference_windows(spans, chosen, p, "value", "start_pos", "end_pos").count())
    assert rows == [1, 40]
