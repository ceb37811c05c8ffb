import numpy as np
import pandas as pd
import pytest

from gapweave.operators import impute
from helpers import cases, gappy, panel, table


def filled(df):
    return [None if pd.isna(v) else float(v) for v in table(df, "pos").filled]


def test_limited_fill_touches_only_run_ends(spark):
    x = [1.0] + [None] * 8 + [10.0]
    assert filled(impute.impute_linear_limited(panel(spark, {("s", "v"): x}), 3))[1:-1] == pytest.approx([2, 3, 4, None, None, 7, 8, 9])
    assert filled(impute.impute_linear_limited(panel(spark, {("s", "v"): [None] * 4 + [1.0]}), 3)) == [None, 1, 1, 1, 1]
    assert filled(impute.impute_linear_limited(panel(spark, {("s", "v"): [10.0] + [None] * 5}), 3)) == [10, 10, 10, 10, None, None]


def test_leading_run_takes_the_first_observation(spark):
    assert filled(impute.impute_linear(panel(spark, {("s", "v"): [None] * 4 + [8.0, 9.0]})))[:4] == [8, 8, 8, 8]


def brute_seasonal(x, season, ctx):
    n, out, i = len(x), x.copy(), 0
    while i < n:
        if not np.isnan(x[i]):
            i += 1
            continue
        j = i
        while j + 1 < n and np.isnan(x[j + 1]):
            j += 1
        for t in range(i, j + 1):
            past = [c for c in range(t - season, max(0, i - ctx) - 1, -season) if not np.isnan(x[c])]
            later = [c for c in range(t + season, min(n, j + 1 + ctx), season) if not np.isnan(x[c])]
            out[t] = x[past[0]] if past else x[later[0]] if later else np.nan
        i = j + 1
    return pd.Series(out).interpolate(limit_direction="both").to_numpy()


@pytest.mark.parametrize("seed,rate", [(1, 0.3), (2, 0.7)])
def test_seasonal_fill_equals_brute_force(spark, seed, rate):
    x = gappy(70, seed, rate)
    d = table(impute.impute_seasonal(panel(spark, {("s", "v"): x}), 6, 14, size=9), "pos")
    np.testing.assert_allclose(d.filled, brute_seasonal(x, 6, 14))


def test_case_fills_equal_filling_a_masked_copy(spark):
    """Lookups outside the interval give what a full refill of the masked series gives."""
    x = gappy(90, 5, 0.35)
    spans = [(0, 20, 27), (1, 3, 5), (2, 84, 89), (3, 40, 44)]
    p = panel(spark, {("s", "v"): x})
    sp = impute.merged_spans(cases(spark, [(c, "s", ["v"], a, b) for c, a, b in spans]), p, size=8)
    lin = table(impute.case_linear(sp), "case_id", "pos")
    sea = table(impute.case_seasonal(sp, p, 6, 14, size=8), "case_id", "pos")
    for c, a, b in spans:
        masked = x.copy()
        masked[a : b + 1] = np.nan
        np.testing.assert_allclose(lin[lin.case_id == c].y_hat, pd.Series(masked).interpolate(limit_direction="both")[a : b + 1])
        np.testing.assert_allclose(sea[sea.case_id == c].y_hat, brute_seasonal(masked, 6, 14)[a : b + 1])


def test_merged_run_extends_over_natural_gaps(spark):
    x = [1.0, None, None, 2.0, 3.0, None, 4.0]
    r = impute.merged_span_report(impute.merged_spans(cases(spark, [(0, "s", ["v"], 3, 4)]), panel(spark, {("s", "v"): x}))).first()
    assert (r.run_start, r.run_end, r.run_len, r.extended, r.leading) == (1, 5, 5, True, False)
