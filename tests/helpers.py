"""Small frames for tests."""

import math

import numpy as np
import pandas as pd

PANEL = "site string, variable string, pos long, ts timestamp_ntz, value double"
CASES = "case_id long, site string, scenario string, masked_vars array<string>, gap_len long, repeat long, start_pos long, end_pos long"
T0 = pd.Timestamp("2024-01-01")


def panel(spark, series):
    """series: {(site, variable): list of values, None = missing} -> panel frame."""
    rows = []
    for (site, var), vals in series.items():
        for i, v in enumerate(vals):
            missing = v is None or (isinstance(v, float) and math.isnan(v))
            rows.append((site, var, i, (T0 + pd.Timedelta(hours=i)).to_pydatetime(), None if missing else float(v)))
    return spark.createDataFrame(rows, PANEL)


def cases(spark, rows):
    """rows: (case_id, site, vars, start, end)."""
    return spark.createDataFrame([(c, s, "A", list(v), e - b + 1, 0, b, e) for c, s, v, b, e in rows], CASES)


def gappy(n, seed, rate=0.3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(50, 10, n), 3)
    x[rng.random(n) < rate] = np.nan
    return x


def table(df, *keys):
    return df.toPandas().sort_values(list(keys)).reset_index(drop=True)
