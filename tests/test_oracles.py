"""Registered queries against their SQL on DuckDB.

By default a handful at sf0.001; GAPWEAVE_ORACLE=all runs every query, GAPWEAVE_SF picks the scale.
"""

import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry_point

SF = Path("/root/testdata") / f"sf{os.environ.get('GAPWEAVE_SF', '0.001')}"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["A2_parse_compact_ts", "A9_read_site_metadata", "B1_select_targets", "C1_regularize", "C3_detect_freq", "D1_find_gaps", "D6_constant_runs",
         "F1_feasible_starts", "F2_select_nonoverlapping", "G1_impute_linear", "G3_impute_seasonal", "H27_pareto"]
QUERIES, ORACLES = entry_point.queries(), entry_point.oracle_sql()
NAMES = list(ORACLES) if os.environ.get("GAPWEAVE_ORACLE") == "all" else QUICK


def normal(df):
    def one(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and np.isnan(x)):
            return "NULL"
        if isinstance(x, (float, np.floating)):
            return repr(float(x))
        if isinstance(x, (bool, np.bool_)):
            return str(bool(x))
        return str(pd.Timestamp(x)) if isinstance(x, (pd.Timestamp, np.datetime64)) else str(x)

    df = df[sorted(df.columns)].astype(object).map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, duck, name):
    mine, want = QUERIES[name](spark, str(SF)).toPandas(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(mine.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(normal(mine), normal(want))


def test_every_oracle_has_a_query_and_every_operator_a_key():
    assert set(ORACLES) <= set(QUERIES)
    counts = dict(A=10, B=10, C=7, D=14, E=4, F=17, G=20, H=41, I=10, J=9)
    have = {k.split("_")[0] for k in QUERIES}
    assert {f"{g}{i}" for g, n in counts.items() for i in range(1, n + 1)} <= have
