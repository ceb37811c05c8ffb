import math
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gapweave.llm import mixing


def seats(weights, caps, total):
    """Highest quotients one by one."""
    won = [0] * len(weights)
    for _ in range(total):
        open_ = [(w / (2 * s + 1), -i) for i, (w, s, c) in enumerate(zip(weights, won, caps)) if s < c and w > 0]
        if not open_:
            break
        won[-max(open_)[1]] += 1
    return won


@pytest.mark.parametrize("weights,caps,total", [([5, 3, 1], [99] * 3, 9), ([1.0] * 7, [9] * 7, 10), ([1000.0, *[0.49] * 40], [5000] * 41, 1030), ([4, 2], [1, 9], 6), ([3, 0, 2], [9, 9, 9], 0)])
def test_highest_quotients(spark, weights, caps, total):
    df = spark.createDataFrame([(0, i, float(w), c, total) for i, (w, c) in enumerate(zip(weights, caps))], "g int, i int, w double, c long, t long")
    got = {r.i: r.won for r in mixing.highest_quotients(df, ["g"], ["i"], "w", "c", "t").collect()}
    assert [got[i] for i in range(len(weights))] == seats(weights, caps, total)


def test_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 5000, None: 100}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1)).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    full, left = set(), sum(sizes.values())
    while True:  # round by round
        share = {k: left * weight[k] / sum(weight[j] for j in sizes if j not in full) for k in sizes if k not in full}
        over = {k for k, t in share.items() if t > 3 * sizes[k]}
        if not over:
            break
        full |= over
        left = sum(sizes.values()) - sum(3 * sizes[k] for k in full)
    for k in sizes:
        assert math.isclose(got[k], 3 * sizes[k] if k in full else share[k], rel_tol=1e-12)


@pytest.mark.parametrize("block", [1, 4])
def test_mix_keeps_rows_and_limits(rows, block):
    got = mixing.mix(rows, block_tokens=block).collect()
    assert len(got) == rows.count()
    assert all(0 <= r.taken <= 3 * r["size"] and 0 <= r.copies <= 3 for r in got)
    per = defaultdict(lambda: [0, 0.0])
    for r in got:
        per[r.source] = [per[r.source][0] + r.taken, r.target]
    assert all(abs(t - want) <= (1 if block == 1 else 3 * block) for t, want in per.values())
    again = mixing.mix(rows.repartition(3), block_tokens=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_empty_table_and_whole_documents(rows):
    assert mixing.mix(rows.where("false")).count() == 0
    mixed = mixing.mix(rows)
    assert mixing.whole_documents(mixed).count() == mixed.agg(F.sum("copies")).first()[0]


def test_sql_agrees_on_odd_rows(rows, tmp_path, spark):
    rows.drop("size").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT doc_id, text, source FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(mixing.OP1_SQL).fetchall()
    got = [tuple(r) for r in mixing.op1_mix_sources(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
