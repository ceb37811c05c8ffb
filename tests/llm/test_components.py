import numpy as np

from gapweave.llm.components import connected


def test_chain_star_and_loops(spark):
    rng = np.random.default_rng(2)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, x) for x in rng.permutation(np.arange(501, 900)).tolist()]
    got = {r.node: r.component for r in connected(spark.createDataFrame([*chain, *star, (7, 7), (9, 8), (8, 9), (9, 8)], "u long, v long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(500, 900)} == {500}
    assert got[9] == got[8] == 8 and 7 not in got


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
