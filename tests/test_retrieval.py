"""Neighbours' seconds in blocks: cut trials give what whole ones give."""

import pytest

from chronaxis.operators import distributed as D
from chronaxis.plans import prior_queries as Q


def test_blocks_hold_their_halo(spark):
    rows = spark.range(19).selectExpr("IF(id < 9, 1, 2) AS k", "IF(id < 9, id, id - 9) AS t", "CAST(id AS DOUBLE) AS x")
    got = {(r["k"], r["c"]): r["x"] for r in D.blocks(rows, ["k"], "t", ["x"], 2, 4).collect()}
    assert got == {(1, 0): [0, 1, 2, 3, 4, 5], (1, 1): [2, 3, 4, 5, 6, 7, 8], (1, 2): [6, 7, 8],
                   (2, 0): [9, 10, 11, 12, 13, 14], (2, 1): [11, 12, 13, 14, 15, 16, 17, 18], (2, 2): [15, 16, 17, 18]}
    ends = {(r["k"], r["c"]): r["x"] for r in D.blocks(rows.filter("k = 1 AND t < 7"), ["k"], "t", ["x"], 2, 4).collect()}
    assert ends == {(1, 0): [0, 1, 2, 3, 4, 5], (1, 1): [2, 3, 4, 5, 6], (1, 2): [6]}


def test_cut_trials_retrieve_what_whole_ones_do(spark, sf, monkeypatch):
    names = ["mode", "fold", "subject", "video", *[f"e{i}" for i in range(len(Q.SPECS))]]
    errors = lambda: sorted(map(tuple, Q.retrieval_errors(spark, sf).select(names).collect()))
    whole = errors()
    monkeypatch.setattr(Q, "SECONDS", 4)
    cut = errors()
    assert [r[:4] for r in cut] == [r[:4] for r in whole]
    for a, b in zip(cut, whole):
        mine = [i for i, s in enumerate(Q.SPECS) if s[0] == a[0]]
        assert [a[4 + i] for i in mine] == pytest.approx([b[4 + i] for i in mine])


def test_seconds_meet_as_arrays(spark, sf):
    """No join lists a neighbour's seconds row by row."""
    plan = Q.retrieval_errors(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan
