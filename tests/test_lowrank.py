"""Leading item directions against a dense decomposition, with missing cells."""

import numpy as np
import pytest
from chronaxis.operators import lowrank as Lr


@pytest.mark.parametrize("items,subjects,rank", [(4, 12, 1), (30, 60, 3)])
def test_directions_equal_dense_ones(spark, items, subjects, rank):
    rng = np.random.default_rng(items)
    table = rng.normal(size=(subjects, 3)) @ (rng.normal(size=(3, items)) * [[4], [2], [1]]) + 0.3 * rng.normal(size=(subjects, items))
    table[rng.random(table.shape) < 0.3] = 0.0  # missing cells
    fold = np.arange(subjects) % 3
    cells = [(s, i, int(fold[s]), float(table[s, i])) for s in range(subjects) for i in range(items) if table[s, i]]
    got = Lr.loadings(spark.createDataFrame(cells, "subject long, item int, fold long, d double"), 3, rank).collect()
    assert len(got) == 3 * items
    for f in range(3):
        mine = np.zeros((items, rank))
        for r in got:
            if r["fold"] == f:
                mine[r["item"]] = r["load"]
        rest = table[fold != f]
        want = np.linalg.svd(rest)[2][:rank].T
        want = want * np.sign(want[np.abs(want).argmax(axis=0), np.arange(rank)])
        assert np.allclose(mine, want, atol=1e-5)


def test_fewer_items_than_directions(spark):
    rows = [(s, i, s % 2, float((s + 1) * (i + 1))) for s in range(4) for i in range(2)]
    got = Lr.loadings(spark.createDataFrame(rows, "subject long, item int, fold long, d double"), 2, 3).collect()
    for r in got:
        assert r["load"][0] == pytest.approx([1, 2][r["item"]] / 5**0.5)
        assert len(r["load"]) == 3
