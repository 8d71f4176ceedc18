"""Contour components against a dense eigensolver."""

import random

import numpy as np
import pytest

from chronaxis.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int"


def plain(vectors, k=8):
    """n, x, exact deviations, eigenvalues, vectors of the x-covariance."""
    x = np.floor(1024 * np.array(vectors, float)) + 100_000
    n, total = len(x), [sum(int(v) for v in c) for c in x.T]
    deviation = [sum((n * int(v) - s) ** 2 for v, s in zip(r, total)) for r in x]
    centred = x - np.array([s / n for s in total])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return n, centred, deviation, values[::-1][:k], axes[:, ::-1][:, :k], values.sum()


def compare(got, ids, vectors, k=8):
    n, centred, deviation, values, axes, trace = plain(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == len(ids) * len(values)
    assert all(r["n"] == n and r["identity_error"] <= 1e-4 for r in got)
    for j in range(len(values)):
        mine = np.array([by[i, j + 1]["whitened"] for i in ids])
        theirs = centred @ axes[:, j] / np.sqrt(values[j])
        assert np.allclose(mine * np.sign(mine @ theirs), theirs, atol=1e-7)
        assert np.allclose([by[i, j + 1]["explained"] for i in ids], values[j] / trace, rtol=1e-9)
    assert [by[i, 1]["deviation"] for i in ids] == deviation


def float32(rows):
    return [[float(np.float32(v)) for v in r] for r in rows]


def test_components_equal_dense_solver(spark):
    rng = np.random.default_rng(3)
    vectors = float32(rng.standard_normal((300, 20)) @ rng.standard_normal((20, 20)))
    vectors += vectors[:40]  # repeated rows
    rows = [(i, v, 1, 2) for i, v in enumerate(vectors)]
    bad = [(None, None, 1, 2), (900, [1.0, None], 1, 2), (901, [float("nan")] * 20, 1, 2), (902, [float("inf")] * 20, 1, 2)]
    got = whitening.whitened(spark.createDataFrame(rows + bad, SCHEMA).repartition(7)).collect()
    compare(got, [r[0] for r in rows], vectors)


def test_few_dimensions_short_vectors_and_null_ids(spark):
    vectors = [[1.0, 2.0, 0.5], [0.0, 1.0], [-3.0], [2.0, 0.25, 1.0], []]
    rows = [(None if i == 4 else i, v, 1, 2) for i, v in enumerate(vectors)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r["vec_id"] is None for r in got) == 3
    got = [{**r.asDict(), "vec_id": 4 if r["vec_id"] is None else r["vec_id"]} for r in got]
    compare(got, range(5), [v + [0.0] * (3 - len(v)) for v in vectors])


def test_no_variance_no_rows(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    for rows in ([], [(1, [1.0, 2.0], 1, 2)], [(i, [3.0, 4.0], 1, 2) for i in range(9)], [(1, [], 1, 2), (2, [], 1, 2)]):
        assert whitening.whitened(frame(rows)).collect() == []


def test_flat_dimensions_have_no_component(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random(), 7.0, -rng.random(), 7.0], 1, 2) for i in range(50)]
    assert {r["component"] for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()} == {1, 2}


def test_large_values_do_not_wrap(spark):
    rows = [(i, [1e30 * (i % 2), float(i)], 1, 2) for i in range(6)] + [(9, [3e38, 1.0], 1, 2)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and all(r["deviation"] is None and r["identity_error"] < 1e-4 for r in got)
    exact = [(i, [1.5e4 * i, 0.0], 1, 2) for i in range(20)]
    got = whitening.whitened(spark.createDataFrame(exact, SCHEMA)).collect()
    compare(got, range(20), [r[1] for r in exact], 1)


@pytest.mark.parametrize("values", [[9, 9, 9, 4, 4, 1, 1, 1, 1, 1, 0, 0], [1e6, 1, 1 - 1e-9, 1e-3, 0], [5.0] * 15])
def test_inertia_and_contours(values):
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((len(values),) * 2))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    for s in (-1.0, 0.5, 2.0, 5.5, 100.0):
        assert whitening.above(v, s) == sum(x > s for x in values)
    found = [whitening.contour(v, *piece) for piece in whitening.intervals(v, 8)]
    got = sorted((x for f in found for x in f[0]), reverse=True)
    want = sorted((x for x in values if x > 0), reverse=True)
    assert len(got) >= min(8, len(want)) and np.allclose(got, want[:len(got)], rtol=1e-9, atol=1e-9)


def test_pairs_of_pivots():
    assert whitening.above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1
    assert whitening.above(np.zeros((3, 3)), 0.0) == 0
