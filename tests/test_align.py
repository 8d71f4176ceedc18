"""Alignment against a plain cell-by-cell programme, and the chunked form against the whole one."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronaxis.operators import align as Al


def plain(p, m, band, warp, step):
    """Textbook banded programme, diagonal first on ties."""
    n = len(p)
    cost = {}
    for i in range(n):
        for j in range(max(0, i - band), min(n, i + band + 1)):
            here = abs(p[i] - m[j]) + warp * abs(i - j) / max(band, 1)
            if (i, j) == (0, 0):
                cost[i, j] = (here, None)
                continue
            options = [(cost.get((i - 1, j - 1), (np.inf,))[0], 0, (i - 1, j - 1)), (cost.get((i - 1, j), (np.inf,))[0] + step, 1, (i - 1, j)),
                       (cost.get((i, j - 1), (np.inf,))[0] + step, 2, (i, j - 1))]
            best = min(options, key=lambda o: (o[0], o[1]))
            cost[i, j] = (here + best[0], best[2])
    at, seen = (n - 1, n - 1), {}
    while at is not None:
        seen.setdefault(at[0], []).append(at[1])
        at = cost[at][1]
    w = [int(np.floor(np.median(seen[i]) + 0.5)) for i in range(n)]
    return np.maximum.accumulate(w)


@pytest.mark.parametrize("band", [2, 5, 10])
def test_block_matches_plain_programme(band):
    rng = np.random.default_rng(band)
    p, m = rng.normal(size=(12, 30, 1)), rng.normal(size=(12, 30, 1))
    m[:6] = np.roll(p[:6], 2, axis=1)
    p[3], m[3] = 0.0, 0.0
    got = Al.align_block(p, m, Al.WarpSettings(band=band))[0]
    for k in range(12):
        assert got[k].tolist() == plain(p[k, :, 0], m[k, :, 0], band, 0.15, 0.05).tolist()
        assert (np.diff(got[k]) >= 0).all() and (np.abs(got[k] - np.arange(30)) <= band).all()


def test_path_mean_is_not_above_the_direct_ratio():
    rng = np.random.default_rng(0)
    p, m = rng.normal(size=(20, 25, 1)), rng.normal(size=(20, 25, 1))
    ratio = lambda r: (r[1] + r[2] + 0.05 * r[3]) / r[4]
    a, b = Al.align_block(p, m, Al.WarpSettings()), Al.align_block(p, m, Al.WarpSettings(objective="path_mean"))
    assert (ratio(b) <= ratio(a) + 1e-9).all()


def test_mixed_objective_against_every_path():
    rng = np.random.default_rng(7)
    n, s = 6, Al.WarpSettings(band=3, objective="mixed_step_mean", step_penalty=0.4)
    p, m = rng.normal(size=(10, n, 1)), rng.normal(size=(10, n, 1))

    def paths(i, j):
        if (i, j) == (0, 0):
            yield [(0, 0)]
            return
        for a, b in ((i - 1, j - 1), (i - 1, j), (i, j - 1)):
            if a >= 0 and b >= 0 and abs(a - b) <= 3:
                for q in paths(a, b):
                    yield q + [(i, j)]

    every = list(paths(n - 1, n - 1))
    got = Al.align_block(p, m, s)
    for k in range(10):
        def total(q):
            sideways = 2 * len(q) - 2 * n
            return sum(abs(p[k, i, 0] - m[k, j, 0]) + 0.15 * abs(i - j) / 3 for i, j in q) + 0.4 * sideways / len(q)
        best = min(map(total, every))
        assert got[1][k] + got[2][k] + 0.4 * got[3][k] / got[4][k] == pytest.approx(best)


def curve_frame(spark, shift=4, n=100):
    x = np.linspace(0, 4 * np.pi, n)
    base = np.stack([np.sin(x), np.cos(0.7 * x)], axis=1)
    late = base[np.maximum(np.arange(n) - shift, 0)]
    rows = [(1, a, t, float(late[t, a]), float(base[t, a])) for t in range(n) for a in range(2)]
    return spark.createDataFrame(rows, "k long, axis int, t long, value double, prior double")


def test_delayed_curve_is_recovered(spark):
    s = Al.WarpSettings(band=8, warp_penalty=0.05, step_penalty=0.02, radius=1)
    df = curve_frame(spark)
    w = Al.align(df, ["k", "axis"], s).toPandas()
    assert np.median(w.t - w.w) > 1.5
    raw = df.toPandas().merge(w, on=["k", "axis", "t"]).merge(df.toPandas()[["k", "axis", "t", "prior"]].rename(columns={"t": "w", "prior": "moved"}), on=["k", "axis", "w"])
    assert (raw.value - raw.moved).abs().mean() < (raw.value - raw.prior).abs().mean()


def test_chunked_trials_equal_whole_ones(spark):
    rng = np.random.default_rng(9)
    rows = [(k, t, [float(a)], [float(b)]) for k, n in ((1, 90), (2, 41), (3, 7)) for t, (a, b) in enumerate(zip(rng.normal(size=n).cumsum(), rng.normal(size=n).cumsum()))]
    sig = spark.createDataFrame(rows, "k long, t long, p array<double>, m array<double>")
    for s in (Al.WarpSettings(band=4), Al.WarpSettings(band=4, objective="step_zero"), Al.WarpSettings(band=4, objective="path_mean"),
              Al.WarpSettings(band=4, objective="mixed_step_mean", step_penalty=8.0)):
        whole, cut = Al.solve(sig, ["k"], s), Al.solve(sig, ["k"], s, long=16)
        a = Al.seconds(whole, ["k"]).toPandas().sort_values(["k", "t"])
        b = Al.seconds(cut, ["k"]).toPandas().sort_values(["k", "t"])
        assert a.w.tolist() == b.w.tolist()
        ca, cb = Al.costs(whole, ["k"]).toPandas().sort_values("k"), Al.costs(cut, ["k"]).toPandas().sort_values("k")
        assert np.allclose(ca.drop(columns="k"), cb.drop(columns="k"))


def test_aligned_trials_are_written_once(spark):
    """Nothing that reads a mapping solves its trials again."""
    rows = spark.range(40).selectExpr("id % 2 AS k", "id div 2 AS t", "CAST(id * id % 17 AS DOUBLE) AS value", "CAST(id % 13 AS DOUBLE) AS prior")
    got = Al.align(rows, ["k"], Al.WarpSettings())
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 40
