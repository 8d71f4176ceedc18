"""Closed-form statistics, linear models against numpy, leakage and coverage."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronaxis.functions import scalar as S
from chronaxis.functions import signal as Sg
from chronaxis.operators import metrics as M
from chronaxis.operators import priors as P
from chronaxis.operators import reliability as Rl
from chronaxis.operators import resample as Rs
from chronaxis.operators import ridge as R
from chronaxis.plans.regression_queries import fit, fold_models
from chronaxis.plans.scalar_queries import holm


def matrix(spark, x):
    rows = [(s, v, float(x[s, v])) for s in range(x.shape[0]) for v in range(x.shape[1])]
    return spark.createDataFrame(rows, "subject long, item long, x double")


def test_additive_matrix_is_recovered(spark):
    x = np.array([-1.5, -0.5, 0.5, 1.5])[:, None] + np.array([-2.0, 0, 2])[None, :] + 5
    c = Rl.variance_components(matrix(spark, x)).first()
    assert c.ms_residual == pytest.approx(0, abs=1e-9)
    g = Rl.curve(Rl.variance_components(matrix(spark, x)), 4).orderBy("k").toPandas()
    assert np.allclose(g.relative_g, 1) and (np.diff(g.absolute_phi) > 0).all()


def test_components_match_definition(spark):
    x = np.random.default_rng(0).normal(size=(7, 5))
    c = Rl.variance_components(matrix(spark, x)).first()
    g, p, v = x.mean(), x.mean(1), x.mean(0)
    assert c.ms_subject == pytest.approx(5 * ((p - g) ** 2).sum() / 6)
    assert c.ms_residual == pytest.approx(((x - p[:, None] - v[None] + g) ** 2).sum() / 24)


def test_multiplicities_equal_stacked_copies(spark):
    x = np.random.default_rng(1).normal(size=(5, 4))
    wp, wv = np.array([2, 0, 1, 1, 1]), np.array([1, 2, 0, 1])
    m = matrix(spark, x).withColumn("wp", F.element_at(F.array(*map(F.lit, wp.tolist())), (F.col("subject") + 1).cast("int"))).withColumn(
        "wv", F.element_at(F.array(*map(F.lit, wv.tolist())), (F.col("item") + 1).cast("int"))).filter("wp > 0 and wv > 0")
    a = Rl.variance_components(m, wp="wp", wv="wv").first()
    b = Rl.variance_components(matrix(spark, x[np.repeat(np.arange(5), wp)][:, np.repeat(np.arange(4), wv)])).first()
    for f in ("ms_subject", "ms_item", "ms_residual", "P", "V"):
        assert a[f] == pytest.approx(b[f])


def test_holm_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.03, 0.001, 0.2, 0.04])], "g string, i int, p double")
    got = holm(df, ["g"], "p", ["i"], 0.01).orderBy("p").toPandas()
    assert np.allclose(got.adjusted, [0.004, 0.09, 0.09, 0.2])


def test_bootstrap_draws_every_slot(spark):
    ids = spark.range(24).select(F.col("id").alias("idx"))
    m = Rs.multiplicities(ids, "idx", F.lit(24), "s", 30, "m").groupBy("draw").agg(F.sum("m").alias("n")).toPandas()
    assert (m.n == 24).all() and len(m) == 30


def test_draws_of_one_small_file_are_counted_in_many_tasks(spark):
    """No partial count holds every (draw, unit) in the one task that reads the units."""
    ids = spark.range(0, 500, 1, 1).select(F.col("id").alias("idx"))
    m = Rs.multiplicities(ids, "idx", F.lit(500), "s", 40, "m")
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.index("HashAggregate") < plan.index("REPARTITION_BY_NUM")
    assert plan.count("Exchange hashpartitioning") == 1
    assert m.agg(F.sum("m")).first()[0] == 500 * 40


def test_rating_scale_and_domain(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "r double")
    assert [r[0] for r in df.select(S.rating_to_label(F.col("r"))).collect()] == [1.0, 128.0, 255.0]
    with pytest.raises(Exception):
        spark.createDataFrame([(0.5,)], "r double").select(S.rating_to_label(F.col("r"))).collect()


def test_zero_gate_is_the_prior(spark):
    df = spark.createDataFrame([(30.0, 99.0)], "p double, r double")
    assert df.select(S.gated_stack(F.col("p"), [(0.0, F.col("r"))], 0.0)).first()[0] == 30.0


def test_auroc_and_average_precision(spark):
    rng = np.random.default_rng(2)
    y, x = rng.random(80) < 0.4, rng.integers(0, 12, 80).astype(float)
    df = spark.createDataFrame([(int(i), bool(a), float(b)) for i, (a, b) in enumerate(zip(y, x))], "i int, y boolean, x double")
    r = pd.Series(x).rank().to_numpy()
    want = (r[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert M.auroc(df, "y", "x", 3.0).first().auroc == pytest.approx(want)
    o = np.argsort(-x, kind="mergesort")
    ap = (np.cumsum(y[o]) / np.arange(1, 81))[y[o]].sum() / y.sum()
    assert M.average_precision(df, "y", "x", "i", 3.0).first().average_precision == pytest.approx(ap)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1, 20, 0.1] + [0, 5, 1]
    x[0, 0] = 60.0  # beyond the z clip
    y = x @ [1.0, 0.1, 3.0] + rng.normal(size=200)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, fold=np.arange(200) % 5, k=0)
    return pdf, spark.createDataFrame(pdf).repartition(4)


def numpy_ridge(x, y, alpha, clip=8.0):
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-6)
    z = np.clip(z, -clip, clip) if clip else z
    return np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))


def test_ridge_path_equals_normal_equations(table):
    pdf, df = table
    path = fit(df, "k", ["a", "b", "c"], "y", (0.1, 1.0, 50.0))[0].toPandas()
    for a in (0.1, 1.0, 50.0):
        got = path[path.alpha == a].sort_values("i").beta
        assert np.allclose(got, numpy_ridge(pdf[["a", "b", "c"]].to_numpy(), pdf.y.to_numpy(), a), atol=1e-8)


def test_fold_models_use_only_other_folds(table):
    pdf, df = table
    got = fold_models(df, "fold", ["a", "b", "c"], "y", (2.0,)).toPandas()
    for f in range(5):
        t = pdf[pdf.fold != f]
        x, y = t[["a", "b", "c"]].to_numpy(), t.y.to_numpy()
        beta = numpy_ridge(x, y, 2.0, None) / x.std(0)
        own = got[got.fold == f].sort_values("i").beta.to_numpy()
        assert np.allclose(own[1:], beta) and own[0] == pytest.approx(y.mean() - x.mean(0) @ beta)


def test_uniform_weights_change_nothing(table):
    _pdf, df = table
    a = fit(df, "k", ["a", "b", "c"], "y", (5.0,))[0].orderBy("i").toPandas().beta
    b = fit(df.withColumn("w", F.lit(1.0)), "k", ["a", "b", "c"], "y", (5.0,), "w")[0].orderBy("i").toPandas().beta
    assert np.allclose(a, b)


def test_inflation_factors(table):
    pdf, df = table
    x = pdf[["a", "b", "c"]].to_numpy()
    z = R.standardized(df, R.moments(df, ["k"], ["a", "b", "c"]), ["k"], ["a", "b", "c"], None)
    got = R.inflation(R.gram(z, "k", "z", F.col("y")), "k").orderBy("i").toPandas().vif
    assert np.allclose(got, np.diag(np.linalg.inv(np.corrcoef(x.T))))


def test_band_power_matches_fft(spark):
    x = np.random.default_rng(4).normal(size=16)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    feats = Sg.band_features(F.col("x"), 16, 64.0)
    row = df.select(*[c for _n, s, e in feats for c in (s, e)]).first()
    c = x - x.mean()
    win, raw, freq = np.abs(np.fft.rfft(c * np.hanning(16))) ** 2, np.fft.rfft(c), np.fft.rfftfreq(16, 1 / 64)
    all_power = win[(freq >= 1) & (freq < 45)].sum() + Sg.EPS
    for k, (_name, lo, hi) in enumerate(Sg.BANDS):
        mask = (freq >= lo) & (freq < hi)
        part = np.zeros_like(raw)
        part[mask] = raw[mask]
        var = np.var(np.fft.irfft(part, n=16)) if mask.any() else Sg.EPS
        assert row[2 * k] == pytest.approx(np.log(max(win[mask].sum() / all_power, Sg.EPS)))
        assert row[2 * k + 1] == pytest.approx(0.5 * np.log(2 * np.pi * np.e * max(var, Sg.EPS)))


def test_held_out_labels_do_not_move_their_prediction(spark):
    rng = np.random.default_rng(6)
    rows = [(s, "a", t, 0, float(rng.integers(1, 255))) for s in range(10) for t in range(6)]
    long = spark.createDataFrame(rows, "subject long, video string, t long, axis int, value double")
    folds = spark.createDataFrame([(s, s % 5) for s in range(10)], "subject long, fold long")
    a = P.population_oof(long, folds).filter("fold = 2").select("subject", "t", "prior")
    moved = long.withColumn("value", F.when(F.col("subject") % 5 == 2, 255 - F.col("value")).otherwise(F.col("value")))
    b = P.population_oof(moved, folds).filter("fold = 2").select("subject", "t", "prior")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.count() == 12
