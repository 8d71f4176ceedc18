"""Ridge, residual, geometry and low-rank models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distributed as D
from ..operators import folds as Fo
from ..operators import priors as P
from ..operators import resample as Rs
from ..operators import lowrank as Lr
from ..operators import ridge as R
from ..operators import windows as Wn
from ..sources import adapters as A
from ..sources.shared import written
from ..sources.tables import read
from .base_queries import oof
from .prior_queries import K3
from .registry import TRACE, q6, query, r6, with_
from .study_queries import lookup

X = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "month"]
ALPHAS = (0.1, 1.0, 10.0, 100.0)


def lines(spark, sf):
    return read(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", *[F.col(c).cast("double").alias(c) for c in X[:4]],
                                              F.month("l_shipdate").cast("double").alias("month"), (F.col("l_extendedprice") / 10000).alias("y"))


def centred(df, columns, target, weight=None, clip=8.0):
    """One model over all rows: adds ``z`` (standardized features) and ``y_mean``; the statistics are one row of scalars, so nothing is joined."""
    stats = R.moments(df, [], [*columns, target], weight)
    z = R.standardized(df, stats, [], columns, clip)
    return z.withColumnRenamed(f"m_{target}", "y_mean").drop(f"s_{target}")


def fit(df, key, columns, target, alphas, weight=None, clip=8.0):
    """Standardized ridge path over all rows (key, alpha, i, beta; the key is 0), and the rows with z and y_mean."""
    w = F.col(weight).cast("double") if weight else None
    z = centred(df, columns, target, weight, clip).withColumn(key, F.lit(0).cast("long"))
    return R.ridge_path(R.gram(z, key, "z", F.col(target) - F.col("y_mean"), w), key, alphas), z


@query("rg1_standardized_ridge")
def _(spark, sf):
    path, _z = fit(lines(spark, sf), "k", X, "y", (10.0,))
    return path.select("i", r6("beta"))


@query("rg2_ridge_path")
def _(spark, sf):
    path, _z = fit(lines(spark, sf), "k", X, "y", ALPHAS)
    return path.select("alpha", "i", r6("beta"))


@query("rg3_weighted_ridge_path")
def _(spark, sf):
    l = lines(spark, sf)
    n = l.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    tot = l.agg(F.count(F.lit(1)).alias("t"))
    s = n.agg(F.count(F.lit(1)).alias("s"))
    # supplier-macro weights, rescaled to mean 1
    w = l.join(n, "l_suppkey").withColumn("w", tot.scalar() / (s.scalar() * F.col("n")))
    path, _z = fit(w, "k", X, "y", ALPHAS, "w")
    return path.select("alpha", "i", r6("beta"))


def fold_models(df, fold, columns, target, alphas):
    """No-clip ridge per held-out fold from one raw Gram per fold.

    The raw Gram holds every sum a fold needs; the training side of a fold is
    the total minus the fold's own matrix, so rows are read once, not n-1 times.
    """
    v = df.withColumn("_v", F.array(F.lit(1.0), *[F.col(c).cast("double") for c in columns]))
    own = R.gram(v, fold, "_v", F.col(target))
    total = own.groupBy("i", "j").agg(F.sum("v").alias("t"))
    train = own.join(total, ["i", "j"]).select(fold, "i", "j", (F.col("t") - F.col("v")).alias("v"))
    return standardize_gram(train, fold, alphas)


def standardize_gram(train, fold, alphas):
    """Raw-scale coefficients (intercept first) of the standardized ridge, from raw sums."""
    import numpy as np
    import pandas as pd
    alphas = [float(a) for a in alphas]

    def solve(pdf):
        d = int(pdf["i"].max()) + 1
        g = np.zeros((d, d))
        g[pdf["i"], pdf["j"]] = pdf["v"]
        n = g[0, 0]
        mu = g[0, 1:-1] / n
        ym = g[0, -1] / n
        cov = g[1:-1, 1:-1] - n * np.outer(mu, mu)
        s = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0) / n), 1e-6)
        c = (g[1:-1, -1] - n * mu * ym) / s
        z = cov / np.outer(s, s)
        out = []
        for a in alphas:
            b = np.linalg.solve(z + a * np.eye(len(mu)), c) / s
            out.append(pd.DataFrame({fold: pdf[fold].iloc[0], "alpha": a, "i": np.arange(d - 1), "beta": np.concatenate([[ym - b @ mu], b])}))
        return pd.concat(out)

    return train.groupBy(fold).applyInPandas(solve, f"{fold} long, alpha double, i int, beta double")


def score(df, models, fold, columns):
    """All penalties scored in one pass: an array of dot products per row."""
    c = R.coefficients(models, fold).groupBy(fold).agg(F.sort_array(F.collect_list(F.struct("alpha", "beta"))).alias("models"))
    v = F.array(F.lit(1.0), *[F.col(x).cast("double") for x in columns])
    j = df.withColumn("_v", v).join(c, fold)
    return j.withColumn("scores", F.transform("models", lambda m: F.struct(m["alpha"].alias("alpha"), F.aggregate(
        F.zip_with("_v", m["beta"], lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x).alias("pred")))).drop("_v", "models")


@query("rg4_fold_ridge_predictions")
def _(spark, sf):
    l = lines(spark, sf).withColumn("fold", F.col("l_suppkey") % 5)
    s = score(l, fold_models(l, "fold", X, "y", (10.0,)), "fold", X)
    p = S.clip(F.col("scores")[0]["pred"], 0.0, 10.0)
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("rows"), r6(F.avg(F.abs(F.col("y") - p)), "mae"), r6(F.avg("y"), "mean"))


@query("tk7_penalty_selection")
def _(spark, sf):
    l = lines(spark, sf).withColumn("fold", F.col("l_suppkey") % 5)
    s = score(l, fold_models(l, "fold", X, "y", ALPHAS), "fold", X).select("y", F.explode("scores").alias("s"))
    e = s.groupBy("s.alpha").agg(F.round(F.avg(F.abs(F.col("y") - F.col("s.pred"))), 9).alias("mae"))
    return e.agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("alpha"), r6(F.min("mae"), "mae"))


# ---- causal residual on the held-out prior ------------------------------------------

FEAT = ["x1", "x2", "slope", "progress", "other"]


def residual_rows(spark, sf):
    """Residual of the held-out prior with past-only features of the other axis."""
    def build():
        o = oof(spark, sf).select(*K3, "t", "fold", "value", "prior")
        g = D.framed(o, K3, "t", 3, 0, lambda d, w: d.withColumn("p1", Wn.lagged("prior", 1, w)).withColumn("p3", Wn.lagged("prior", 3, w)))
        other = o.select("subject", "video", (1 - F.col("axis")).alias("axis"), "t", F.col("value").alias("ov"))
        # the other axis is read from the past only
        hist = D.framed(other, K3, "t", 2, 0, lambda d, w: d.withColumn("x1", Wn.lagged("ov", 1, w)).withColumn("x2", Wn.lagged("ov", 2, w))).select(*K3, "t", "x1", "x2")
        j = g.join(hist, [*K3, "t"])
        return j.select(*K3, "t", "fold", "value", "prior", "x1", "x2", (F.col("prior") - F.col("p3")).alias("slope"), (F.col("t") / 16.0).alias("progress"),
                        (F.col("prior") - F.col("p1")).alias("other"), (F.col("value") - F.col("prior")).alias("residual"))
    return written(spark, "residual_rows", sf, build)


def raw_residuals(spark, sf):
    """Held-out residual predictions for every penalty, per axis."""
    def build():
        r = residual_rows(spark, sf)
        parts = []
        for axis in (0, 1):
            a = r.filter(F.col("axis") == axis)
            parts.append(score(a, fold_models(a, "fold", FEAT, "residual", (10.0, 1000.0)), "fold", FEAT).select(
                *K3, "t", "fold", "value", "prior", F.explode("scores").alias("s")).select(*K3, "t", "fold", "value", "prior", "s.alpha", F.col("s.pred").alias("raw")))
        return reduce(lambda a, b: a.unionByName(b), parts)
    return written(spark, "raw_residuals", sf, build)


def gate_candidates(spark, sf):
    """Trial errors of every (alpha, ema, gate, cap) setting and of the disabled one."""
    def build():
        r = raw_residuals(spark, sf)
        key = [*K3, "alpha"]
        both = Wn.ema(r, key, "raw", 0.5, "ema")
        combos = [(src, g, c) for src in ("raw", "ema") for g in (0.25, 0.5) for c in (8.0, 24.0)]
        err = lambda x: F.avg(F.abs(F.col("value") - P.clip(F.col("prior") + x)))
        cols = [err(S.clip(g * F.col(src), -c, c)).alias(f"{src}_g{int(100 * g)}_c{int(c)}") for src, g, c in combos]
        t = both.groupBy("fold", *K3, "alpha").agg(err(F.lit(0.0)).alias("disabled"), *cols)
        names = [f"{s}_g{int(100 * g)}_c{int(c)}" for s, g, c in combos]
        u = t.unpivot(["fold", *K3, "alpha"], ["disabled", *names], "setting", "mae")
        named = F.when(F.col("setting") == "disabled", "disabled").otherwise(F.concat(F.lit("a"), F.col("alpha").cast("long").cast("string"), F.lit("_"), F.col("setting")))
        return u.withColumn("name", named).groupBy("fold", *K3, "name").agg(F.max("mae").alias("mae"))
    return written(spark, "gate_candidates", sf, build)


def residual_choice(spark, sf, least):
    c = gate_candidates(spark, sf)
    cells = Fo.to_training(c.groupBy("fold", "axis", "name").agg(F.sum("mae").alias("s"), F.count(F.lit(1)).alias("k")), 5)
    sc = cells.groupBy("vfold", "axis", "name").agg(F.round(F.sum("s") / F.sum("k"), 9).alias("score"))
    g = sc.groupBy("vfold", "axis").agg(F.max(F.when(F.col("name") == "disabled", F.col("score"))).alias("base"), F.min("score").alias("best"),
                                        F.min_by("name", F.struct("score", F.when(F.col("name") == "disabled", 0).otherwise(1), "name")).alias("pick"))
    return g.withColumn("name", F.when((F.col("base") - F.col("best") >= least) & (F.col("pick") != "disabled"), F.col("pick")).otherwise("disabled"))


@query("rg5_residual_on_prior")
def _(spark, sf):
    r = raw_residuals(spark, sf).filter("alpha = 10.0")
    fixed = S.gated_stack(F.col("prior"), [(0.5, F.col("raw"))], 24.0)
    return r.select(*K3, "t", r6("raw"), r6(fixed, "corrected"))


@query("rg6_residual_candidate_search")
def _(spark, sf):
    return residual_choice(spark, sf, 0.1).select(F.col("vfold").alias("fold"), "axis", "name", r6("base"), r6("best"))


@query("tk8_blockwise_residual_choice")
def _(spark, sf):
    return residual_choice(spark, sf, 0.0).groupBy("axis", "name").agg(F.count(F.lit(1)).alias("folds"))


@query("cq5_causal_residual_experiment")
def residual_experiment(spark, sf):
    """Gain of the selected causal residual over the prior for several gain gates."""
    c = gate_candidates(spark, sf)
    base = c.filter("name = 'disabled'").select(*K3, F.col("mae").alias("base"))
    parts = []
    for least in (0.0, 0.05, 0.1, 0.2, 0.5):
        pick = residual_choice(spark, sf, least).select(F.col("vfold").alias("fold"), "axis", "name")
        parts.append(c.join(pick, ["fold", "axis", "name"]).join(base, K3).select(F.lit(least).alias("gate"), "subject", "video", "mae", "base"))
    t = reduce(lambda a, b: a.unionByName(b), parts).groupBy("gate", "subject", "video").agg(F.avg("mae").alias("m"), F.avg("base").alias("b"))
    return t.groupBy("gate").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("b"), "prior_mae"), r6(F.avg("m"), "residual_mae"), r6(F.avg(F.col("b") - F.col("m")), "gain"))


# ---- geometry ------------------------------------------------------------------------

GEO = ["speed", "spread", "span", "centre"]


def geometry(spark, sf):
    """Trial geometry covariates with the trial's mean absolute deviation as outcome."""
    def build():
        t = A.trace(spark, sf)
        k = ["subject", "video"]
        s = D.framed(t, k, "t", 1, 0, lambda d, w: d.withColumn("step", F.sqrt((F.col("valence") - F.lag("valence").over(w)) ** 2 + (F.col("arousal") - F.lag("arousal").over(w)) ** 2)))
        g = s.groupBy(*k).agg(F.coalesce(F.avg("step"), F.lit(0.0)).alias("speed"), F.var_pop("valence").alias("spread"), (F.max("arousal") - F.min("arousal")).alias("span"),
                              F.avg(F.sqrt((F.col("valence") - 128) ** 2 + (F.col("arousal") - 128) ** 2)).alias("centre"))
        y = oof(spark, sf).groupBy(*k).agg(F.avg(F.abs(F.col("value") - F.col("prior"))).alias("y"), F.max("fold").alias("fold"))
        # item fixed effects: every column relative to its item mean
        j = g.join(y, k)
        mu = j.groupBy("video").agg(*[F.avg(c).alias(f"mu_{c}") for c in (*GEO, "y")])
        d = j.join(mu, "video")
        return d.select(*k, "fold", *[(F.col(c) - F.col(f"mu_{c}")).alias(c) for c in (*GEO, "y")])
    return written(spark, "geometry", sf, build)


def residualize(df, columns, alphas=(0.0,)):
    path, z = fit(df, "k", columns, "y", alphas, clip=None)
    z = R.with_keys(z, R.coefficients(path, "k").select("beta"), [])
    return z.withColumn("rest", F.col("y") - F.col("y_mean") - R.dot("z", "beta"))


@query("rg7_fixed_effect_residuals")
def _(spark, sf):
    return residualize(geometry(spark, sf), GEO).select("subject", "video", r6("rest"))


def crossfit(spark, sf, columns=GEO):
    g = geometry(spark, sf)
    models = fold_models(g, "fold", columns, "y", (1e-9,))
    return score(g, models, "fold", columns).withColumn("rest", F.col("y") - F.col("scores")[0]["pred"])


@query("rg8_crossfitted_residuals")
def _(spark, sf):
    return crossfit(spark, sf).select("subject", "video", "fold", r6("rest"))


@query("rg9_variance_inflation")
def _(spark, sf):
    z = centred(geometry(spark, sf), GEO, "y", clip=None).withColumn("k", F.lit(0).cast("long"))
    return R.inflation(R.gram(z, "k", "z", F.col("y")), "k").select("i", r6("vif"))


@query("bs14_geometry_bootstrap")
def _(spark, sf):
    """Residual variance share after refitting the covariates on every drawn panel."""
    g = geometry(spark, sf)
    p = D.dense_index(g, "subject", F.floor(F.col("subject") / 4096))
    n = p.agg(F.count(F.lit(1)).alias("n")).scalar()
    m = Rs.multiplicities(p, "idx", n, "ge", 20, "w").join(p, "idx").select("draw", "subject", "w")
    rows = g.join(m, "subject").withColumn("v", F.array(F.lit(1.0), *[F.col(c) for c in GEO]))
    # one Gram per draw, weighted by multiplicity, gives the refit and its residual sum
    gr = R.gram(rows, "draw", "v", F.col("y"), F.col("w"))
    import numpy as np
    import pandas as pd

    def share(pdf):
        d = int(pdf["i"].max()) + 1
        a = np.zeros((d, d))
        a[pdf["i"], pdf["j"]] = pdf["v"]
        b = np.linalg.lstsq(a[:-1, :-1], a[:-1, -1], rcond=None)[0]
        sse, sst = a[-1, -1] - b @ a[:-1, -1], a[-1, -1] - a[0, -1] ** 2 / a[0, 0]
        return pd.DataFrame({"draw": [pdf["draw"].iloc[0]], "stat": [sse / max(sst, 1e-12)]})

    return Rs.interval(gr.groupBy("draw").applyInPandas(share, "draw long, stat double")).select(r6("mean"), r6("low"), r6("high"))


@query("cq16_geometry_study")
def _(spark, sf):
    from ..operators import reliability as Rl
    raw = geometry(spark, sf).select("subject", F.col("video").alias("item"), F.col("y").alias("x"))
    adj = crossfit(spark, sf).select("subject", F.col("video").alias("item"), F.col("rest").alias("x"))
    both = raw.withColumn("kind", F.lit("raw")).unionByName(adj.withColumn("kind", F.lit("adjusted")))
    c = Rl.variance_components(both, ["kind"])
    return c.select("kind", r6("var_subject"), r6("var_residual"), r6(Rl.relative_g(F.lit(15)), "relative_g"))


# ---- low-rank profiles ---------------------------------------------------------------

@query("rg11_low_rank_profile")
def _(spark, sf):
    return low_rank(spark, sf, 2, 2, 1.0).select("subject", "item", r6("predicted"), r6("x", "observed"))


def item_designs(spark, sf, rank):
    """fold, item, design: intercept and leading directions of the other folds' subjects; missing cells count as no deviation."""
    def build():
        lk = lookup(spark, sf)
        found = Lr.loadings(lk.select("subject", "item", "fold", "d"), 5, rank)
        return found.select(F.col("fold").cast("long").alias("fold"), "item", F.concat(F.array(F.lit(1.0)), "load").alias("design"))
    return written(spark, f"item_designs_{rank}", sf, build)


def low_rank(spark, sf, rank, budget, ridge, shrinkage=1.0):
    """Item loadings from training folds, projected from ``budget`` observed items; beside it a plain offset.

    Each subject solves a (rank+1)-sized system built from the items it has;
    other items may be missing.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql import Window
    rows = lookup(spark, sf).join(item_designs(spark, sf, rank), ["fold", "item"])
    h = Rs.hash_value("lr", F.col("subject"), F.col("item"))
    rows = rows.withColumn("seen", F.row_number().over(Window.partitionBy("subject").orderBy(h, "item")) <= budget)

    def project(pdf):
        x = np.stack(pdf["design"].to_numpy())
        s, d = pdf["seen"].to_numpy(), pdf["d"].to_numpy()
        pen = np.full(x.shape[1], ridge)
        pen[0] *= 0.25
        b = np.linalg.solve(x[s].T @ x[s] + np.diag(pen), x[s].T @ d[s])
        return pd.DataFrame({"fold": pdf["fold"], "subject": pdf["subject"], "item": pdf["item"], "seen": s, "x": pdf["x"], "mu": pdf["mu"], "predicted": pdf["mu"] + x @ b,
                             "offset": pdf["mu"] + d[s].sum() / (s.sum() + shrinkage)})

    return rows.select("fold", "subject", "item", "seen", "x", "mu", "d", "design").groupBy("subject").applyInPandas(
        project, "fold long, subject long, item int, seen boolean, x double, mu double, predicted double, offset double")


@query("cq9_few_shot_calibration")
def _(spark, sf):
    """Held-out error by budget: item means, a shrunk offset, and the low-rank projection; a budget of all items leaves nothing to judge."""
    parts = [low_rank(spark, sf, 2, b, 1.0).filter(~F.col("seen")).withColumn("budget", F.lit(b)) for b in (1, 2, 4, 8)]
    e = reduce(lambda a, b: a.unionByName(b), parts)
    off = lambda c: F.avg(F.abs(F.col("x") - F.col(c)))
    s = e.groupBy("budget", "subject").agg(off("mu").alias("base"), off("offset").alias("additive"), off("predicted").alias("lowrank"))
    return s.groupBy("budget").agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("base"), "item_mean_mae"), r6(F.avg("additive"), "additive_mae"), r6(F.avg("lowrank"), "low_rank_mae"),
                                   F.count_if(F.col("base") > F.col("lowrank")).alias("improved"))


# ---- trial feature blocks ------------------------------------------------------------

def trial_blocks(spark, sf):
    """Per trial: context, level and motion feature blocks as ARRAYs, and the lag outcome."""
    def build():
        t = A.trace(spark, sf)
        k = ["subject", "video"]
        s = D.framed(t, k, "t", 1, 0, lambda d, w: d.withColumn("dv", F.col("valence") - F.coalesce(F.lag("valence").over(w), "valence")))
        b = s.groupBy(*k).agg(F.array(F.count(F.lit(1)).cast("double"), F.avg("arousal")).alias("context"), F.array(F.avg("valence"), F.stddev_pop("valence")).alias("level"),
                              F.array(F.avg(F.abs("dv")), F.stddev_pop("dv")).alias("motion"))
        y = oof(spark, sf).groupBy(*k).agg(F.avg(F.abs(F.col("value") - F.col("prior"))).alias("y"), F.max("fold").alias("fold"))
        return b.join(y, k)
    return written(spark, "trial_blocks", sf, build)


@query("ag6_trial_block_summary", with_(TRACE) + f"""SELECT subject, video, {q6('avg(valence)')} AS mv, {q6('stddev_pop(valence)')} AS sv, {q6('avg(arousal)')} AS ma, {q6('stddev_pop(arousal)')} AS sa FROM trace GROUP BY 1, 2""")
def _(spark, sf):
    return A.trace(spark, sf).groupBy("subject", "video").agg(r6(F.avg("valence"), "mv"), r6(F.stddev_pop("valence"), "sv"), r6(F.avg("arousal"), "ma"), r6(F.stddev_pop("arousal"), "sa"))


SPECS = {"context": ["context"], "level": ["level"], "motion": ["motion"], "context+level": ["context", "level"], "context+motion": ["context", "motion"],
         "level+motion": ["level", "motion"], "all": ["context", "level", "motion"]}


@query("flt13_block_concatenation", with_(TRACE) + f"""SELECT subject, video, 'context+level' AS spec, CAST(4 AS BIGINT) AS width, {q6('count(*) + avg(arousal) + avg(valence) + stddev_pop(valence)')} AS total FROM trace GROUP BY 1, 2
UNION ALL SELECT subject, video, 'level', CAST(2 AS BIGINT), {q6('avg(valence) + stddev_pop(valence)')} FROM trace GROUP BY 1, 2""")
def _(spark, sf):
    b = trial_blocks(spark, sf)
    parts = [b.select("subject", "video", F.lit(n).alias("spec"), F.concat(*SPECS[n]).alias("f")) for n in ("context+level", "level")]
    u = reduce(lambda a, c: a.unionByName(c), parts)
    return u.select("subject", "video", "spec", F.size("f").cast("long").alias("width"), r6(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), "total"))


def sensing(spark, sf, blocks):
    """Held-out error of every feature set, with the fold mean as the plain baseline."""
    parts = []
    for name, names in SPECS.items():
        v = blocks.withColumn("f", F.concat(*names))
        width = 2 * len(names)
        cols = [f"f{i}" for i in range(width)]
        v = v.select("subject", "video", "fold", "y", *[F.col("f")[i].alias(f"f{i}") for i in range(width)])
        s = score(v, fold_models(v, "fold", cols, "y", (10.0,)), "fold", cols)
        parts.append(s.select(F.lit(name).alias("method"), "subject", "video", "y", F.col("scores")[0]["pred"].alias("pred")))
    part = blocks.groupBy("fold").agg(F.sum("y").alias("s"), F.count(F.lit(1)).alias("k"))
    mean = Fo.to_training(part, 5).groupBy(F.col("vfold").alias("fold")).agg((F.sum("s") / F.sum("k")).alias("pred"))
    parts.append(blocks.join(mean, "fold").select(F.lit("mean").alias("method"), "subject", "video", "y", "pred"))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("cq13_sensing_comparison")
def _(spark, sf):
    e = sensing(spark, sf, trial_blocks(spark, sf)).groupBy("method", "subject").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias("m"))
    return e.groupBy("method").agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("m"), "macro_mae"))


@query("cq14_pipeline_comparison")
def _(spark, sf):
    """Two feature pipelines side by side; methods that read no changed block must not move."""
    a = trial_blocks(spark, sf)
    b = a.withColumn("motion", F.transform("motion", lambda x: F.round(x, 1)))
    err = lambda d, n: sensing(spark, sf, d).groupBy("method").agg(F.avg(F.abs(F.col("y") - F.col("pred"))).alias(n))
    j = err(a, "before").join(err(b, "after"), "method")
    return j.select("method", r6("before"), r6("after"), (F.col("method").contains("motion") | (F.col("method") == "all") | (F.abs(F.col("before") - F.col("after")) < 1e-9)).alias("consistent"))


@query("cv10_repeated_partitions")
def _(spark, sf):
    """Grouped refits over hash-shuffled partitions, each with a digest of its folds."""
    b = trial_blocks(spark, sf).drop("fold")
    ids = b.select("subject").distinct().withColumn("rep", Rs.draws(3))
    f = Rs.shuffled_rank(ids, ["rep"], ["rp", F.col("rep"), F.col("subject")], "subject", "k").select("rep", "subject", ((F.col("k") - 1) % 5).alias("part"))
    dig = f.groupBy("rep").agg(F.sum(Rs.hash_value(F.col("subject"), F.col("part"))).alias("digest"))
    cols = ["f0", "f1"]
    v = b.join(f, "subject").select("rep", "subject", "y", (F.col("rep") * 5 + F.col("part")).alias("fold"), F.col("level")[0].alias("f0"), F.col("level")[1].alias("f1"))
    own = R.gram(v.withColumn("_v", F.array(F.lit(1.0), "f0", "f1")), "fold", "_v", F.col("y"))
    own = own.withColumn("rep", F.floor(F.col("fold") / 5))
    tot = own.groupBy("rep", "i", "j").agg(F.sum("v").alias("t"))
    train = own.join(tot, ["rep", "i", "j"]).select("fold", "i", "j", (F.col("t") - F.col("v")).alias("v"))
    s = score(v, standardize_gram(train, "fold", (10.0,)), "fold", cols)
    m = s.groupBy("rep").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg(F.abs(F.col("y") - F.col("scores")[0]["pred"])), "mae"))
    return m.join(dig, "rep")
