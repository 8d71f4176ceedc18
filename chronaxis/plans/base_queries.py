"""Trace index, group references, round-robin folds and error metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributed as D
from ..operators import metrics as M
from ..operators import priors as P
from ..sources import adapters as A
from ..sources.shared import written
from .registry import CATEGORY, FOLDS, LONG, TRACE, q6, query, r6, with_

TRAIN = """train AS (
  SELECT g.vfold, l.video, l.t, l.axis, l.value
  FROM long l JOIN folds USING (subject) JOIN (SELECT unnest(range(5)) AS vfold) g ON g.vfold <> folds.fold)"""
REF = """ref AS (
  SELECT vfold, video, axis, t, avg(med) OVER (PARTITION BY vfold, video, axis ORDER BY t
         ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS prior
  FROM (SELECT vfold, video, axis, t, quantile_cont(value, 0.5) AS med FROM train GROUP BY 1, 2, 3, 4))"""
OOF = """ends AS (SELECT vfold, video, axis, max(t) + 1 AS n FROM ref GROUP BY 1, 2, 3),
oof AS (
  SELECT l.subject, l.video, l.t, l.axis, l.value, folds.fold, ref.prior
  FROM long l JOIN folds USING (subject)
  JOIN ends e ON e.vfold = folds.fold AND e.video = l.video AND e.axis = l.axis
  JOIN ref ON ref.vfold = folds.fold AND ref.video = l.video AND ref.axis = l.axis AND ref.t = least(l.t, e.n - 1))"""
OOF_ALL = with_(TRACE, LONG, FOLDS, TRAIN, REF, OOF)


def build_oof(spark, sf):
    tr = A.trace(spark, sf)
    long = A.long_axes(tr, "subject", "video", "t")
    folds = A.subject_folds(tr)
    # the reference is read twice (curve ends and values) and is small next to the rows
    ref = written(spark, "held_out_reference", sf, lambda: P.held_out_reference(long, folds, 5, 3))
    return P.population_oof(long, folds, reference=ref)


def oof(spark, sf):
    """Held-out predictions, written once because every metric reads them."""
    return written(spark, "population_oof", sf, lambda: build_oof(spark, sf))


def long_rows(spark, sf):
    return A.long_axes(A.trace(spark, sf), "subject", "video", "t")


@query("src1_trace_index", with_(TRACE) + f"""
SELECT printf('test_%d_%s_T%03d', subject, video, t) AS sample_id, subject, video, t,
       {q6('valence')} AS valence, {q6('arousal')} AS arousal FROM trace""")
def _(spark, sf):
    tr = A.trace(spark, sf)
    return tr.select(F.format_string("test_%d_%s_T%03d", "subject", "video", "t").alias("sample_id"),
                     "subject", "video", "t", r6("valence"), r6("arousal"))


@query("ag1_population_median", with_(TRACE, LONG) + f"""
SELECT video, axis, t, {q6('quantile_cont(value, 0.5)')} AS med, count(*) AS n FROM long GROUP BY video, axis, t""")
def _(spark, sf):
    c = P.population_curve(long_rows(spark, sf), ["video", "axis"])
    return c.select("video", "axis", "t", r6("med"), "n")


@query("ag2_median_and_mad", with_(TRACE, LONG) + f"""
, m AS (SELECT video, axis, t, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1, 2, 3)
SELECT l.video, l.axis, l.t, {q6('any_value(m.med)')} AS med,
       {q6('1.4826 * quantile_cont(abs(l.value - m.med), 0.5)')} AS mad
FROM long l JOIN m ON m.video = l.video AND m.axis = l.axis AND m.t = l.t GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = P.median_and_mad(long_rows(spark, sf), ["video", "axis", "t"])
    return c.select("video", "axis", "t", r6("med"), r6("mad"))


@query("ag3_constant_priors", with_(TRACE, LONG) + f"""
, c AS (SELECT {CATEGORY} AS category, axis, quantile_cont(value, 0.5) AS med, count(*) AS n FROM long GROUP BY 1, 2),
g AS (SELECT axis, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1)
SELECT category, axis, {q6('c.med')} AS category_prior, {q6('g.med')} AS global_prior, n FROM c JOIN g USING (axis)""")
def _(spark, sf):
    long = long_rows(spark, sf).withColumn("category", A.category())
    c = D.quantiles(long, ["category", "axis"], F.col("value"), {"cp": 0.5})
    g = D.quantiles(long, ["axis"], F.col("value"), {"gp": 0.5}).drop("n")
    return c.join(g, "axis").select("category", "axis", r6("cp", "category_prior"), r6("gp", "global_prior"), "n")


@query("ag4_pooled_window_median", with_(TRACE, LONG) + f"""
, s AS (SELECT video, axis, value, t + d.d AS t FROM long, (SELECT unnest(range(-2, 3)) AS d) d),
e AS (SELECT video, axis, max(t) AS m FROM long GROUP BY 1, 2)
SELECT s.video, s.axis, s.t, {q6('quantile_cont(value, 0.5)')} AS med, count(*) AS n
FROM s JOIN e ON e.video = s.video AND e.axis = s.axis WHERE s.t BETWEEN 0 AND e.m GROUP BY 1, 2, 3""")
def _(spark, sf):
    c = P.pooled_window_median(long_rows(spark, sf), ["video", "axis"], 2)
    return c.select("video", "axis", "t", r6("med"), "n")


@query("ag24_item_duration", with_(TRACE) + "SELECT video, max(t) + 1 AS duration FROM trace GROUP BY video")
def _(spark, sf):
    return A.trace(spark, sf).groupBy("video").agg((F.max("t") + 1).alias("duration"))


@query("cv1_round_robin_folds", with_(TRACE, FOLDS) + "SELECT subject, fold FROM folds")
def _(spark, sf):
    return A.subject_folds(A.trace(spark, sf))


@query("jn1_reference_lookup", OOF_ALL + f"""
SELECT subject, video, t, axis, fold, {q6('value')} AS value, {q6('prior')} AS prior FROM oof""")
def _(spark, sf):
    return oof(spark, sf).select("subject", "video", "t", "axis", "fold", r6("value"), r6("prior"))


@query("mt1_trial_macro_mae", OOF_ALL + f"""
SELECT count(*) AS trials, {q6('avg(mae)')} AS macro_mae
FROM (SELECT subject, video, avg(abs(prior - value)) AS mae FROM oof GROUP BY 1, 2)""")
def population_prior_mae(spark, sf):
    """How well the other participants' median predicts each held-out participant."""
    return M.macro_mae(build_oof(spark, sf)).select("trials", r6("macro_mae"))


@query("mt2_metric_levels", OOF_ALL + f"""
SELECT CAST('sample' AS VARCHAR) AS level, CAST('all' AS VARCHAR) AS unit, {q6('avg(abs(prior - value))')} AS mae FROM oof
UNION ALL SELECT 'axis', CAST(axis AS VARCHAR), {q6('avg(abs(prior - value))')} FROM oof GROUP BY axis
UNION ALL SELECT 'subject', 'macro', {q6('avg(m)')} FROM (SELECT avg(abs(prior - value)) AS m FROM oof GROUP BY subject)
UNION ALL SELECT 'item', 'macro', {q6('avg(m)')} FROM (SELECT avg(abs(prior - value)) AS m FROM oof GROUP BY video)""")
def _(spark, sf):
    # One partial aggregate per (subject, video, axis) serves all four levels.
    cells = oof(spark, sf).groupBy("subject", "video", "axis").agg(
        F.sum(F.abs(F.col("prior") - F.col("value"))).alias("e"), F.count(F.lit(1)).alias("k"))
    mean = F.sum("e") / F.sum("k")
    levels = (
        cells.groupingSets([[], ["axis"], ["subject"], ["video"]], "axis", "subject", "video")
        .agg(F.grouping_id().alias("gid"), mean.alias("m"))
        .select(F.when(F.col("gid") == 7, "sample").when(F.col("gid") == 3, "axis")
                .when(F.col("gid") == 5, "subject").otherwise("item").alias("level"),
                F.when(F.col("gid") == 7, "all").when(F.col("gid") == 3, F.col("axis").cast("string"))
                .otherwise("macro").alias("unit"), "m")
    )
    return levels.groupBy("level", "unit").agg(r6(F.avg("m"), "mae"))


@query("mt3_gain_matrix", OOF_ALL + f""", g AS (SELECT axis, quantile_cont(value, 0.5) AS flat FROM long GROUP BY 1)
SELECT subject, video, {q6('avg(abs(flat - value)) - avg(abs(prior - value))')} AS gain FROM oof JOIN g USING (axis)
GROUP BY 1, 2""")
def _(spark, sf):
    o = oof(spark, sf)
    flat = D.quantiles(long_rows(spark, sf), ["axis"], F.col("value"), {"flat": 0.5}).select("axis", "flat")
    err = lambda p: F.avg(F.abs(F.col(p) - F.col("value")))
    return o.join(flat, "axis").groupBy("subject", "video").agg(r6(err("flat") - err("prior"), "gain"))


@query("mt4_wide_trial_report", OOF_ALL + f""", g AS (SELECT axis, quantile_cont(value, 0.5) AS flat FROM long GROUP BY 1),
w AS (SELECT subject, video, avg(abs(prior - value)) FILTER (axis = 0) AS p0, avg(abs(prior - value)) FILTER (axis = 1) AS p1,
 avg(abs(flat - value)) FILTER (axis = 0) AS f0, avg(abs(flat - value)) FILTER (axis = 1) AS f1
 FROM oof JOIN g USING (axis) GROUP BY 1, 2)
SELECT subject, video, {q6('p0')} AS population_valence_mae, {q6('p1')} AS population_arousal_mae,
 {q6('f0')} AS constant_valence_mae, {q6('f1')} AS constant_arousal_mae,
 {q6('(f0 + f1) / 2 - (p0 + p1) / 2')} AS gain FROM w""")
def _(spark, sf):
    o = oof(spark, sf)
    flat = D.quantiles(long_rows(spark, sf), ["axis"], F.col("value"), {"flat": 0.5}).select("axis", "flat")

    def err(p, axis):
        return F.avg(F.when(F.col("axis") == axis, F.abs(F.col(p) - F.col("value"))))

    w = o.join(flat, "axis").groupBy("subject", "video").agg(
        err("prior", 0).alias("p0"), err("prior", 1).alias("p1"), err("flat", 0).alias("f0"), err("flat", 1).alias("f1"))
    return w.select("subject", "video", r6("p0", "population_valence_mae"), r6("p1", "population_arousal_mae"),
                    r6("f0", "constant_valence_mae"), r6("f1", "constant_arousal_mae"),
                    r6((F.col("f0") + F.col("f1")) / 2 - (F.col("p0") + F.col("p1")) / 2, "gain"))


@query("mt5_correction_size", OOF_ALL + f""", g AS (SELECT axis, quantile_cont(value, 0.5) AS flat FROM long GROUP BY 1)
SELECT axis, {q6('avg(abs(prior - flat))')} AS mean_abs, {q6('quantile_cont(abs(prior - flat), 0.95)')} AS p95
FROM oof JOIN g USING (axis) GROUP BY axis""")
def _(spark, sf):
    flat = D.quantiles(long_rows(spark, sf), ["axis"], F.col("value"), {"flat": 0.5}).select("axis", "flat")
    d = oof(spark, sf).join(flat, "axis").withColumn("d", F.abs(F.col("prior") - F.col("flat")))
    q = D.quantiles(d, ["axis"], F.col("d"), {"p95": 0.95}).drop("n")
    return d.groupBy("axis").agg(F.avg("d").alias("m")).join(q, "axis").select("axis", r6("m", "mean_abs"), r6("p95"))


@query("cv9_fold_manifest", with_(TRACE, FOLDS) + """
SELECT fold, count(*) AS subjects, (SELECT count(*) FROM folds) - count(*) AS training_subjects, min(subject) AS first_subject,
 max(subject) AS last_subject, 'other subjects of the training side' AS training_reference,
 'all training subjects' AS validation_reference FROM folds GROUP BY fold""")
def _(spark, sf):
    f = A.subject_folds(A.trace(spark, sf))
    total = f.agg(F.count(F.lit(1)).alias("total"))
    return f.groupBy("fold").agg(
        F.count(F.lit(1)).alias("subjects"), F.min("subject").alias("first_subject"), F.max("subject").alias("last_subject"),
    ).select("fold", "subjects", (total.scalar() - F.col("subjects")).alias("training_subjects"), "first_subject",
             "last_subject", F.lit("other subjects of the training side").alias("training_reference"),
             F.lit("all training subjects").alias("validation_reference"))


@query("dq9_fold_integrity", OOF_ALL + """
SELECT (SELECT count(*) FROM long) AS rows_expected, count(*) AS rows_predicted,
 count(*) - count(DISTINCT concat_ws('|', subject, video, t, axis)) AS duplicates,
 (SELECT count(*) FROM (SELECT subject FROM folds GROUP BY subject HAVING count(DISTINCT fold) > 1)) AS leaking_subjects
FROM oof""")
def _(spark, sf):
    tr = A.trace(spark, sf)
    long = A.long_axes(tr, "subject", "video", "t")
    folds = A.subject_folds(tr)
    o = P.population_oof(long, folds)
    cells = o.groupBy("subject", "video", "t", "axis").agg(F.count(F.lit(1)).alias("k"))
    expected = long.agg(F.count(F.lit(1)).alias("c"))
    leak = folds.groupBy("subject").agg(F.count_distinct("fold").alias("k")).agg(F.count_if(F.col("k") > 1).alias("c"))
    return cells.agg(F.sum("k").alias("p"), F.count(F.lit(1)).alias("d")).select(
        expected.scalar().alias("rows_expected"), F.col("p").alias("rows_predicted"),
        (F.col("p") - F.col("d")).alias("duplicates"), leak.scalar().alias("leaking_subjects"))
