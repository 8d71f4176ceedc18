"""Selection, routing, personalization and transfer studies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import distributed as D
from ..operators import donors as Dn
from ..operators import folds as Fo
from ..operators import priors as P
from ..operators import resample as Rs
from ..operators import transfer as Tr
from ..sources import adapters as A
from ..sources.shared import written
from .base_queries import TRAIN, long_rows
from .prior_queries import K3
from .registry import CATEGORY, FOLDS, LONG, MATRIX, TRACE, q6, query, r6, with_
from .reliability_queries import CUBE, calibration, category_cube, category_permutation, hash_sql, mx
from .scalar_queries import holm

# ---- candidate priors and selection ------------------------------------------------

CURVES5 = "cv AS (SELECT vfold, video, axis, t, quantile_cont(value, 0.5) AS med FROM train GROUP BY 1, 2, 3, 4)"


def _sm(r):
    return f"avg(med) OVER (PARTITION BY vfold, video, axis ORDER BY t ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


CAND = with_(TRACE, LONG, FOLDS, TRAIN, CURVES5) + f""", cs AS (SELECT vfold, video, axis, t, count(*) OVER (PARTITION BY vfold, video, axis) AS n, med AS p0, {_sm(1)} AS p1, {_sm(3)} AS p3, {_sm(5)} AS p5 FROM cv),
fl AS (SELECT vfold, axis, quantile_cont(value, 0.5) AS flat FROM train GROUP BY 1, 2),
e AS (SELECT f.fold, l.subject, l.video, l.axis, avg(abs(l.value - fl.flat)) AS flat, avg(abs(l.value - p0)) AS r0, avg(abs(l.value - p1)) AS r1, avg(abs(l.value - p3)) AS r3, avg(abs(l.value - p5)) AS r5
 FROM long l JOIN folds f USING (subject) JOIN fl ON fl.vfold = f.fold AND fl.axis = l.axis JOIN (SELECT vfold, video, axis, max(n) AS n FROM cs GROUP BY 1, 2, 3) en ON en.vfold = f.fold AND en.video = l.video AND en.axis = l.axis
 JOIN cs ON cs.vfold = f.fold AND cs.video = l.video AND cs.axis = l.axis AND cs.t = least(l.t, en.n - 1) GROUP BY 1, 2, 3, 4),
cand AS (SELECT fold, subject, video, axis, name, mae, CASE name WHEN 'flat' THEN 0 WHEN 'r0' THEN 1 WHEN 'r1' THEN 2 WHEN 'r3' THEN 3 ELSE 4 END AS simplicity FROM (UNPIVOT e ON flat, r0, r1, r3, r5 INTO NAME name VALUE mae))
"""
INNER = """, inner_score AS (SELECT g.vfold, axis, name, simplicity, round(avg(mae), 9) AS score FROM cand JOIN (SELECT unnest(range(5)) AS vfold) g ON g.vfold <> cand.fold GROUP BY 1, 2, 3, 4)
"""
NAMES = ["flat", "r0", "r1", "r3", "r5"]


def candidates(spark, sf):
    """(fold, subject, video, axis, name, simplicity, mae): every candidate on every held-out trial.

    The candidates are columns of one pass over the reference; rows are only
    multiplied after the seconds of a trial are summed.
    """
    def build():
        tr = A.trace(spark, sf)
        long, folds = A.long_axes(tr, "subject", "video", "t"), A.subject_folds(tr)
        train = Fo.to_training(long.join(folds, "subject"), 5)
        key = ["vfold", "video", "axis"]
        curve = P.population_curve(train, key)

        def radii(d, w):
            for r in (1, 3, 5):
                d = d.withColumn(f"p{r}", F.avg("med").over(w.rowsBetween(-r, r)))
            return d

        curve = D.framed(curve, key, "t", 5, 5, radii).withColumn("p0", F.col("med")).drop("n", "med")
        flat = D.quantiles(train, ["vfold", "axis"], F.col("value"), {"flat": 0.5}).drop("n")
        rows = long.join(folds, "subject").withColumnRenamed("fold", "vfold").join(flat, ["vfold", "axis"])
        hit = P.clamp_lookup(rows, curve, key)
        err = lambda c: F.avg(F.abs(F.col("value") - F.col(c)))
        e = hit.groupBy(F.col("vfold").alias("fold"), *K3).agg(err("flat").alias("flat"), *[err(f"p{r}").alias(f"r{r}") for r in (0, 1, 3, 5)])
        long_e = e.unpivot(["fold", *K3], NAMES, "name", "mae")
        rank = F.when(F.col("name") == "flat", 0).when(F.col("name") == "r0", 1).when(F.col("name") == "r1", 2).when(F.col("name") == "r3", 3).otherwise(4)
        return long_e.withColumn("simplicity", rank)
    return written(spark, "candidates", sf, build)


def inner_scores(c):
    """Score of each candidate for each held-out fold, from the other folds only."""
    cells = c.groupBy("fold", "axis", "name", "simplicity").agg(F.sum("mae").alias("s"), F.count(F.lit(1)).alias("k"))
    other = Fo.to_training(cells, 5)
    return other.groupBy("vfold", "axis", "name", "simplicity").agg(F.round(F.sum("s") / F.sum("k"), 9).alias("score"))


@query("tk1_candidate_arg_min", CAND + INNER + """SELECT vfold, axis, arg_min(name, {'a': score, 'b': simplicity, 'c': name}) AS winner FROM inner_score GROUP BY 1, 2""")
def _(spark, sf):
    return inner_scores(candidates(spark, sf)).groupBy("vfold", "axis").agg(F.min_by("name", F.struct("score", "simplicity", "name")).alias("winner"))


ROUTE = """, ch AS (SELECT vfold, axis, max(score) FILTER (name = 'flat') AS base, arg_min(name, {'a': score, 'b': simplicity, 'c': name}) AS best, min(score) AS best_score FROM inner_score GROUP BY 1, 2),
routed AS (SELECT *, CASE WHEN best <> 'flat' AND base - best_score >= 0.05 THEN best ELSE 'flat' END AS selected FROM ch)
"""


def choose(scores, baseline, least):
    """Best candidate only when it beats the baseline by at least ``least``."""
    g = scores.groupBy("vfold", "axis").agg(
        F.max(F.when(F.col("name") == baseline, F.col("score"))).alias("base"),
        F.min_by("name", F.struct("score", F.when(F.col("name") == baseline, 0).otherwise(1), "simplicity", "name")).alias("best"), F.min("score").alias("best_score"))
    take = (F.col("best") != baseline) & (F.col("base") - F.col("best_score") >= least)
    return g.withColumn("selected", F.when(take, F.col("best")).otherwise(F.lit(baseline)))


@query("tk2_minimum_gain_fallback", CAND + INNER + ROUTE + f"SELECT vfold, axis, {q6('base')} AS base, {q6('best_score')} AS best_score, best, selected FROM routed")
def _(spark, sf):
    return choose(inner_scores(candidates(spark, sf)), "flat", 0.05).select("vfold", "axis", r6("base"), r6("best_score"), "best", "selected")


@query("tk3_top_candidates", CAND + INNER + f"SELECT * FROM (SELECT vfold, axis, row_number() OVER (PARTITION BY vfold, axis ORDER BY score, simplicity, name) AS place, name, {q6('score')} AS score FROM inner_score) WHERE place <= 5")
def _(spark, sf):
    w = Window.partitionBy("vfold", "axis").orderBy("score", "simplicity", "name")  # one row per candidate
    return inner_scores(candidates(spark, sf)).withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5").select("vfold", "axis", "place", "name", r6("score"))


@query("ag12_choice_histogram", CAND + INNER + ROUTE + "SELECT axis, selected AS name, count(*) AS folds FROM routed GROUP BY 1, 2")
def _(spark, sf):
    return choose(inner_scores(candidates(spark, sf)), "flat", 0.05).groupBy("axis", F.col("selected").alias("name")).agg(F.count(F.lit(1)).alias("folds"))


@query("ts23_axis_routing", CAND + INNER + ROUTE + f"SELECT c.subject, c.video, c.axis, c.name, {q6('c.mae')} AS mae FROM cand c JOIN routed r ON r.vfold = c.fold AND r.axis = c.axis AND r.selected = c.name")
def _(spark, sf):
    return routed(spark, sf, 0.05).select(*K3, "name", r6("mae"))


def routed(spark, sf, least):
    c = candidates(spark, sf)
    pick = choose(inner_scores(c), "flat", least).select(F.col("vfold").alias("fold"), "axis", F.col("selected").alias("name"))
    return c.join(pick, ["fold", "axis", "name"])


@query("cq4_routing_experiment", CAND + INNER + ROUTE + f""", t AS (SELECT c.subject, c.video, avg(c.mae) AS routed, avg(b.mae) AS base FROM cand c JOIN routed r ON r.vfold = c.fold AND r.axis = c.axis AND r.selected = c.name JOIN cand b ON b.subject = c.subject AND b.video = c.video AND b.axis = c.axis AND b.name = 'flat' GROUP BY 1, 2)
SELECT count(*) AS trials, {q6('avg(base)')} AS baseline_mae, {q6('avg(routed)')} AS routed_mae, count(*) FILTER (base - routed > 0) AS improved, count(*) FILTER (base - routed < 0) AS degraded FROM t""")
def _(spark, sf):
    base = candidates(spark, sf).filter("name = 'flat'").select(*K3, F.col("mae").alias("base"))
    t = routed(spark, sf, 0.05).join(base, K3).groupBy("subject", "video").agg(F.avg("mae").alias("r"), F.avg("base").alias("b"))
    g = F.col("b") - F.col("r")
    return t.agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("b"), "baseline_mae"), r6(F.avg("r"), "routed_mae"), F.count_if(g > 0).alias("improved"), F.count_if(g < 0).alias("degraded"))


@query("mt9_decision_curve", CAND + INNER + f""", ch AS (SELECT vfold, axis, max(score) FILTER (name = 'flat') AS base, arg_min(name, {{'a': score, 'b': simplicity, 'c': name}}) AS best, min(score) AS bs FROM inner_score GROUP BY 1, 2),
th AS (SELECT unnest([0.0, 0.05, 0.5, 5.0, 50.0]) AS thr), d AS (SELECT thr, vfold, axis, CASE WHEN best <> 'flat' AND base - bs >= thr THEN best ELSE 'flat' END AS name FROM ch, th)
SELECT CAST(thr AS DOUBLE) AS threshold, {q6('avg(m)')} AS macro_mae FROM (SELECT thr, subject, video, avg(mae) AS m FROM cand JOIN d ON d.vfold = cand.fold AND d.axis = cand.axis AND d.name = cand.name GROUP BY 1, 2, 3) GROUP BY thr""")
def _(spark, sf):
    c = candidates(spark, sf)
    s = choose(inner_scores(c), "flat", 0.0).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.0, 0.05, 0.5, 5.0, 50.0)))))
    take = (F.col("best") != "flat") & (F.col("base") - F.col("best_score") >= F.col("threshold"))
    pick = s.select("threshold", F.col("vfold").alias("fold"), "axis", F.when(take, F.col("best")).otherwise("flat").alias("name"))
    t = c.join(pick, ["fold", "axis", "name"]).groupBy("threshold", "subject", "video").agg(F.avg("mae").alias("m"))
    return t.groupBy("threshold").agg(r6(F.avg("m"), "macro_mae"))


@query("tk4_percentile_pick", CAND + f""", t AS (SELECT subject, video, round(avg(mae), 9) AS m FROM cand WHERE name = 'r3' GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (ORDER BY m, subject, video) - 1 AS k, count(*) OVER () AS n FROM t)
SELECT p AS percentile, subject, video, {q6('m')} AS mae FROM o, (SELECT unnest([10, 50, 90]) AS p) WHERE k = floor(p / 100.0 * (n - 1) + 0.5)""")
def _(spark, sf):
    t = candidates(spark, sf).filter("name = 'r3'").groupBy("subject", "video").agg(F.round(F.avg("mae"), 9).alias("m"))
    n = t.agg(F.count(F.lit(1)).alias("n")).scalar()
    o = D.ranked(t, [], F.col("m"), ["subject", "video"], ordinal="k").withColumn("percentile", F.explode(F.array(*map(F.lit, (10, 50, 90)))))
    return o.filter(F.col("k") - 1 == F.floor(F.col("percentile") / 100.0 * (n - 1) + 0.5)).select("percentile", "subject", "video", r6("m", "mae"))


@query("mt12_baseline_comparison", CAND + f""", t AS (SELECT subject, video, avg(mae) FILTER (name = 'flat') AS a, avg(mae) FILTER (name = 'r0') AS b, avg(mae) FILTER (name = 'r3') AS c FROM cand GROUP BY 1, 2)
SELECT {q6('avg(a)')} AS flat_mae, {q6('avg(b)')} AS raw_mae, {q6('avg(c)')} AS smooth_mae, {q6('avg(a - c)')} AS gain_over_flat, {q6('avg(b - c)')} AS gain_over_raw, count(*) FILTER (a - c > 0) AS improved FROM t""")
def _(spark, sf):
    on = lambda n: F.avg(F.when(F.col("name") == n, F.col("mae")))
    t = candidates(spark, sf).groupBy("subject", "video").agg(on("flat").alias("a"), on("r0").alias("b"), on("r3").alias("c"))
    return t.agg(r6(F.avg("a"), "flat_mae"), r6(F.avg("b"), "raw_mae"), r6(F.avg("c"), "smooth_mae"), r6(F.avg(F.col("a") - F.col("c")), "gain_over_flat"),
                 r6(F.avg(F.col("b") - F.col("c")), "gain_over_raw"), F.count_if(F.col("a") - F.col("c") > 0).alias("improved"))


@query("cq25_experiment_summary", CAND + f"""SELECT name, count(*) AS cells, {q6('round(avg(mae), 9)')} AS mae, count(DISTINCT concat_ws('|', subject, video, axis)) AS ids, round(avg(mae), 9) = (SELECT min(m) FROM (SELECT round(avg(mae), 9) AS m FROM cand GROUP BY name)) AS winner FROM cand GROUP BY name""")
def _(spark, sf):
    g = candidates(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("cells"), F.round(F.avg("mae"), 9).alias("m"), F.count_distinct("subject", "video", "axis").alias("ids"))
    return g.select("name", "cells", r6("m", "mae"), "ids", (F.col("m") == g.agg(F.min("m")).scalar()).alias("winner"))


@query("jn11_artifact_alignment", CAND + """SELECT count(*) AS ids, count(*) FILTER (a.mae IS NULL OR b.mae IS NULL) AS missing, count(*) FILTER (a.fold IS DISTINCT FROM b.fold) AS fold_mismatch
FROM (SELECT * FROM cand WHERE name = 'flat') a FULL JOIN (SELECT * FROM cand WHERE name = 'r3') b USING (subject, video, axis)""")
def _(spark, sf):
    c = candidates(spark, sf)
    a = c.filter("name = 'flat'").select(*K3, F.col("fold").alias("fa"), F.col("mae").alias("ma"))
    b = c.filter("name = 'r3'").select(*K3, F.col("fold").alias("fb"), F.col("mae").alias("mb"))
    return a.join(b, K3, "full_outer").agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("ma").isNull() | F.col("mb").isNull()).alias("missing"),
                                           F.count_if(~F.col("fa").eqNullSafe(F.col("fb"))).alias("fold_mismatch"))


# ---- double hold-out ---------------------------------------------------------------

DOUBLE = with_(TRACE, LONG, FOLDS) + f""", vf AS (SELECT video, (row_number() OVER (ORDER BY video) - 1) % 5 AS ifold, {CATEGORY} AS category, n AS m FROM (SELECT video, max(t) + 1 AS n FROM trace GROUP BY 1)),
b AS (SELECT s.s AS sfold, i.i AS ifold, vf.category, l.axis, l.value FROM long l JOIN folds USING (subject) JOIN vf USING (video) JOIN (SELECT unnest(range(5)) AS s) s ON s.s <> folds.fold JOIN (SELECT unnest(range(5)) AS i) i ON i.i <> vf.ifold),
g AS (SELECT sfold, ifold, axis, quantile_cont(value, 0.5) AS gc FROM b GROUP BY 1, 2, 3), c AS (SELECT sfold, ifold, category, axis, quantile_cont(value, 0.5) AS cc FROM b GROUP BY 1, 2, 3, 4),
cv AS (SELECT s.s AS sfold, l.video, l.axis, l.t, quantile_cont(l.value, 0.5) AS x FROM long l JOIN folds USING (subject) JOIN (SELECT unnest(range(5)) AS s) s ON s.s <> folds.fold GROUP BY 1, 2, 3, 4),
sm AS (SELECT sfold, video, axis, t, avg(x) OVER w AS x, count(*) OVER (PARTITION BY sfold, video, axis) AS n FROM cv WINDOW w AS (PARTITION BY sfold, video, axis ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
src AS (SELECT DISTINCT sfold, video, axis, n FROM sm),
pr AS (SELECT src.sfold, a.video, src.axis, a.m, b2.video AS sv, src.n AS sn, i, CASE WHEN a.m = 1 THEN 0 ELSE i * (src.n - 1) / CAST(a.m - 1 AS DOUBLE) END AS pos FROM vf a JOIN vf b2 ON a.category = b2.category AND a.ifold <> b2.ifold JOIN src ON src.video = b2.video, LATERAL (SELECT unnest(range(a.m)) AS i) r),
tp AS (SELECT pr.sfold, pr.video, pr.axis, pr.i AS t, sum(exp(-abs(sn - m) / 30.0) * (0.5 * ((1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x) + 0.5 * ab.x)) / sum(exp(-abs(sn - m) / 30.0)) AS tpl FROM pr
 JOIN sm lo ON lo.sfold = pr.sfold AND lo.video = sv AND lo.axis = pr.axis AND lo.t = CAST(floor(pos) AS BIGINT) JOIN sm hi ON hi.sfold = pr.sfold AND hi.video = sv AND hi.axis = pr.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, sn - 1)
 JOIN sm ab ON ab.sfold = pr.sfold AND ab.video = sv AND ab.axis = pr.axis AND ab.t = least(i, sn - 1) GROUP BY 1, 2, 3, 4),
d AS (SELECT l.subject, l.video, l.axis, l.t, l.value, folds.fold AS sfold, vf.ifold, g.gc AS global_constant, coalesce(c.cc, g.gc) AS category_constant, least(greatest(coalesce(tp.tpl, g.gc), 1), 255) AS category_phase
 FROM long l JOIN folds USING (subject) JOIN vf USING (video) JOIN g ON g.sfold = folds.fold AND g.ifold = vf.ifold AND g.axis = l.axis LEFT JOIN c ON c.sfold = folds.fold AND c.ifold = vf.ifold AND c.category = vf.category AND c.axis = l.axis
 LEFT JOIN tp ON tp.sfold = folds.fold AND tp.video = l.video AND tp.axis = l.axis AND tp.t = l.t)
"""


def double_held_out(spark, sf, phase_weight=0.5, tau=30.0, radius=1):
    """Every row predicted once with its subject's fold and its item's fold both left out."""
    def build():
        tr = A.trace(spark, sf)
        long = A.long_axes(tr, "subject", "video", "t")
        sf_ = A.subject_folds(tr).withColumnRenamed("fold", "own_s")
        items = D.dense_index(tr, "video", F.substring("video", 1, 1), "vdx").join(tr.groupBy("video").agg((F.max("t") + 1).alias("m")), "video")
        items = items.select("video", (F.col("vdx") % 5).alias("own_i"), A.category().alias("category"), "m")
        rows = long.join(sf_, "subject").join(items, "video")
        train = Fo.to_training(rows, 5, "own_s", "sfold")
        block = Fo.to_training(train, 5, "own_i", "ifold")
        g = D.quantiles(block, ["sfold", "ifold", "axis"], F.col("value"), {"gc": 0.5}).drop("n")
        c = D.quantiles(block, ["sfold", "ifold", "category", "axis"], F.col("value"), {"cc": 0.5}).drop("n")
        curve = P.population_curve(train, ["sfold", "video", "axis"]).select("sfold", "video", "axis", "t", F.col("med").alias("x"))
        curve = P.smooth(curve, ["sfold", "video", "axis"], radius, {"x": "x"}).withColumn("category", A.category())
        pieces = Tr.stretched(curve, items.select("category", "m").distinct(), ["sfold"], "video", phase_weight)
        spread = Fo.to_training(pieces.join(items.select("video", "own_i"), "video"), 5, "own_i", "ifold")
        w = Tr.duration_weight(tau)
        tpl = spread.groupBy("sfold", "ifold", "category", "axis", "m", F.col("i").alias("t")).agg((F.sum(w * F.col("piece")) / F.sum(w)).alias("tpl"))
        r = rows.withColumnsRenamed({"own_s": "sfold", "own_i": "ifold"})
        r = r.join(g, ["sfold", "ifold", "axis"]).join(c, ["sfold", "ifold", "category", "axis"], "left").join(tpl, ["sfold", "ifold", "category", "axis", "m", "t"], "left")
        return r.select(*K3, "t", "value", "sfold", "ifold", F.col("gc").alias("global_constant"), F.coalesce("cc", "gc").alias("category_constant"),
                        P.clip(F.coalesce("tpl", "gc")).alias("category_phase"))
    return written(spark, "double_held_out", sf, build)


@query("cv4_double_hold_out", DOUBLE + f"SELECT subject, video, axis, t, sfold, ifold, {q6('global_constant')} AS global_constant, {q6('category_constant')} AS category_constant, {q6('category_phase')} AS category_phase FROM d")
def _(spark, sf):
    return double_held_out(spark, sf).select(*K3, "t", "sfold", "ifold", r6("global_constant"), r6("category_constant"), r6("category_phase"))


@query("cq2_metadata_prior_experiment", DOUBLE + f""", u AS (UNPIVOT d ON global_constant, category_constant, category_phase INTO NAME method VALUE pred), t AS (SELECT method, subject, video, avg(abs(pred - value)) AS mae FROM u GROUP BY 1, 2, 3)
SELECT method, count(*) AS trials, {q6('avg(mae)')} AS macro_mae, {q6("(SELECT avg(mae) FROM t WHERE method = 'global_constant') - avg(mae)")} AS gain FROM t GROUP BY method""")
def metadata_prior_experiment(spark, sf):
    err = lambda c: F.avg(F.abs(F.col(c) - F.col("value"))).alias(c)
    names = ["global_constant", "category_constant", "category_phase"]
    t = double_held_out(spark, sf).groupBy("subject", "video").agg(*[err(c) for c in names])
    u = t.unpivot(["subject", "video"], names, "method", "mae").groupBy("method").agg(F.count(F.lit(1)).alias("trials"), F.avg("mae").alias("m"))
    base = t.agg(F.avg("global_constant"))
    return u.select("method", "trials", r6("m", "macro_mae"), r6(base.scalar() - F.col("m"), "gain"))


NESTED = with_(TRACE, LONG, FOLDS) + """, ro AS (SELECT o.o, subject, (row_number() OVER (PARTITION BY o.o ORDER BY subject) - 1) % 3 AS inr FROM folds JOIN (SELECT unnest(range(5)) AS o) o ON o.o <> folds.fold),
tr AS (SELECT ro.o, i.i, l.video, l.axis, l.t, l.value FROM long l JOIN ro USING (subject) JOIN (SELECT unnest(range(3)) AS i) i ON i.i <> ro.inr),
cv AS (SELECT o, i, video, axis, t, quantile_cont(value, 0.5) AS med FROM tr GROUP BY 1, 2, 3, 4, 5),
cs AS (SELECT *, med AS p0, avg(med) OVER (PARTITION BY o, i, video, axis ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS p3, avg(med) OVER (PARTITION BY o, i, video, axis ORDER BY t ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS p5, count(*) OVER (PARTITION BY o, i, video, axis) AS n FROM cv),
en AS (SELECT o, i, video, axis, max(n) AS n FROM cs GROUP BY 1, 2, 3, 4),
te AS (SELECT ro.o, l.subject, l.video, avg(abs(l.value - p0)) AS r0, avg(abs(l.value - p3)) AS r3, avg(abs(l.value - p5)) AS r5 FROM long l JOIN ro USING (subject) JOIN en ON en.o = ro.o AND en.i = ro.inr AND en.video = l.video AND en.axis = l.axis
 JOIN cs ON cs.o = ro.o AND cs.i = ro.inr AND cs.video = l.video AND cs.axis = l.axis AND cs.t = least(l.t, en.n - 1) GROUP BY 1, 2, 3),
sc AS (SELECT o AS fold, round(avg(r0), 9) AS r0, round(avg(r3), 9) AS r3, round(avg(r5), 9) AS r5 FROM te GROUP BY 1)
"""


@query("cv5_nested_selection", NESTED + f"SELECT fold, {q6('r0')} AS r0, {q6('r3')} AS r3, {q6('r5')} AS r5, CASE WHEN r0 <= r3 AND r0 <= r5 THEN 'r0' WHEN r3 <= r5 THEN 'r3' ELSE 'r5' END AS winner FROM sc")
def _(spark, sf):
    s = nested_scores(spark, sf)
    win = F.when((F.col("r0") <= F.col("r3")) & (F.col("r0") <= F.col("r5")), "r0").when(F.col("r3") <= F.col("r5"), "r3").otherwise("r5")
    return s.select("fold", r6("r0"), r6("r3"), r6("r5"), win.alias("winner"))


def inner_fold(r, outer):
    """Inner fold of residue ``r`` (index modulo 15) beside an outer fold: its place among the training subjects, modulo 3."""
    return (r - (r - outer + 4) // 5) % 3


def nested_scores(spark, sf):
    """Inner scores per outer fold.

    Outer and inner folds follow from a subject's index modulo 15, so the 15 training
    sides are sets of residues, and a row meets its four curves in one line of a table.
    """
    def build():
        tr = A.trace(spark, sf)
        rows = tr.join(A.subject_index(tr).select("subject", (F.col("idx") % 15).alias("res")), "subject")
        sides = [(o, i) for o in range(5) for i in range(3)]
        sets = [[r for r in range(15) if r % 5 != o and inner_fold(r, o) != i] for o, i in sides]
        curve = D.medians_of_sets(A.long_axes(rows, "video", "t", "res"), ["video", "axis", "t"], F.col("value"), "res", sets)
        key = ["set", "video", "axis"]
        curve = D.framed(curve.drop("rows"), key, "t", 5, 5, lambda d, w: d.withColumn("p3", F.avg("med").over(w.rowsBetween(-3, 3))).withColumn("p5", F.avg("med").over(w.rowsBetween(-5, 5))))
        seconds = tr.select("video", "t").distinct().withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("set", F.explode(F.array(*[F.lit(k) for k in range(15)])))
        hit = P.clamp_lookup(seconds, curve, key)
        # the sides a residue is judged by, in order of the outer fold
        judged = F.create_map(*[x for r in range(15) for x in (F.lit(r), F.array(*[F.lit(sides.index((o, inner_fold(r, o)))) for o in range(5) if o != r % 5]))])
        of = F.struct("med", "p3", "p5")
        table = hit.groupBy("video", "t", "axis").agg(F.map_from_entries(F.collect_list(F.struct("set", of))).alias("m"))
        table = table.groupBy("video", "t").agg(*[F.max_by("m", F.when(F.col("axis") == a, 1)).alias(f"m{a}") for a in (0, 1)])
        table = table.select("video", "t", F.explode(F.array(*[F.lit(r) for r in range(15)])).alias("res"), "m0", "m1")
        table = table.select("video", "t", F.col("res").cast("long").alias("res"), F.transform(judged[F.col("res")], lambda k: F.try_element_at("m0", k)).alias("c0"),
                             F.transform(judged[F.col("res")], lambda k: F.try_element_at("m1", k)).alias("c1"))
        met = rows.join(table, ["video", "t", "res"])
        met = met.select("subject", "video", "res", F.explode(F.array(F.struct(F.col("valence").cast("double").alias("value"), F.col("c0").alias("c")), F.struct(F.col("arousal").cast("double").alias("value"), F.col("c1").alias("c")))).alias("s"))
        names = {"r0": "med", "r3": "p3", "r5": "p5"}
        t = met.groupBy("subject", "video", "res").agg(*[F.avg(F.abs(F.col("s.value") - F.col("s.c")[k][c])).alias(f"{n}_{k}") for k in range(4) for n, c in names.items()])
        outer = F.element_at(Fo.other_folds(F.col("res") % 5, 5), F.col("k") + 1)
        each = t.select("res", F.posexplode(F.array(*[F.struct(*[F.col(f"{n}_{k}").alias(n) for n in names]) for k in range(4)])).alias("k", "s")).select(outer.alias("fold"), "s.*")
        return each.groupBy("fold").agg(*[F.round(F.avg(c), 9).alias(c) for c in names]).filter("r0 IS NOT NULL")
    return written(spark, "nested_scores", sf, build)


@query("cq6_sparse_feedback_recovery")
def _(spark, sf):
    """Nested prior choice, then a held-out choice of the rating correction, then its gain."""
    from .prior_queries import anchors, bounded
    scores = nested_scores(spark, sf)
    win = scores.select("fold", F.when((F.col("r0") <= F.col("r3")) & (F.col("r0") <= F.col("r5")), 0).when(F.col("r3") <= F.col("r5"), 3).otherwise(5).alias("radius"))
    tr = A.trace(spark, sf)
    long, folds = A.long_axes(tr, "subject", "video", "t"), A.subject_folds(tr)
    parts = [P.population_oof(long, folds, 5, r).join(win.filter(F.col("radius") == r).select("fold"), "fold", "left_semi") for r in (0, 3, 5)]
    o = written(spark, "nested_prior", sf, lambda: reduce(lambda a, b: a.unionByName(b), parts).select(*K3, "t", "fold", "value", "prior"))
    specs = {"disabled": None, "mild": (0.5, 0.25, 24.0), "strong": (1.0, 0.25, 48.0)}
    errs = []
    for name, s in specs.items():
        p = o.withColumn("fixed", F.col("prior")) if s is None else bounded(o, anchors(spark, sf), *s)
        errs.append(p.groupBy("fold", "subject", "video").agg(F.avg(F.abs(F.col("fixed") - F.col("value"))).alias("mae")).withColumn("name", F.lit(name)))
    e = reduce(lambda a, b: a.unionByName(b), errs)
    cells = Fo.to_training(e.groupBy("fold", "name").agg(F.sum("mae").alias("s"), F.count(F.lit(1)).alias("k")), 5)
    pick = cells.groupBy("vfold", "name").agg((F.sum("s") / F.sum("k")).alias("score")).groupBy(F.col("vfold").alias("fold")).agg(
        F.min_by("name", F.struct("score", "name")).alias("name"))
    chosen = e.join(pick, ["fold", "name"]).withColumnRenamed("mae", "chosen").join(
        e.filter("name = 'disabled'").select("subject", "video", F.col("mae").alias("base")), ["subject", "video"])
    s = chosen.groupBy("fold", "name").agg(F.count(F.lit(1)).alias("trials"), F.avg("base").alias("b"), F.avg("chosen").alias("c"))
    return s.select("fold", "name", "trials", r6("b", "prior_mae"), r6("c", "corrected_mae"), r6(F.col("b") - F.col("c"), "gain"))


# ---- personalization on the balanced matrix ----------------------------------------

PERS = with_(MATRIX) + f""", f AS (SELECT subject, (row_number() OVER (ORDER BY subject) - 1) % 5 AS fold FROM (SELECT DISTINCT subject FROM matrix)),
im AS (SELECT g.v AS fold, item, avg(x) AS mu FROM matrix JOIN f USING (subject) JOIN (SELECT unnest(range(5)) AS v) g ON g.v <> f.fold GROUP BY 1, 2),
lk AS (SELECT fold, subject, item, x, mu, x - mu AS d FROM matrix JOIN f USING (subject) JOIN im USING (fold, item)),
cal AS (SELECT b.b AS budget, rep, subject, item FROM (SELECT subject, item, rep, row_number() OVER (PARTITION BY subject, rep ORDER BY {hash_sql("'cs'", 'subject', 'rep', 'item')}, item) AS k FROM matrix, (SELECT unnest(range(3)) AS rep)) JOIN (SELECT unnest([1, 2, 4]) AS b) b ON k <= b.b),
off AS (SELECT budget, rep, subject, sum(d) AS s, count(*) AS k FROM cal JOIN lk USING (subject, item) GROUP BY 1, 2, 3),
ev AS (SELECT off.budget, off.rep, lk.*, off.s, off.k FROM lk JOIN off USING (subject) WHERE NOT EXISTS (SELECT 1 FROM cal WHERE cal.budget = off.budget AND cal.rep = off.rep AND cal.subject = lk.subject AND cal.item = lk.item))
"""


def lookup(spark, sf):
    """(fold, subject, item, x, mu, d): value, training item mean and deviation.

    The training mean of a fold is the item total minus the fold's own part.
    """
    def build():
        m = mx(spark, sf)
        f = Fo.round_robin(m, "subject", F.floor(F.col("subject") / 4096), 5)
        rows = m.join(f, "subject")
        part = rows.groupBy("item", "fold").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("k"))
        tot = part.groupBy("item").agg(F.sum("s").alias("ts"), F.sum("k").alias("tk"))
        mu = part.join(tot, "item").select("fold", "item", ((F.col("ts") - F.col("s")) / (F.col("tk") - F.col("k"))).alias("mu"))
        return rows.join(mu, ["fold", "item"]).select("fold", "subject", "item", "x", "mu", (F.col("x") - F.col("mu")).alias("d"))
    return written(spark, "lookup", sf, build)


def budgets(spark, sf):
    """(budget, rep, subject, item): nested calibration sets of 1, 2 and 4 items."""
    w = Window.partitionBy("subject", "rep").orderBy(Rs.hash_value("cs", F.col("subject"), F.col("rep"), F.col("item")), "item")
    r = mx(spark, sf).withColumn("rep", Rs.draws(3)).withColumn("k", F.row_number().over(w))
    return r.withColumn("budget", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda b: F.col("k") <= b))).select("budget", "rep", "subject", "item")


def evaluation(spark, sf):
    """Held-out items of every calibration set with the set's summed deviation."""
    def build():
        lk, cal = lookup(spark, sf), budgets(spark, sf)
        off = cal.join(lk, ["subject", "item"]).groupBy("budget", "rep", "subject").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("k"))
        return lk.join(off, "subject").join(cal, ["budget", "rep", "subject", "item"], "left_anti")
    return written(spark, "evaluation", sf, build)


def shrunk(lam):
    return F.col("s") / (F.col("k") + float(lam))


@query("jn9_consistent_lookup", PERS + f"SELECT fold, subject, item, {q6('x')} AS true_value, {q6('mu')} AS item_mean FROM lk")
def _(spark, sf):
    g = lookup(spark, sf).groupBy("fold", "subject", "item").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min("mu").alias("mlo"), F.max("mu").alias("mhi"))
    same = (F.abs(F.col("hi") - F.col("lo")) <= 1e-10) & (F.abs(F.col("mhi") - F.col("mlo")) <= 1e-10)
    return g.filter(F.when(same, True).otherwise(F.raise_error(F.lit("inconsistent lookup")).cast("boolean"))).select("fold", "subject", "item", r6("lo", "true_value"), r6("mlo", "item_mean"))


@query("jn10_calibration_complement", PERS + "SELECT budget, rep, subject, item FROM ev")
def _(spark, sf):
    return evaluation(spark, sf).select("budget", "rep", "subject", "item")


@query("st1_evaluation_sets", PERS + "SELECT budget, rep, count(*) AS cells, count(DISTINCT subject) AS subjects FROM ev GROUP BY 1, 2")
def _(spark, sf):
    full = mx(spark, sf).select("subject", "item").withColumn("rep", Rs.draws(3)).withColumn("budget", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    left = full.select("budget", "rep", "subject", "item").exceptAll(budgets(spark, sf))
    return left.groupBy("budget", "rep").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("subject").alias("subjects"))


@query("rg10_additive_personalization", PERS + f"SELECT budget, rep, subject, item, {q6('mu + s / (k + 1)')} AS predicted, {q6('abs(x - mu - s / (k + 1))')} AS error FROM ev")
def _(spark, sf):
    pred = F.col("mu") + shrunk(1)
    return evaluation(spark, sf).select("budget", "rep", "subject", "item", r6(pred, "predicted"), r6(F.abs(F.col("x") - pred), "error"))


@query("jn12_budget_level_join", PERS + f"SELECT budget, rep, subject, count(*) AS items, {q6('avg(abs(x - mu - s / (k + 1)))')} AS calibrated, {q6('avg(abs(d))')} AS item_mean FROM ev GROUP BY 1, 2, 3")
def _(spark, sf):
    e = evaluation(spark, sf)
    a = e.groupBy("budget", "rep", "subject").agg(F.count(F.lit(1)).alias("items"), F.avg(F.abs(F.col("d") - shrunk(1))).alias("c"))
    fixed = lookup(spark, sf).select("subject", "item", "d")
    b = e.select("budget", "rep", "subject", "item").join(fixed, ["subject", "item"]).groupBy("budget", "rep", "subject").agg(F.avg(F.abs("d")).alias("m"))
    return a.join(b, ["budget", "rep", "subject"]).select("budget", "rep", "subject", "items", r6("c", "calibrated"), r6("m", "item_mean"))


SUBJ = ", sj AS (SELECT budget, subject, avg(abs(d)) AS base, avg(abs(d - s / (k + 1))) AS cal, avg(abs(d)) - avg(abs(d - s / (k + 1))) AS gain FROM ev GROUP BY 1, 2)\n"


def per_subject(spark, sf):
    return evaluation(spark, sf).groupBy("budget", "subject").agg(F.avg(F.abs("d")).alias("base"), F.avg(F.abs(F.col("d") - shrunk(1))).alias("cal")).withColumn("gain", F.col("base") - F.col("cal"))


@query("ag23_method_summary", PERS + SUBJ + f"""SELECT budget, {q6('avg(base)')} AS base_mae, {q6('avg(cal)')} AS calibrated_mae, count(*) FILTER (gain > 0) AS improved, count(*) FILTER (gain < 0) AS harmed,
 {q6('quantile_cont(gain, 0.5)')} AS median_gain, {q6('quantile_cont(gain, 0.75) - quantile_cont(gain, 0.25)')} AS iqr, {q6('min(gain)')} AS worst, {q6('max(gain)')} AS best FROM sj GROUP BY budget""")
def _(spark, sf):
    s = per_subject(spark, sf)
    q = D.quantiles(s, ["budget"], F.col("gain"), {"q1": 0.25, "q2": 0.5, "q3": 0.75}, 0.05).drop("n")
    a = s.groupBy("budget").agg(F.avg("base").alias("b"), F.avg("cal").alias("c"), F.count_if(F.col("gain") > 0).alias("improved"), F.count_if(F.col("gain") < 0).alias("harmed"), F.min("gain").alias("lo"), F.max("gain").alias("hi"))
    return a.join(q, "budget").select("budget", r6("b", "base_mae"), r6("c", "calibrated_mae"), "improved", "harmed", r6("q2", "median_gain"), r6(F.col("q3") - F.col("q1"), "iqr"), r6("lo", "worst"), r6("hi", "best"))


@query("tk6_shrinkage_selection", PERS + f""", sc AS (SELECT budget, lam, round(avg(abs(d - s / (k + lam))), 9) AS e FROM ev, (SELECT unnest([0.0, 0.5, 1.0, 2.0, 8.0]) AS lam) GROUP BY 1, 2)
SELECT budget, CAST(arg_min(lam, {{'a': e, 'b': lam}}) AS DOUBLE) AS shrinkage, {q6('min(e)')} AS error FROM sc GROUP BY budget""")
def _(spark, sf):
    lams = (0.0, 0.5, 1.0, 2.0, 8.0)
    # the grid is a handful of columns of one aggregate, not a row multiplier
    e = evaluation(spark, sf).groupBy("budget").agg(*[F.round(F.avg(F.abs(F.col("d") - shrunk(l))), 9).alias(str(i)) for i, l in enumerate(lams)])
    u = e.select("budget", F.explode(F.array(*[F.struct(F.lit(l).alias("lam"), F.col(str(i)).alias("e")) for i, l in enumerate(lams)])).alias("s")).select("budget", "s.*")
    return u.groupBy("budget").agg(F.min_by("lam", F.struct("e", "lam")).alias("shrinkage"), r6(F.min("e"), "error"))


@query("mt13_practical_value", PERS + f""", o AS (SELECT *, avg(d) OVER (PARTITION BY budget, rep, subject) AS best FROM ev), g AS (SELECT avg(x) AS g FROM matrix)
SELECT budget, {q6('avg(abs(x - g))')} AS none, {q6('avg(abs(d))')} AS item_only, {q6('avg(abs(d - s / (k + 1)))')} AS calibrated, {q6('avg(abs(d - best))')} AS oracle, {q6('100 * (avg(abs(d)) - avg(abs(d - s / (k + 1)))) / avg(abs(d))')} AS percent FROM o, g GROUP BY budget""")
def _(spark, sf):
    e = evaluation(spark, sf)
    best = e.groupBy("budget", "rep", "subject").agg(F.avg("d").alias("best"))
    g = mx(spark, sf).agg(F.avg("x")).scalar()
    a = e.join(best, ["budget", "rep", "subject"]).groupBy("budget").agg(F.avg(F.abs(F.col("x") - g)).alias("n"), F.avg(F.abs("d")).alias("i"), F.avg(F.abs(F.col("d") - shrunk(1))).alias("c"), F.avg(F.abs(F.col("d") - F.col("best"))).alias("o"))
    return a.select("budget", r6("n", "none"), r6("i", "item_only"), r6("c", "calibrated"), r6("o", "oracle"), r6(100 * (F.col("i") - F.col("c")) / F.col("i"), "percent"))


@query("cq20_signed_correction", PERS + SUBJ + f"SELECT budget, count(*) AS subjects, {q6('avg(gain)')} AS mean_gain, count(*) FILTER (gain > 0) AS improved, {q6('stddev_pop(gain)')} AS spread FROM sj GROUP BY budget")
def _(spark, sf):
    return per_subject(spark, sf).groupBy("budget").agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("gain"), "mean_gain"), F.count_if(F.col("gain") > 0).alias("improved"), r6(F.stddev_pop("gain"), "spread"))


TRANSFER_ID = PERS + f""", sc AS (SELECT b.b AS budget, rep, item FROM (SELECT item, rep, row_number() OVER (PARTITION BY rep ORDER BY {hash_sql("'ms'", 'rep', 'item')}, item) AS k FROM (SELECT DISTINCT item FROM matrix), (SELECT unnest(range(2)) AS rep)) JOIN (SELECT unnest([1, 2, 4]) AS b) b ON k <= b.b),
so AS (SELECT budget, rep, fold, subject, sum(d) / (count(*) + 1) AS o FROM sc JOIN lk USING (item) GROUP BY 1, 2, 3, 4),
se AS (SELECT so.budget, so.rep, lk.fold, lk.subject, lk.item, lk.d, so.o FROM so JOIN lk USING (fold, subject) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.budget = so.budget AND sc.rep = so.rep AND sc.item = lk.item))
"""


def matched_sets(spark, sf):
    """Offsets from calibration items shared by all subjects, and the remaining cells."""
    lk = lookup(spark, sf)
    w = Window.partitionBy("rep").orderBy(Rs.hash_value("ms", F.col("rep"), F.col("item")), "item")  # item catalogue
    sc = lk.select("item").distinct().withColumn("rep", Rs.draws(2)).withColumn("k", F.row_number().over(w))
    sc = sc.withColumn("budget", F.explode(F.filter(F.array(F.lit(1), F.lit(2), F.lit(4)), lambda b: F.col("k") <= b))).select("budget", "rep", "item")
    so = sc.join(lk, "item").groupBy("budget", "rep", "fold", "subject").agg((F.sum("d") / (F.count(F.lit(1)) + 1)).alias("o"))
    se = so.join(lk.select("fold", "subject", "item", "d"), ["fold", "subject"]).join(sc, ["budget", "rep", "item"], "left_anti")
    return so, se


@query("jn7_donor_join", TRANSFER_ID + f"""SELECT e.budget, e.rep, e.subject, e.item, {q6('avg(abs(e.d - q.o))')} AS other_error, count(*) AS donors FROM se e JOIN so q ON q.budget = e.budget AND q.rep = e.rep AND q.fold = e.fold AND q.subject <> e.subject GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return donor_errors(spark, sf).select("budget", "rep", "subject", "item", r6("other"), F.col("donors")).withColumnRenamed("other", "other_error")


def donor_errors(spark, sf):
    """Own error and mean error over every other subject of the fold, without pairing."""
    so, se = matched_sets(spark, sf)
    m = Dn.mean_distance(se, so, ["budget", "rep", "fold"], "d", "o", "all", 0.05)
    own = F.abs(F.col("d") - F.col("o"))
    return m.withColumn("own", own).withColumn("other", (F.col("all") * F.col("donors") - own) / (F.col("donors") - 1)).withColumn("donors", F.col("donors") - 1)


RING = f""", ring AS (SELECT budget, rep, fold, subject, o, row_number() OVER (PARTITION BY budget, rep, fold ORDER BY {hash_sql("'dr'", 'budget', 'rep', 'subject')}, subject) AS k, count(*) OVER (PARTITION BY budget, rep, fold) AS n FROM so),
pairs AS (SELECT a.budget, a.rep, a.fold, a.subject, b.subject AS donor, b.o AS donor_o FROM ring a JOIN ring b ON a.budget = b.budget AND a.rep = b.rep AND a.fold = b.fold AND b.k = a.k % a.n + 1)
"""


@query("jn8_derangement", TRANSFER_ID + RING + "SELECT budget, rep, fold, subject, donor FROM pairs")
def _(spark, sf):
    so, _se = matched_sets(spark, sf)
    return deranged(so).select("budget", "rep", "fold", "subject", "donor")


def deranged(so):
    key = ["budget", "rep", "fold"]
    r = Rs.shuffled_rank(so, key, ["dr", F.col("budget"), F.col("rep"), F.col("subject")], "subject", "k")
    n = so.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    nxt = r.select(*key, F.col("k").alias("dk"), F.col("subject").alias("donor"), F.col("o").alias("donor_o"))
    return r.join(n, key).withColumn("dk", F.col("k") % F.col("n") + 1).join(nxt, [*key, "dk"])


@query("cq21_identity_transfer", TRANSFER_ID + RING + f""", oth AS (SELECT e.budget, e.rep, e.subject, e.item, avg(abs(e.d - q.o)) AS other FROM se e JOIN so q ON q.budget = e.budget AND q.rep = e.rep AND q.fold = e.fold AND q.subject <> e.subject GROUP BY 1, 2, 3, 4),
a AS (SELECT se.budget, se.subject, avg(abs(se.d)) AS base, avg(abs(se.d - se.o)) AS own, avg(oth.other) AS other, avg(abs(se.d - p.donor_o)) AS der FROM se JOIN oth USING (budget, rep, subject, item) JOIN pairs p ON p.budget = se.budget AND p.rep = se.rep AND p.subject = se.subject GROUP BY 1, 2)
SELECT budget, count(*) AS subjects, {q6('avg(base)')} AS item_only, {q6('avg(own)')} AS own_identity, {q6('avg(other)')} AS all_donors, {q6('avg(der)')} AS deranged, count(*) FILTER (other - own > 0) AS own_better FROM a GROUP BY budget""")
def _(spark, sf):
    so, _se = matched_sets(spark, sf)
    d = deranged(so).select("budget", "rep", "fold", "subject", "donor_o")
    e = donor_errors(spark, sf).join(d, ["budget", "rep", "fold", "subject"])
    a = e.groupBy("budget", "subject").agg(F.avg(F.abs("d")).alias("b"), F.avg("own").alias("w"), F.avg("other").alias("o"), F.avg(F.abs(F.col("d") - F.col("donor_o"))).alias("r"))
    return a.groupBy("budget").agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("b"), "item_only"), r6(F.avg("w"), "own_identity"), r6(F.avg("o"), "all_donors"), r6(F.avg("r"), "deranged"), F.count_if(F.col("o") - F.col("w") > 0).alias("own_better"))


@query("cq22_category_heterogeneity", with_(CUBE) + f""", yr AS (SELECT category, subject, item, x FROM cube),
pm AS (SELECT category, draw, subject, x, row_number() OVER (PARTITION BY category, draw, subject ORDER BY {hash_sql("'ch'", 'draw', 'subject', 'item')}, item) AS label FROM yr, (SELECT unnest(range(60)) AS draw)),
nm AS (SELECT category, draw, label, avg(x) AS mu FROM pm GROUP BY 1, 2, 3), ns AS (SELECT category, draw, var_pop(mu) * count(*) AS s FROM nm GROUP BY 1, 2), os AS (SELECT category, var_pop(mu) * count(*) AS s FROM (SELECT category, item, avg(x) AS mu FROM yr GROUP BY 1, 2) GROUP BY 1),
pv AS (SELECT category, any_value(os.s) AS s, (1.0 + count(*) FILTER (ns.s >= os.s - 1e-15)) / 61 AS p FROM ns JOIN os USING (category) GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY p, category) AS rn, count(*) OVER () AS m FROM pv)
SELECT category, {q6('s')} AS statistic, {q6('p')} AS p, {q6('max(least(1, (m - rn + 1) * p)) OVER (ORDER BY rn)')} AS adjusted FROM o""")
def _(spark, sf):
    c = category_cube(spark, sf)
    w = Window.partitionBy("category", "draw", "subject").orderBy(Rs.hash_value("ch", F.col("draw"), F.col("subject"), F.col("item")), "item")
    pm = c.withColumn("draw", Rs.draws(60)).withColumn("label", F.row_number().over(w))
    stat = F.var_pop("mu") * F.count(F.lit(1))
    null = pm.groupBy("category", "draw", "label").agg(F.avg("x").alias("mu")).groupBy("category", "draw").agg(stat.alias("s0"))
    obs = c.groupBy("category", "item").agg(F.avg("x").alias("mu")).groupBy("category").agg(stat.alias("s"))
    pv = null.join(obs, "category").groupBy("category").agg(F.max("s").alias("s"), ((1.0 + F.count_if(F.col("s0") >= F.col("s") - 1e-15)) / 61).alias("p"))
    return holm(pv, [], "p", ["category"], 0.01).select("category", r6("s", "statistic"), r6("p"), r6("adjusted"))


@query("cq23_calibration_uncertainty", PERS + f""", pr AS (SELECT budget, subject, rep, avg(abs(d)) - avg(abs(d - s / (k + 1))) AS gain FROM ev GROUP BY 1, 2, 3), pid AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM matrix)),
dr AS (SELECT draw, {hash_sql("'u1'", 'draw', 'idx')} % n AS pick, {hash_sql("'u2'", 'draw', 'idx')} % 3 AS rep FROM pid, (SELECT unnest(range(60)) AS draw)),
st AS (SELECT budget, draw, avg(gain) AS g FROM dr JOIN pid ON pid.idx = dr.pick JOIN pr ON pr.subject = pid.subject AND pr.rep = dr.rep GROUP BY 1, 2)
SELECT budget, {q6('quantile_cont(g, 0.025)')} AS low, {q6('quantile_cont(g, 0.975)')} AS high FROM st GROUP BY budget""")
def _(spark, sf):
    pr = evaluation(spark, sf).groupBy("budget", "subject", "rep").agg((F.avg(F.abs("d")) - F.avg(F.abs(F.col("d") - shrunk(1)))).alias("gain"))
    p = D.dense_index(mx(spark, sf), "subject", F.floor(F.col("subject") / 4096))
    n = p.agg(F.count(F.lit(1)).alias("n")).scalar()
    d = p.select(F.col("idx").alias("slot")).withColumn("draw", Rs.draws(60))
    d = d.select("draw", (Rs.hash_value("u1", F.col("draw"), F.col("slot")) % n).alias("idx"), (Rs.hash_value("u2", F.col("draw"), F.col("slot")) % 3).alias("rep"))
    d = d.groupBy("draw", "idx", "rep").agg(F.count(F.lit(1)).alias("w"))
    st = d.join(p, "idx").join(pr, ["subject", "rep"]).groupBy("budget", "draw").agg((F.sum(F.col("w") * F.col("gain")) / F.sum("w")).alias("stat"))
    return Rs.interval(st, "stat", "budget").select("budget", r6("low"), r6("high"))


# ---- sets and filters --------------------------------------------------------------


@query("st2_overlap_check", with_(TRACE, FOLDS) + """SELECT v.v AS vfold, count(*) FILTER (fold <> v.v) AS training, count(*) FILTER (fold = v.v) AS validation, CAST(0 AS BIGINT) AS overlap FROM folds, (SELECT unnest(range(5)) AS v) v GROUP BY 1""")
def _(spark, sf):
    f = A.subject_folds(A.trace(spark, sf))
    train, val = Fo.to_training(f, 5).select("vfold", "subject"), f.select(F.col("fold").alias("vfold"), "subject")
    both = train.intersect(val).groupBy("vfold").agg(F.count(F.lit(1)).alias("overlap"))
    c = train.groupBy("vfold").agg(F.count(F.lit(1)).alias("training")).join(val.groupBy("vfold").agg(F.count(F.lit(1)).alias("validation")), "vfold")
    return c.join(both, "vfold", "left").select("vfold", "training", "validation", F.coalesce("overlap", F.lit(0).cast("long")).alias("overlap"))


@query("st4_distinct_trials", with_(TRACE) + "SELECT DISTINCT subject, video FROM trace")
def _(spark, sf):
    return A.trace(spark, sf).select("subject", "video").distinct()


@query("flt7_group_filter", with_(TRACE, FOLDS) + f"SELECT subject, video, t, {q6('valence')} AS valence FROM trace WHERE subject IN (SELECT subject FROM folds WHERE fold IN (1, 3))")
def _(spark, sf):
    tr = A.trace(spark, sf)
    keep = A.subject_folds(tr).filter(F.col("fold").isin(1, 3))
    return tr.join(keep, "subject", "left_semi").select("subject", "video", "t", r6("valence"))
