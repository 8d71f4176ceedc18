"""Resampling, population family, category transfer, anchors and selection."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distributed as D
from ..operators import folds as Fo
from ..operators import metrics as M
from ..operators import neighbours as N
from ..operators import priors as P
from ..operators import transfer as Tr
from ..sources import adapters as A
from ..sources.shared import written
from .base_queries import OOF_ALL, TRAIN, long_rows, oof
from .registry import CATEGORY, FOLDS, LONG, TRACE, q6, query, r6, with_

K3 = ["subject", "video", "axis"]
CURVE = "curve AS (SELECT video, axis, t, quantile_cont(value, 0.5) AS x FROM long GROUP BY 1, 2, 3)"
LEN = "len AS (SELECT video, axis, max(t) + 1 AS n FROM curve GROUP BY 1, 2)"


def curves(spark, sf):
    return written(spark, "curves", sf, lambda: P.population_curve(long_rows(spark, sf), ["video", "axis"]).select(
        "video", "axis", "t", F.col("med").alias("x")))


def lerp(table, pos, n):
    return f"""(1 - ({pos} - floor({pos}))) * lo.x + ({pos} - floor({pos})) * hi.x"""


@query("ts1_phase_resample", with_(TRACE, LONG, CURVE, LEN) + f""", g AS (SELECT video, axis, n, i, i * (n - 1) / 15.0 AS pos FROM len, (SELECT unnest(range(16)) AS i) r)
SELECT g.video, g.axis, g.i, {q6('(1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x')} AS x FROM g
JOIN curve lo ON lo.video = g.video AND lo.axis = g.axis AND lo.t = CAST(floor(pos) AS BIGINT)
JOIN curve hi ON hi.video = g.video AND hi.axis = g.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, n - 1)""")
def _(spark, sf):
    c = curves(spark, sf)
    asked = c.select("video", "axis").distinct().withColumn("m", F.lit(16).cast("long"))
    return P.resample_phase(c, ["video", "axis"], asked, ["x"]).select("video", "axis", "i", r6("x"))


@query("ts2_absolute_resample", with_(TRACE, LONG, CURVE, LEN) + f"""SELECT len.video, len.axis, i, {q6('x')} AS x FROM len, (SELECT unnest(range(40)) AS i) r
JOIN curve c ON c.video = len.video AND c.axis = len.axis AND c.t = least(i, n - 1)""")
def _(spark, sf):
    c = curves(spark, sf)
    grid = c.select("video", "axis").distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))))
    return P.clamp_lookup(grid.withColumn("i", F.col("t")).drop("x"), c, ["video", "axis"]).select("video", "axis", "i", r6("x"))


@query("ts3_fractional_sample", with_(TRACE, LONG, CURVE, LEN) + f""", a AS (SELECT subject, l.video, l.axis, l.t, n, least(l.t * 0.7 + 0.25, n - 1) AS pos FROM long l JOIN len ON len.video = l.video AND len.axis = l.axis)
SELECT a.subject, a.video, a.axis, a.t, {q6('(1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x')} AS x FROM a
JOIN curve lo ON lo.video = a.video AND lo.axis = a.axis AND lo.t = CAST(floor(pos) AS BIGINT)
JOIN curve hi ON hi.video = a.video AND hi.axis = a.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, n - 1)""")
def _(spark, sf):
    c = curves(spark, sf)
    ends = c.groupBy("video", "axis").agg((F.max("t") + 1).alias("_n"))
    asked = long_rows(spark, sf).drop("value").join(ends, ["video", "axis"]).withColumn("_pos", F.col("t") * 0.7 + 0.25)
    return P.sample_at(c, ["video", "axis"], asked, ["x"]).select(*K3, "t", r6("x"))


@query("ts4_block_resample", with_(TRACE) + f"SELECT subject, video, t // 4 AS second, {q6('avg(valence)')} AS v, count(*) AS k FROM trace GROUP BY 1, 2, 3")
def _(spark, sf):
    return A.trace(spark, sf).groupBy("subject", "video", F.floor(F.col("t") / 4).alias("second")).agg(r6(F.avg("valence"), "v"), F.count(F.lit(1)).alias("k"))


@query("ts5_baseline_subtraction", with_(TRACE) + f""", b AS (SELECT subject, video, avg(valence) AS base FROM trace WHERE t < 3 GROUP BY 1, 2)
SELECT subject, video, t, {q6('valence - base')} AS v FROM trace JOIN b USING (subject, video)""")
def _(spark, sf):
    t = A.trace(spark, sf)
    base = t.groupBy("subject", "video").agg(F.avg(F.when(F.col("t") < 3, F.col("valence"))).alias("base"), (F.max("t") + 1).alias("n"))
    return D.attach(t, base, ["subject", "video"]).select("subject", "video", "t", r6(F.col("valence") - F.col("base"), "v"))


@query("jn15_time_offset", with_(TRACE, LONG, CURVE, LEN) + f"""SELECT l.subject, l.video, l.axis, l.t, {q6('c.x')} AS shifted FROM long l JOIN len ON len.video = l.video AND len.axis = l.axis
JOIN curve c ON c.video = l.video AND c.axis = l.axis AND c.t = least(greatest(l.t - 2, 0), n - 1)""")
def _(spark, sf):
    return P.clamp_lookup(long_rows(spark, sf).drop("value"), curves(spark, sf), ["video", "axis"], -2).select(*K3, "t", r6("x", "shifted"))


@query("ts11_population_family", with_(TRACE, LONG, CURVE) + f""", s AS (SELECT video, axis, value, t + d.d AS t FROM long, (SELECT unnest(range(-2, 3)) AS d) d),
e AS (SELECT video, axis, max(t) AS m FROM curve GROUP BY 1, 2),
pooled AS (SELECT s.video, s.axis, s.t, quantile_cont(value, 0.5) AS x FROM s JOIN e ON e.video = s.video AND e.axis = s.axis WHERE s.t BETWEEN 0 AND e.m GROUP BY 1, 2, 3)
SELECT 'raw_r0' AS method, video, axis, t, {q6('x')} AS prior FROM curve
UNION ALL SELECT 'current_r3', video, axis, t, {q6('avg(x) OVER (PARTITION BY video, axis ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} FROM curve
UNION ALL SELECT 'pooled_median_r2', video, axis, t, {q6('x')} FROM pooled
UNION ALL SELECT 'triangular_r2', a.video, a.axis, a.t, {q6('sum((3 - abs(a.t - b.t)) * b.x) / sum(3 - abs(a.t - b.t))')} FROM curve a JOIN curve b ON a.video = b.video AND a.axis = b.axis AND abs(a.t - b.t) <= 2 GROUP BY 2, 3, 4""")
def _(spark, sf):
    c, key = curves(spark, sf), ["video", "axis"]
    parts = [
        ("raw_r0", c.withColumn("prior", F.col("x"))),
        ("current_r3", P.smooth(c, key, 3, {"x": "prior"})),
        ("pooled_median_r2", P.pooled_window_median(long_rows(spark, sf), key, 2).withColumnRenamed("med", "prior")),
        ("triangular_r2", P.triangular(c, key, 2, "x", "prior")),
    ]
    return reduce(lambda a, b: a.unionByName(b), [d.select(F.lit(m).alias("method"), *key, "t", r6(P.clip(F.col("prior")), "prior")) for m, d in parts])


@query("jn4_leave_one_out", with_(TRACE, LONG) + f"""SELECT a.subject, a.video, a.axis, a.t, {q6('quantile_cont(b.value, 0.5)')} AS others
FROM long a JOIN long b ON a.video = b.video AND a.axis = b.axis AND a.t = b.t AND a.subject <> b.subject GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return loo(spark, sf).select(*K3, "t", r6("others"))


def loo(spark, sf):
    """Median of the other subjects at every second (rows with none are left out)."""
    return written(spark, "loo", sf, lambda: D.leave_one_out_medians(
        long_rows(spark, sf), ["video", "axis", "t"], "value", "others").filter(F.col("others").isNotNull()))


@query("jn3_category_sources", with_(TRACE, LONG, CURVE) + f""", i AS (SELECT DISTINCT video, {CATEGORY} AS category FROM curve), n AS (SELECT video, count(*) AS seconds FROM curve WHERE axis = 0 GROUP BY 1)
SELECT a.video, a.category, count(b.video) AS sources, CAST(coalesce(sum(n.seconds), 0) AS BIGINT) AS source_seconds FROM i a LEFT JOIN i b ON a.category = b.category AND a.video <> b.video LEFT JOIN n ON n.video = b.video GROUP BY 1, 2""")
def _(spark, sf):
    # Other items of the category by totals minus the item itself, so no pairs are emitted.
    i = curves(spark, sf).filter("axis = 0").groupBy("video").agg(F.count(F.lit(1)).alias("s")).withColumn("category", A.category())
    tot = i.groupBy("category").agg(F.count(F.lit(1)).alias("k"), F.sum("s").alias("all"))
    return i.join(tot, "category").select("video", "category", (F.col("k") - 1).alias("sources"), (F.col("all") - F.col("s")).alias("source_seconds"))


TRANSFER = f"""items AS (SELECT video, axis, n, {CATEGORY} AS category FROM len),
sm AS (SELECT video, axis, t, avg(x) OVER (PARTITION BY video, axis ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM curve),
pr AS (SELECT a.video, a.axis, a.n AS m, b.video AS src, b.n AS sn, i, CASE WHEN a.n = 1 THEN 0 ELSE i * (b.n - 1) / CAST(a.n - 1 AS DOUBLE) END AS pos FROM items a JOIN items b ON a.category = b.category AND a.axis = b.axis AND a.video <> b.video, LATERAL (SELECT unnest(range(a.n)) AS i) r),
tp AS (SELECT pr.video, pr.axis, pr.i, sum(exp(-abs(sn - m) / 30.0) * (0.5 * ((1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x) + 0.5 * ab.x)) / sum(exp(-abs(sn - m) / 30.0)) AS template, count(*) AS sources
 FROM pr JOIN sm lo ON lo.video = src AND lo.axis = pr.axis AND lo.t = CAST(floor(pos) AS BIGINT) JOIN sm hi ON hi.video = src AND hi.axis = pr.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, sn - 1)
 JOIN sm ab ON ab.video = src AND ab.axis = pr.axis AND ab.t = least(i, sn - 1) GROUP BY 1, 2, 3)"""


def category_templates(curve, targets, cell, phase_weight, tau, radius):
    """Category template per target item; null where no other item exists."""
    s = P.smooth(curve, [*cell, "video", "axis"], radius, {"x": "x"}) if radius else curve
    s = s.withColumn("category", A.category())
    lengths = targets.select("category", "m").distinct()
    pieces = Tr.stretched(s.select(*cell, "video", "category", "axis", "t", "x"), lengths, cell, "video", phase_weight)
    return Tr.leave_item_out(pieces, targets, cell, tau)


@query("ts12_category_phase_prior", with_(TRACE, LONG, CURVE, LEN, TRANSFER) + f""", g AS (SELECT axis, quantile_cont(value, 0.5) AS flat FROM long GROUP BY 1)
SELECT items.video, items.axis, c.t, coalesce(tp.sources, 0) AS sources, {q6('least(greatest(coalesce(tp.template, g.flat), 1), 255)')} AS prior FROM items JOIN curve c ON c.video = items.video AND c.axis = items.axis
JOIN g ON g.axis = items.axis LEFT JOIN tp ON tp.video = items.video AND tp.axis = items.axis AND tp.i = c.t""")
def _(spark, sf):
    c = curves(spark, sf)
    flat = D.quantiles(long_rows(spark, sf), ["axis"], F.col("value"), {"flat": 0.5}).select("axis", "flat")
    targets = c.groupBy("video").agg((F.max("t") + 1).alias("m")).withColumn("category", A.category())
    tp = category_templates(c, targets, [], 0.5, 30.0, 1)
    return tp.join(flat, "axis").select("video", "axis", "t", "sources", r6(P.clip(F.coalesce("template", "flat")), "prior"))


@query("sc5_phase_absolute_blend", with_(TRACE, LONG, CURVE, LEN) + f""", g AS (SELECT video, axis, n, i, i * (n - 1) / 15.0 AS pos FROM len, (SELECT unnest(range(16)) AS i) r)
SELECT g.video, g.axis, g.i, {q6('0.25 * ((1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x) + 0.75 * ab.x')} AS blend FROM g
JOIN curve lo ON lo.video = g.video AND lo.axis = g.axis AND lo.t = CAST(floor(pos) AS BIGINT)
JOIN curve hi ON hi.video = g.video AND hi.axis = g.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, n - 1)
JOIN curve ab ON ab.video = g.video AND ab.axis = g.axis AND ab.t = least(i, n - 1)""")
def _(spark, sf):
    c = curves(spark, sf).withColumn("category", F.lit("all"))
    lengths = c.select("category").distinct().withColumn("m", F.lit(16).cast("long"))
    return Tr.stretched(c, lengths, [], "video", 0.25).select("video", "axis", "i", r6("piece", "blend"))


@query("sc9_duration_weights", with_(TRACE) + f""", l AS (SELECT subject, video, count(*) AS n FROM trace GROUP BY 1, 2), w AS (SELECT video, subject, exp(-abs(n - max(n) OVER (PARTITION BY video)) / 15.0) AS w FROM l)
SELECT video, subject, {q6('w / sum(w) OVER (PARTITION BY video) * 1000')} AS weight_permille FROM w""")
def _(spark, sf):
    l = A.trial_lengths(A.trace(spark, sf))
    top = l.groupBy("video").agg(F.max("n").alias("top"))
    w = l.join(top, "video").withColumn("w", F.exp(-F.abs(F.col("n") - F.col("top")) / 15.0))
    s = w.groupBy("video").agg(F.sum("w").alias("s"))
    return w.join(s, "video").select("video", "subject", r6(F.col("w") / F.col("s") * 1000, "weight_permille"))


@query("sc6_prior_blend", OOF_ALL + f""", g AS (SELECT axis, quantile_cont(value, 0.5) AS flat FROM long GROUP BY 1)
SELECT subject, video, axis, t, {q6('least(greatest(0.7 * flat + 0.3 * prior, 1), 255)')} AS blended FROM oof JOIN g USING (axis)""")
def _(spark, sf):
    flat = D.quantiles(long_rows(spark, sf), ["axis"], F.col("value"), {"flat": 0.5}).select("axis", "flat")
    return oof(spark, sf).join(flat, "axis").select(*K3, "t", r6(P.clip(0.7 * F.col("flat") + 0.3 * F.col("prior")), "blended"))


ANCHOR = "anchor AS (SELECT subject, video, axis, quantile_cont(value, 0.5) AS anchor FROM long GROUP BY 1, 2, 3)"


def anchors(spark, sf):
    """One rating per (trial, axis): the trial median."""
    return written(spark, "anchors", sf, lambda: D.quantiles(long_rows(spark, sf), K3, F.col("value"), {"anchor": 0.5}))


@query("jn2_anchor_join", with_(TRACE, LONG, ANCHOR) + f"""SELECT subject, video, count(*) AS seconds, {q6('max(anchor) FILTER (axis = 0)')} AS anchor_v, {q6('max(anchor) FILTER (axis = 1)')} AS anchor_a
FROM long JOIN anchor USING (subject, video, axis) WHERE anchor > 20 GROUP BY 1, 2
UNION ALL SELECT NULL, 'missing anchor', count(*), NULL, NULL FROM (SELECT DISTINCT subject, video, axis FROM long) l WHERE NOT EXISTS (SELECT 1 FROM anchor a WHERE a.subject = l.subject AND a.video = l.video AND a.axis = l.axis AND a.anchor > 20)""")
def _(spark, sf):
    long, a = long_rows(spark, sf), anchors(spark, sf).filter("anchor > 20")
    trials = long.groupBy(*K3).agg(F.count(F.lit(1)).alias("k"))
    got = trials.join(a, K3).groupBy("subject", "video").agg(
        F.sum("k").alias("seconds"), r6(F.max(F.when(F.col("axis") == 0, F.col("anchor"))), "anchor_v"),
        r6(F.max(F.when(F.col("axis") == 1, F.col("anchor"))), "anchor_a"))
    gone = trials.join(a, K3, "left_anti").agg(F.count(F.lit(1)).alias("seconds")).select(
        F.lit(None).cast("long").alias("subject"), F.lit("missing anchor").alias("video"), "seconds",
        F.lit(None).cast("double").alias("anchor_v"), F.lit(None).cast("double").alias("anchor_a"))
    return got.unionByName(gone)


BOUNDED = "bounded AS (SELECT o.*, a.anchor, least(greatest(o.prior + least(greatest(0.75 * (a.anchor - m.mid) - 0.25 * (o.prior - m.mid), -24), 24), 1), 255) AS fixed FROM oof o JOIN anchor a USING (subject, video, axis) JOIN (SELECT subject, video, axis, quantile_cont(prior, 0.5) AS mid FROM oof GROUP BY 1, 2, 3) m USING (subject, video, axis))"


def bounded(o, a, cw, sw, cap, out="fixed"):
    """Centre and shape correction toward one rating, never beyond the cap."""
    mid = D.quantiles(o, K3, F.col("prior"), {"mid": 0.5})
    j = D.attach(o, mid.join(a.select(*K3, "anchor"), K3), K3)
    step = S.clip(cw * (F.col("anchor") - F.col("mid")) - sw * (F.col("prior") - F.col("mid")), -cap, cap)
    return j.withColumn(out, P.clip(F.col("prior") + step)).drop("mid", "n")


@query("sc4_bounded_anchor", OOF_ALL + f", {ANCHOR}, {BOUNDED} SELECT subject, video, axis, t, {q6('fixed')} AS fixed FROM bounded")
def _(spark, sf):
    return bounded(oof(spark, sf), anchors(spark, sf), 0.75, 0.25, 24.0).select(*K3, "t", r6("fixed"))


@query("ts17_anchor_application", OOF_ALL + f""", {ANCHOR}, {BOUNDED} SELECT fold, count(DISTINCT concat_ws('|', subject, video)) AS trials, {q6('avg(p)')} AS prior_mae, {q6('avg(f)')} AS anchored_mae FROM (
 SELECT fold, subject, video, avg(abs(prior - value)) AS p, avg(abs(fixed - value)) AS f FROM bounded GROUP BY 1, 2, 3) GROUP BY fold""")
def _(spark, sf):
    b = bounded(oof(spark, sf), anchors(spark, sf), 0.75, 0.25, 24.0)
    t = b.groupBy("fold", "subject", "video").agg(F.avg(F.abs(F.col("prior") - F.col("value"))).alias("p"), F.avg(F.abs(F.col("fixed") - F.col("value"))).alias("f"))
    return t.groupBy("fold").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("p"), "prior_mae"), r6(F.avg("f"), "anchored_mae"))


NEAR = """near AS (SELECT subject, video, axis, who, distance FROM (SELECT a.subject, a.video, a.axis, b.subject AS who, abs(b.anchor - a.anchor) AS distance,
 row_number() OVER (PARTITION BY a.subject, a.video, a.axis ORDER BY abs(b.anchor - a.anchor), b.subject) AS k FROM anchor a JOIN anchor b ON a.video = b.video AND a.axis = b.axis AND a.subject <> b.subject) WHERE k <= 5)"""


def near5(spark, sf):
    """The five nearest other trials of the item by one rating, written once: four queries read them, one inside a large plan."""
    def build():
        near = N.nearest_on_axis(anchors(spark, sf), ["video", "axis"], "anchor", "subject", 5)
        return near.select(*K3, F.explode("near").alias("s")).select(*K3, "s.who", "s.distance")
    return written(spark, "near5", sf, build)


@query("jn5_anchor_neighbours", with_(TRACE, LONG, ANCHOR, NEAR) + f"SELECT subject, video, axis, who, {q6('distance')} AS distance FROM near")
def _(spark, sf):
    return near5(spark, sf).select(*K3, "who", r6("distance"))


@query("sc8_gaussian_weights", with_(TRACE, LONG, ANCHOR, NEAR) + f""", w AS (SELECT *, exp(-0.5 * pow(distance / 20, 2) - max(-0.5 * pow(distance / 20, 2)) OVER (PARTITION BY subject, video, axis)) AS w FROM near)
SELECT subject, video, axis, who, {q6('w / sum(w) OVER (PARTITION BY subject, video, axis)')} AS weight FROM w""")
def _(spark, sf):
    return gaussian(near5(spark, sf), 20.0).select(*K3, "who", r6("weight"))


def gaussian(near, bandwidth):
    """Normalized Gaussian weights of at most k neighbours, max-shifted."""
    from pyspark.sql import Window
    w = Window.partitionBy(*K3)
    log = -0.5 * (F.col("distance") / bandwidth) ** 2
    e = near.withColumn("_l", log).withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    return e.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_l", "_e")


@query("ts15_retrieval_prior", OOF_ALL + f""", {ANCHOR}, {NEAR}, w AS (SELECT *, exp(-0.5 * pow(distance / 20, 2)) AS w FROM near),
ret AS (SELECT w.subject, w.video, w.axis, l.t, sum(w.w * l.value) / sum(w.w) AS x FROM w JOIN long l ON l.subject = w.who AND l.video = w.video AND l.axis = w.axis GROUP BY 1, 2, 3, 4),
sm AS (SELECT subject, video, axis, t, avg(x) OVER (PARTITION BY subject, video, axis ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x FROM ret)
SELECT o.subject, o.video, o.axis, o.t, {q6('least(greatest(CASE WHEN sm.x IS NULL THEN o.prior ELSE 0.5 * o.prior + 0.5 * sm.x END, 1), 255)')} AS prior FROM oof o LEFT JOIN sm USING (subject, video, axis, t)""")
def _(spark, sf):
    w = gaussian(near5(spark, sf), 20.0)
    src = long_rows(spark, sf).select(F.col("subject").alias("who"), "video", "axis", "t", "value")
    ret = w.join(src, ["who", "video", "axis"]).groupBy(*K3, "t").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("x"))
    sm = P.smooth(ret, K3, 1, {"x": "retrieved"}).select(*K3, "t", "retrieved")
    mixed = F.when(F.col("retrieved").isNull(), F.col("prior")).otherwise(0.5 * F.col("prior") + 0.5 * F.col("retrieved"))
    return oof(spark, sf).join(sm, [*K3, "t"], "left").select(*K3, "t", r6(P.clip(mixed), "prior"))


WIDE = "wide AS (SELECT subject, video, max(anchor) FILTER (axis = 0) AS v, max(anchor) FILTER (axis = 1) AS a FROM anchor GROUP BY 1, 2)"
GAP = "sqrt((b.v - a.v) * (b.v - a.v) + (b.a - a.a) * (b.a - a.a))"
MOST = 15  # neighbours of the widest specification


def wide_anchors(spark, sf):
    """Both ratings of a trial side by side."""
    one = lambda k: F.max(F.when(F.col("axis") == k, F.col("anchor")))
    return anchors(spark, sf).groupBy("subject", "video").agg(one(0).alias("v"), one(1).alias("a"))


@query("jn5_joint_neighbours", with_(TRACE, LONG, ANCHOR, WIDE) + f"""SELECT subject, video, CAST(k AS INTEGER) AS rank, who, {q6('distance')} AS distance FROM (
 SELECT a.subject, a.video, b.subject AS who, {GAP} AS distance, row_number() OVER (PARTITION BY a.subject, a.video ORDER BY {GAP}, b.subject) AS k
 FROM wide a JOIN wide b ON a.video = b.video AND a.subject <> b.subject) WHERE k <= {MOST}""")
def _(spark, sf):
    """Other trials of the item nearest in both ratings."""
    w = wide_anchors(spark, sf)
    near = N.nearest_in_space(w, w, ["video"], ["v", "a"], "subject", MOST)
    return near.select("subject", "video", F.posexplode("near").alias("p", "s")).select("subject", "video", (F.col("p") + 1).alias("rank"), "s.who", r6("s.distance", "distance"))


# The retrieval specifications compared, as (mode, neighbours, mix, bandwidth), None for equal weights.
SPECS = (
    ("axis", 3, 0.50, None), ("axis", 5, 0.50, None), ("axis", 7, 0.75, None), ("axis", 10, 0.75, None), ("axis", 10, 1.00, None), ("axis", 15, 1.00, None),
    ("joint", 7, 0.75, None), ("joint", 10, 0.75, None), ("joint", 10, 1.00, None), ("joint", 15, 1.00, None),
    ("axis", 10, 0.50, 16.0), ("axis", 15, 0.50, 16.0), ("axis", 15, 0.75, 16.0), ("axis", 10, 0.75, 32.0), ("axis", 15, 0.75, 32.0), ("joint", 15, 0.75, 32.0),
)


def retrieval_near(spark, sf):
    """mode, fold, subject, video, axis, rank, distance, who: neighbours among the trials of the other folds."""
    folds = A.subject_folds(A.trace(spark, sf))
    exact = lambda *cs: [F.round(c, 6).alias(c) for c in cs]  # noqa: E731  ratings as released, so that equal distances are ties
    one = anchors(spark, sf).select(*K3, *exact("anchor")).join(folds, "subject")
    both = wide_anchors(spark, sf).select("subject", "video", *exact("v", "a")).join(folds, "subject")
    own = lambda x: x.withColumnRenamed("fold", "vfold")
    axis = N.nearest_in_space(Fo.to_training(one, 5), own(one), ["vfold", "video", "axis"], ["anchor"], "subject", MOST)
    joint = N.nearest_in_space(Fo.to_training(both, 5), own(both), ["vfold", "video"], ["v", "a"], "subject", MOST)
    joint = joint.withColumn("axis", F.explode(F.array(F.lit(0), F.lit(1))))
    parts = [x.select(F.lit(mode).alias("mode"), F.col("vfold").alias("fold"), "subject", "video", F.col("axis").cast("int").alias("axis"), F.posexplode("near").alias("rank", "s"))
             for mode, x in (("axis", axis), ("joint", joint))]
    return parts[0].unionByName(parts[1]).select("mode", "fold", *K3, "rank", "s.distance", "s.who")


SECONDS = 256  # seconds of a trial that meet as one array
REACH = 3  # smoothing radius of what was retrieved


def retrieved(x, d, k, h):
    """[trial, second]: median, or weighted mean, of what the k nearest did; NaN where none of them is.

    ``x`` [trial, rank, second] is NaN where a neighbour has no value, ``d``
    [trial, rank] its distance.
    """
    x, here = x[:, :k], ~np.isnan(x[:, :k])
    n = here.sum(axis=1)
    if h is None:
        x = np.sort(x, axis=1)  # NaN last
        at = lambda r: np.take_along_axis(x, np.maximum(r, 0)[:, None], axis=1)[:, 0]
        return np.where(n > 0, (at((n - 1) // 2) + at(n // 2)) / 2, np.nan)
    far = np.where(here, d[:, :k, None], np.inf)
    least = np.where(n > 0, far.min(axis=1), 0.0)[:, None]
    weight = np.where(here, np.exp((least * least - np.where(here, far * far, 0.0)) / (2 * h * h)), 0.0)
    total = weight.sum(axis=1)
    return np.where(n > 0, (weight * np.where(here, x, 0.0)).sum(axis=1) / np.where(n > 0, total, 1.0), np.nan)


def smoothed(x):
    """Mean of the present values within REACH seconds, where the second itself has one."""
    wide = np.pad(x, ((0, 0), (REACH, REACH)), constant_values=np.nan)
    parts = [wide[:, i:i + x.shape[1]] for i in range(2 * REACH + 1)]
    n = sum((~np.isnan(p)).astype(float) for p in parts)
    return np.where(np.isnan(x), np.nan, sum(np.nan_to_num(p) for p in parts) / np.maximum(n, 1.0))


def block_errors(mode: pd.Series, c: pd.Series, rank: pd.Series, distance: pd.Series, seen: pd.Series, value: pd.Series, prior: pd.Series) -> pd.DataFrame:
    """Sums of absolute errors of every specification of the mode over a block's seconds, and their number."""
    lead = np.where(c.to_numpy() > 0, REACH, 0)
    size = value.map(len).to_numpy()
    sums, count = np.zeros((len(c), len(SPECS))), np.zeros(len(c), dtype=np.int64)
    for m in ("axis", "joint"):
        mine = np.flatnonzero(mode.to_numpy() == m)
        mine = mine[np.argsort(size[mine], kind="stable")]
        at = 0
        while at < len(mine):
            # as many blocks at a time as make some MB
            take = max(1, (1 << 18) // (MOST * (int(size[mine[min(at + 2048, len(mine)) - 1]]) + 2 * REACH)))
            part = mine[at:at + take]
            at += take
            width = int(size[part].max())
            x = np.full((len(part), MOST, width + 2 * REACH), np.nan)
            d = np.full((len(part), MOST), np.inf)
            own, base = np.full((len(part), width), np.nan), np.full((len(part), width), np.nan)
            for i, g in enumerate(part):
                own[i, :size[g]], base[i, :size[g]] = value.iloc[g], prior.iloc[g]
                if seen.iloc[g] is None:
                    continue
                for r, far, values in zip(rank.iloc[g], distance.iloc[g], seen.iloc[g]):
                    # seconds are counted from REACH before the block, also where there are none
                    start = REACH - lead[g]
                    values = values[:x.shape[2] - start]
                    x[i, r, start:start + len(values)], d[i, r] = values, far
            known = ~np.isnan(own) & ~np.isnan(base)
            count[part] = known.sum(axis=1)
            forms = {}
            for j, (spec, k, mix, h) in enumerate(SPECS):
                if spec != m:
                    continue
                if (k, h) not in forms:
                    forms[k, h] = smoothed(retrieved(x, d, k, h))[:, REACH:REACH + width]
                got = forms[k, h]
                mixed = np.clip((1 - mix) * base + mix * np.where(np.isnan(got), base, got), P.LO, P.HI)
                sums[part, j] = np.where(known, np.abs(mixed - own), 0.0).sum(axis=1)
    return pd.DataFrame({"e": list(sums), "n": count})


_SPEC_ROWS = ", ".join(f"('{m}', {k}, {mix}, {h if h else 'NULL'})" for m, k, mix, h in SPECS)

RETRIEVED = f"""{ANCHOR}, {WIDE}, fa AS (SELECT subject, video, axis, round(anchor, 6) AS anchor, fold FROM anchor JOIN folds USING (subject)), fw AS (SELECT subject, video, round(v, 6) AS v, round(a, 6) AS a, fold FROM wide JOIN folds USING (subject)),
nr AS (
 SELECT 'axis' AS mode, a.subject, a.video, a.axis, b.subject AS who, abs(b.anchor - a.anchor) AS distance,
  row_number() OVER (PARTITION BY a.subject, a.video, a.axis ORDER BY abs(b.anchor - a.anchor), b.subject) AS k FROM fa a JOIN fa b ON a.video = b.video AND a.axis = b.axis AND a.fold <> b.fold
 UNION ALL SELECT 'joint', a.subject, a.video, x.axis, b.subject, {GAP}, row_number() OVER (PARTITION BY a.subject, a.video, x.axis ORDER BY {GAP}, b.subject)
 FROM fw a JOIN fw b ON a.video = b.video AND a.fold <> b.fold CROSS JOIN (SELECT unnest([0, 1]) AS axis) x),
sp(mode, k, mix, h) AS (VALUES {_SPEC_ROWS}),
nk AS (SELECT sp.*, subject, video, axis, who, distance, min(distance) OVER (PARTITION BY sp.mode, sp.k, sp.mix, sp.h, subject, video, axis) AS least FROM nr JOIN sp ON sp.mode = nr.mode AND nr.k <= sp.k WHERE nr.k <= {MOST}),
rv AS (
 SELECT mode, k, mix, h, nk.subject, nk.video, nk.axis, l.t, CASE WHEN h IS NULL THEN quantile_cont(l.value, 0.5)
  ELSE sum(exp(-0.5 * (distance / h) * (distance / h)) * l.value) / sum(exp(-0.5 * (distance / h) * (distance / h))) END AS x
 FROM nk JOIN long l ON l.subject = nk.who AND l.video = nk.video AND l.axis = nk.axis GROUP BY mode, k, mix, h, nk.subject, nk.video, nk.axis, l.t),
rs AS (SELECT *, avg(x) OVER (PARTITION BY mode, k, mix, h, subject, video, axis ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM rv)"""


@query("ts15_retrieval_grid", OOF_ALL + f""", {RETRIEVED},
er AS (
 SELECT sp.mode, sp.k, sp.mix, sp.h, o.subject, o.video,
  avg(abs(least(greatest((1 - sp.mix) * o.prior + sp.mix * coalesce(rs.s, o.prior), 1), 255) - o.value)) AS e
 FROM oof o CROSS JOIN sp LEFT JOIN rs ON rs.mode = sp.mode AND rs.k = sp.k AND rs.mix = sp.mix AND rs.h IS NOT DISTINCT FROM sp.h
  AND rs.subject = o.subject AND rs.video = o.video AND rs.axis = o.axis AND rs.t = o.t GROUP BY sp.mode, sp.k, sp.mix, sp.h, o.subject, o.video)
SELECT mode, CAST(k AS INTEGER) AS neighbours, CAST(mix AS DOUBLE) AS mix, CAST(h AS DOUBLE) AS bandwidth, count(*) AS trials, {q6('avg(e)')} AS mae FROM er GROUP BY mode, k, mix, h""")
def _(spark, sf):
    """Held-out error of every retrieval specification: axis and joint neighbours, all numbers, mixes and bandwidths."""
    t = retrieval_errors(spark, sf)
    pick = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(k).alias("neighbours"), F.lit(mix).alias("mix"), F.lit(h).cast("double").alias("bandwidth"), F.col(f"e{i}").alias("e"))
                     for i, (m, k, mix, h) in enumerate(SPECS)])
    rows = t.select("mode", F.explode(pick).alias("s")).filter(F.col("mode") == F.col("s.m")).select("mode", "s.neighbours", "s.mix", "s.bandwidth", "s.e")
    return rows.groupBy("mode", "neighbours", "mix", "bandwidth").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("e"), "mae"))


def retrieval_errors(spark, sf):
    """Per mode and trial the mean error of every specification (e0, e1, ..).

    A neighbour's seconds travel as one array per block, and a block of a trial
    meets its neighbours' blocks in one row.
    """
    near = retrieval_near(spark, sf).drop("fold")
    src = D.blocks(long_rows(spark, sf).withColumnRenamed("subject", "who"), ["who", "video", "axis"], "t", ["value"], REACH, SECONDS)
    key = ["mode", *K3, "c"]
    seen = near.join(src.withColumnRenamed("value", "seen"), ["who", "video", "axis"]).groupBy(*key).agg(F.collect_list(F.struct("rank", "distance", "seen")).alias("l"))
    own = D.blocks(oof(spark, sf), [*K3, "fold"], "t", ["value", "prior"], 0, SECONDS)
    rows = own.withColumn("mode", F.explode(F.array(F.lit("axis"), F.lit("joint")))).join(seen, key, "left")
    errors = F.pandas_udf(block_errors, "struct<e:array<double>,n:long>")
    rows = rows.withColumn("_r", errors("mode", "c", F.col("l.rank"), F.col("l.distance"), F.col("l.seen"), "value", "prior"))
    return rows.groupBy("mode", "fold", "subject", "video").agg(*[(F.sum(F.col("_r.e")[i]) / F.sum("_r.n")).alias(f"e{i}") for i in range(len(SPECS))])


@query("ts16_functional_anchor_prior", with_(TRACE, LONG, FOLDS, TRAIN.replace("train AS", "tr AS").replace("l.video, l.t", "l.subject, l.video, l.t"), ANCHOR) + f""",
cen AS (SELECT g.vfold, a.video, a.axis, quantile_cont(a.anchor, 0.5) AS centre FROM anchor a JOIN folds USING (subject) JOIN (SELECT unnest(range(5)) AS vfold) g ON g.vfold <> folds.fold GROUP BY 1, 2, 3),
den AS (SELECT c.vfold, c.video, c.axis, sum(pow(a.anchor - centre, 2)) + 50 AS d FROM cen c JOIN anchor a ON a.video = c.video AND a.axis = c.axis JOIN folds ON folds.subject = a.subject AND folds.fold <> c.vfold GROUP BY 1, 2, 3),
pop AS (SELECT vfold, video, axis, t, quantile_cont(value, 0.5) AS p FROM tr GROUP BY 1, 2, 3, 4),
slope AS (SELECT tr.vfold, tr.video, tr.axis, tr.t, sum((a.anchor - centre) * (tr.value - p)) / greatest(any_value(d), 1e-12) AS s FROM tr JOIN anchor a ON a.subject = tr.subject AND a.video = tr.video AND a.axis = tr.axis
 JOIN cen c ON c.vfold = tr.vfold AND c.video = tr.video AND c.axis = tr.axis JOIN den ON den.vfold = tr.vfold AND den.video = tr.video AND den.axis = tr.axis JOIN pop ON pop.vfold = tr.vfold AND pop.video = tr.video AND pop.axis = tr.axis AND pop.t = tr.t GROUP BY 1, 2, 3, 4),
sms AS (SELECT vfold, video, axis, t, avg(s) OVER (PARTITION BY vfold, video, axis ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM slope),
ends AS (SELECT vfold, video, axis, max(t) + 1 AS n FROM sms GROUP BY 1, 2, 3)
SELECT l.subject, l.video, l.axis, l.t, {q6('least(greatest(0.8 * sms.s * (a.anchor - c.centre), -30), 30)')} AS correction FROM long l JOIN folds f ON f.subject = l.subject JOIN anchor a ON a.subject = l.subject AND a.video = l.video AND a.axis = l.axis
JOIN cen c ON c.vfold = f.fold AND c.video = l.video AND c.axis = l.axis JOIN ends e ON e.vfold = f.fold AND e.video = l.video AND e.axis = l.axis JOIN sms ON sms.vfold = f.fold AND sms.video = l.video AND sms.axis = l.axis AND sms.t = least(l.t, e.n - 1)""")
def _(spark, sf):
    return functional(spark, sf, 50.0, 2, 0.8, 30.0).select(*K3, "t", r6("correction"))


def functional(spark, sf, ridge, radius, mix, cap):
    """Per item second: ridge slope of the residual on the centred rating, applied held out."""
    tr, long = A.trace(spark, sf), long_rows(spark, sf)
    folds, a = A.subject_folds(tr), anchors(spark, sf).select(*K3, "anchor")
    key = ["vfold", "video", "axis"]
    at = Fo.to_training(a.join(folds, "subject"), 5)
    centre = D.quantiles(at, key, F.col("anchor"), {"centre": 0.5}).drop("n")
    den = at.join(centre, key).groupBy(*key).agg((F.sum((F.col("anchor") - F.col("centre")) ** 2) + ridge).alias("den"))
    train = Fo.to_training(long.join(folds, "subject").join(a, K3), 5)
    pop = P.population_curve(train, key).drop("n")
    s = train.join(pop, [*key, "t"]).join(centre, key).groupBy(*key, "t").agg(
        F.sum((F.col("anchor") - F.col("centre")) * (F.col("value") - F.col("med"))).alias("num"))
    s = s.join(den, key).withColumn("slope", F.col("num") / F.greatest("den", F.lit(1e-12))).select(*key, "t", "slope")
    # The slopes are read twice further on, and what makes them is a large plan of its own.
    s = written(spark, f"slopes_{ridge:g}_{radius}", sf, lambda: P.smooth(s, key, radius, {"slope": "slope"}).join(centre, key))
    rows = long.join(folds, "subject").join(a, K3).withColumnRenamed("fold", "vfold")
    hit = P.clamp_lookup(rows, s, key)
    return hit.withColumn("correction", S.clip(mix * F.col("slope") * (F.col("anchor") - F.col("centre")), -cap, cap))


@query("ts19_shifted_error", with_(TRACE, LONG, CURVE) + f""", n AS (SELECT subject, video, axis, max(t) + 1 AS n FROM long GROUP BY 1, 2, 3),
a AS (SELECT l.subject, l.video, l.axis, l.t, n.n, least(l.t + 1.5, n.n - 1) AS pos, c.x AS tpl FROM long l JOIN n USING (subject, video, axis) JOIN curve c ON c.video = l.video AND c.axis = l.axis AND c.t = l.t WHERE l.t >= 2 AND l.t < n.n - 2)
SELECT a.subject, a.video, {q6('avg(abs((1 - (pos - floor(pos))) * lo.value + (pos - floor(pos)) * hi.value - tpl))')} AS mae, count(*) AS k FROM a
JOIN long lo ON lo.subject = a.subject AND lo.video = a.video AND lo.axis = a.axis AND lo.t = CAST(floor(pos) AS BIGINT)
JOIN long hi ON hi.subject = a.subject AND hi.video = a.video AND hi.axis = a.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, a.n - 1) GROUP BY 1, 2""")
def _(spark, sf):
    return shifted_error(long_rows(spark, sf), curves(spark, sf), 1.5, 2).select("subject", "video", r6("mae"), "k")


def shifted_error(long, curve, shift, band):
    """Error of each trial, read ``shift`` seconds later, against the template inside the common interior."""
    s = max(-band, min(band, shift))
    ends = long.groupBy(*K3).agg((F.max("t") + 1).alias("_n"))
    inner = D.attach(long.drop("value"), ends, K3, length="_n").filter((F.col("t") >= band) & (F.col("t") < F.col("_n") - band))
    moved = P.sample_at(long.withColumnRenamed("value", "moved"), K3, inner.withColumn("_pos", F.col("t") + float(s)), ["moved"])
    return moved.join(curve, ["video", "axis", "t"]).groupBy("subject", "video").agg(
        F.avg(F.abs(F.col("moved") - F.col("x"))).alias("mae"), F.count(F.lit(1)).alias("k"))
