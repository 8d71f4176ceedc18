"""Window operators over trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distributed as D
from ..operators import priors as P
from ..operators import windows as Wn
from ..sources import adapters as A
from ..sources.shared import written
from .registry import CONTENT, LONG, TRACE, q6, query, r6, with_

T = with_(TRACE)
K = ["subject", "video"]
OV = "OVER (PARTITION BY subject, video ORDER BY t"
GRAD = "CASE WHEN lag({x}) OVER w IS NOT NULL AND lead({x}) OVER w IS NOT NULL THEN (lead({x}) OVER w - lag({x}) OVER w) / 2 WHEN lead({x}) OVER w IS NOT NULL THEN lead({x}) OVER w - {x} WHEN lag({x}) OVER w IS NOT NULL THEN {x} - lag({x}) OVER w ELSE 0 END"
GRADS = "grads AS (SELECT *, " + GRAD.format(x="valence") + " AS gv, " + GRAD.format(x="arousal") + " AS ga FROM trace WINDOW w AS (PARTITION BY subject, video ORDER BY t))"


def tr(spark, sf):
    return A.trace(spark, sf)


@query("wn1_centred_mean", T + f"SELECT subject, video, t, {q6(f'avg(valence) {OV} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS sv, {q6(f'avg(arousal) {OV} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS sa FROM trace")
def _(spark, sf):
    return P.smooth(tr(spark, sf), K, 3, {"valence": "sv", "arousal": "sa"}).select(*K, "t", r6("sv"), r6("sa"))


@query("wn2_centred_median", T + f"SELECT subject, video, t, {q6(f'quantile_cont(valence, 0.5) {OV} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)')} AS mv FROM trace")
def _(spark, sf):
    return P.moving_median(tr(spark, sf), K, 2, "valence", "mv").select(*K, "t", r6("mv"))


@query("wn3_triangular", T + f"""SELECT a.subject, a.video, a.t, {q6('sum((3 - abs(a.t - b.t)) * b.valence) / sum(3 - abs(a.t - b.t))')} AS tv
FROM trace a JOIN trace b ON a.subject = b.subject AND a.video = b.video AND abs(a.t - b.t) <= 2 GROUP BY 1, 2, 3""")
def _(spark, sf):
    return P.triangular(tr(spark, sf), K, 2, "valence", "tv").select(*K, "t", r6("tv"))


@query("wn4_gradient", with_(TRACE, GRADS) + f"SELECT subject, video, t, {q6('gv')} AS gv, {q6('ga')} AS ga FROM grads")
def _(spark, sf):
    return Wn.add_gradient(tr(spark, sf), K, {"valence": "gv", "arousal": "ga"}).select(*K, "t", r6("gv"), r6("ga"))


@query("wn5_robust_z", T + f""", m AS (SELECT subject, video, quantile_cont(valence, 0.5) AS med, stddev_pop(valence) AS sd FROM trace GROUP BY 1, 2),
d AS (SELECT subject, video, 1.4826 * quantile_cont(abs(valence - med), 0.5) AS s FROM trace JOIN m USING (subject, video) GROUP BY 1, 2)
SELECT subject, video, t, {q6('CASE WHEN s >= 1e-6 THEN (valence - med) / s WHEN sd >= 1e-6 THEN (valence - med) / sd ELSE 0 END')} AS z
FROM trace JOIN m USING (subject, video) JOIN d USING (subject, video)""")
def _(spark, sf):
    return Wn.robust_z(tr(spark, sf), K, "valence", "z").select(*K, "t", r6("z"))


@query("wn6_event_mask", with_(TRACE, GRADS) + """, r AS (SELECT subject, video, t, count(*) OVER (PARTITION BY subject, video) AS n,
 row_number() OVER (PARTITION BY subject, video ORDER BY round(sqrt(gv * gv + ga * ga), 6) DESC, t) AS k FROM grads)
SELECT subject, video, t, k <= least(greatest(1, ceil(n * 0.25)), greatest(n - 1, 1)) AS event FROM r""")
def _(spark, sf):
    g = Wn.add_gradient(tr(spark, sf), K, {"valence": "gv", "arousal": "ga"})
    g = g.withColumn("g", F.round(F.sqrt(F.col("gv") ** 2 + F.col("ga") ** 2), 6))
    return Wn.event_mask(g, K, "g").select(*K, "t", "event")


TEMPLATE = """curve AS (SELECT video, t, quantile_cont(valence, 0.5) AS valence, quantile_cont(arousal, 0.5) AS arousal FROM trace GROUP BY 1, 2),
cg AS (SELECT *, """ + GRAD.format(x="valence") + " AS gv, " + GRAD.format(x="arousal") + """ AS ga, count(*) OVER (PARTITION BY video) AS n FROM curve WINDOW w AS (PARTITION BY video ORDER BY t)),
tpl AS (SELECT *, round(sqrt(gv * gv + ga * ga), 6) AS g, CASE WHEN n > 1 THEN t / CAST(n - 1 AS DOUBLE) ELSE 0 END AS progress,
 sqrt(((valence - 128) / 127) * ((valence - 128) / 127) + ((arousal - 128) / 127) * ((arousal - 128) / 127)) AS magnitude FROM cg)"""
PEAKS = """q AS (SELECT video, quantile_cont(g, 0.75) AS q75 FROM tpl GROUP BY 1),
p0 AS (SELECT *, lag(g) OVER w AS g0, lead(g) OVER w AS g1 FROM tpl WINDOW w AS (PARTITION BY video ORDER BY t)),
strict AS (SELECT video, t FROM p0 JOIN q USING (video) WHERE g >= g0 AND g >= g1 AND g >= q75 AND t >= 5 AND t < n - 5),
fallback AS (SELECT video, arg_min(t, {'a': -g, 'b': t}) AS t FROM tpl WHERE t >= 5 AND t < n - 5 GROUP BY video),
peaks AS (SELECT video, t FROM strict UNION ALL SELECT video, t FROM fallback WHERE video NOT IN (SELECT video FROM strict))"""


def template(spark, sf):
    return written(spark, "template", sf, lambda: build_template(spark, sf))


def build_template(spark, sf):
    """Per item: median curve, gradient strength, progress and magnitude."""
    m = D.medians(tr(spark, sf), ["video", "t"], {"valence": F.col("valence"), "arousal": F.col("arousal")}).drop("n")
    g = Wn.add_gradient(m, ["video"], {"valence": "gv", "arousal": "ga"})
    n = g.groupBy("video").agg((F.max("t") + 1).alias("n"))
    g = D.attach(g, n, ["video"])
    return g.withColumn("g", F.round(F.sqrt(F.col("gv") ** 2 + F.col("ga") ** 2), 6)).withColumn(
        "progress", F.when(F.col("n") > 1, F.col("t") / (F.col("n") - 1)).otherwise(0.0)).withColumn(
        "magnitude", F.sqrt(((F.col("valence") - 128) / 127) ** 2 + ((F.col("arousal") - 128) / 127) ** 2))


def peaks(tpl):
    """Local maxima above the upper quartile, away from both ends; else the strongest second."""
    inner = (F.col("t") >= 5) & (F.col("t") < F.col("n") - 5)
    q = D.quantiles(tpl, ["video"], F.col("g"), {"q75": 0.75}).drop("n")
    near = D.framed(tpl, ["video"], "t", 1, 1, lambda d, w: d.withColumn("g0", F.lag("g").over(w)).withColumn("g1", F.lead("g").over(w)))
    strict = near.join(q, "video").filter(
        (F.col("g") >= F.col("g0")) & (F.col("g") >= F.col("g1")) & (F.col("g") >= F.col("q75")) & inner).select("video", "t")
    best = tpl.filter(inner).groupBy("video").agg(F.min_by("t", F.struct(-F.col("g"), F.col("t"))).alias("t"))
    return strict.unionByName(best.join(strict.select("video").distinct(), "video", "left_anti"))


@query("wn7_local_peaks", with_(TRACE, TEMPLATE, PEAKS) + "SELECT video, t FROM peaks")
def _(spark, sf):
    return peaks(template(spark, sf))


@query("wn8_causal_context", T + f"""SELECT subject, video, t, {q6(f'coalesce(lag(valence, 2) {OV}), first_value(valence) {OV}))')} AS x2,
 {q6(f'coalesce(lag(valence, 1) {OV}), first_value(valence) {OV}))')} AS x1, {q6('valence')} AS x0 FROM trace""")
def _(spark, sf):
    return D.framed(tr(spark, sf), K, "t", 2, 0, lambda d, w: d.withColumn("x2", Wn.lagged("valence", 2, w)).withColumn(
        "x1", Wn.lagged("valence", 1, w))).select(*K, "t", r6("x2"), r6("x1"), r6("valence", "x0"))


@query("wn9_symmetric_context", T + f"""SELECT subject, video, t, {q6(f'coalesce(lag(arousal, 1) {OV}), arousal)')} AS before,
 {q6('arousal')} AS now, {q6(f'coalesce(lead(arousal, 1) {OV}), arousal)')} AS after FROM trace""")
def _(spark, sf):
    return D.framed(tr(spark, sf), K, "t", 1, 1, lambda d, w: d.withColumn("before", F.coalesce(F.lag("arousal").over(w), "arousal")).withColumn(
        "after", F.coalesce(F.lead("arousal").over(w), "arousal"))).select(*K, "t", r6("before"), r6("arousal", "now"), r6("after"))


@query("wn10_causal_shift", T + f"SELECT subject, video, t, {q6(f'coalesce(lag(valence, 3) {OV}), first_value(valence) {OV}))')} AS shifted FROM trace")
def _(spark, sf):
    return D.framed(tr(spark, sf), K, "t", 3, 0, lambda d, w: d.withColumn("shifted", Wn.lagged("valence", 3, w))).select(*K, "t", r6("shifted"))


@query("wn11_trailing_mean", T + f"SELECT subject, video, t, {q6(f'avg(valence) {OV} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS m FROM trace")
def _(spark, sf):
    return D.framed(tr(spark, sf), K, "t", 3, 0, lambda d, w: d.withColumn("m", F.avg("valence").over(w.rowsBetween(-3, 0)))).select(*K, "t", r6("m"))


@query("wn12_causal_ema", T + f"""SELECT a.subject, a.video, a.t,
 {q6("sum(CASE WHEN b.t = 0 THEN pow(0.8, a.t) * b.valence ELSE 0.2 * pow(0.8, a.t - b.t) * b.valence END)")} AS ema
FROM trace a JOIN trace b ON a.subject = b.subject AND a.video = b.video AND b.t <= a.t GROUP BY 1, 2, 3""")
def _(spark, sf):
    return Wn.ema(tr(spark, sf), K, "valence", 0.8, "ema").select(*K, "t", r6("ema"))


@query("wn13_embedding_difference", with_(CONTENT) + f""", d AS (SELECT video, t, features, coalesce(lag(features, 2) OVER w, first_value(features) OVER w) AS old FROM content WINDOW w AS (PARTITION BY video ORDER BY t))
SELECT video, t, {q6('features[1] - old[1]')} AS d1, {q6('list_sum(list_transform(list_zip(features, old), lambda p: (p[1] - p[2]) * (p[1] - p[2])))')} AS sq FROM d""")
def _(spark, sf):
    c = A.content(spark, sf)
    d = D.framed(c, ["video"], "t", 2, 0, lambda x, w: x.withColumn("old", Wn.lagged("features", 2, w)))
    diff = F.zip_with("features", "old", lambda a, b: a - b)
    return d.withColumn("diff", diff).select("video", "t", r6(F.col("diff")[0], "d1"),
                                             r6(F.aggregate("diff", F.lit(0.0), lambda s, x: s + x * x), "sq"))


MAPPING = "mapping AS (SELECT subject, video, t, count(*) OVER (PARTITION BY subject, video) AS n, least(count(*) OVER (PARTITION BY subject, video) - 1, CAST(floor(valence / 255 * count(*) OVER (PARTITION BY subject, video) + 0.5) AS BIGINT)) AS w FROM trace)"


def mapping(spark, sf):
    t = tr(spark, sf)
    n = A.trial_lengths(t)
    return D.attach(t, n, K).withColumn("w", F.least(F.col("n") - 1, F.floor(F.col("valence") / 255 * F.col("n") + 0.5)))


@query("wn14_monotone_projection", with_(TRACE, MAPPING) + f"""SELECT subject, video, t, w, max(w) {OV}) AS mono, max(w) {OV}) <> w AS changed FROM mapping""")
def _(spark, sf):
    m = D.running(mapping(spark, sf), K, "t", F.col("w"), "mono", "max")
    return m.select(*K, "t", "w", "mono", (F.col("mono") != F.col("w")).alias("changed"))


@query("wn15_average_ranks", T + f"""SELECT subject, video, t, {q6('avg(rn) OVER (PARTITION BY video, valence)')} AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY video ORDER BY valence) AS rn FROM trace)""")
def _(spark, sf):
    return D.ranked(tr(spark, sf), ["video"], F.col("valence"), [], ordinal="", average="rank").select(*K, "t", r6("rank"))


@query("wn16_ordinal_ranks", T + """SELECT subject, video, t, row_number() OVER (PARTITION BY video ORDER BY valence, subject, t) - 1 AS rank FROM trace""")
def _(spark, sf):
    return D.ranked(tr(spark, sf), ["video"], F.col("valence"), ["subject", "t"], ordinal="rank").select(*K, "t", (F.col("rank") - 1).alias("rank"))


@query("wn17_window_slices", T + f""", n AS (SELECT subject, video, max(t) AS m FROM trace GROUP BY 1, 2),
s AS (SELECT a.subject, a.video, a.t, k.k, k.mode, CASE WHEN k.mode = 'causal' THEN greatest(a.t - 3 + k.k, 0) ELSE least(greatest(a.t - 2 + k.k, 0), n.m) END AS src
 FROM trace a JOIN n USING (subject, video), (SELECT unnest(range(4)) AS k, 'causal' AS mode UNION ALL SELECT unnest(range(5)), 'centred') k)
SELECT s.subject, s.video, s.t, s.mode, s.k, {q6('b.valence')} AS x FROM s JOIN trace b ON b.subject = s.subject AND b.video = s.video AND b.t = s.src""")
def _(spark, sf):
    def add(d, w):
        causal = [F.struct(F.lit("causal").alias("mode"), F.lit(i).cast("long").alias("k"),
                           (Wn.lagged("valence", 3 - i, w) if i < 3 else F.col("valence")).alias("x")) for i in range(4)]
        centred = [F.struct(F.lit("centred").alias("mode"), F.lit(i).cast("long").alias("k"),
                            (F.col("valence") if i == 2 else Wn.lagged("valence", 2 - i, w) if i < 2 else Wn.led("valence", i - 2, w)).alias("x"))
                   for i in range(5)]
        return d.withColumn("s", F.array(*causal, *centred))

    return D.framed(tr(spark, sf), K, "t", 3, 2, add).select(*K, "t", F.explode("s").alias("s")).select(
        *K, "t", "s.mode", "s.k", r6("s.x", "x"))


@query("wn18_trial_chunks", T + f""", m AS (SELECT a.*, c.chunk FROM trace a, (SELECT unnest(range(10000)) AS chunk) c WHERE a.t >= 3 * c.chunk AND a.t < 3 * c.chunk + 5 AND c.chunk <= a.t / 3)
SELECT subject, video, chunk, min(t) AS start, {q6('avg(valence)')} AS mean FROM m GROUP BY 1, 2, 3 HAVING count(*) = 5""")
def _(spark, sf):
    c = Wn.chunks(tr(spark, sf), K, 5, 3)
    return c.groupBy(*K, "chunk").agg(F.min("t").alias("start"), r6(F.avg("valence"), "mean"))


@query("wn19_progress_context", with_(TRACE, TEMPLATE) + f"""SELECT a.subject, a.video, a.t, {q6('least(greatest((c.valence - 128) / 127, -1), 1)')} AS prior,
 {q6('least(greatest(c.gv / 32, -4), 4)')} AS slope, {q6('c.progress')} AS progress FROM trace a JOIN tpl c ON c.video = a.video AND c.t = a.t""")
def _(spark, sf):
    tpl = template(spark, sf).select("video", "t", P.clip((F.col("valence") - 128) / 127, -1.0, 1.0).alias("prior"),
                                     P.clip(F.col("gv") / 32, -4.0, 4.0).alias("slope"), "progress")
    return tr(spark, sf).select(*K, "t").join(tpl, ["video", "t"]).select(*K, "t", r6("prior"), r6("slope"), r6("progress"))


@query("wn20_trial_geometry", T + f""", s AS (SELECT *, sqrt(pow(valence - lag(valence) OVER w, 2) + pow(arousal - lag(arousal) OVER w, 2)) AS step FROM trace WINDOW w AS (PARTITION BY subject, video ORDER BY t))
SELECT subject, video, count(*) AS n, {q6('coalesce(sum(step), 0)')} AS path_length, {q6('coalesce(avg(step), 0)')} AS mean_speed,
 {q6('max(valence) - min(valence)')} AS value_range, {q6('var_pop(valence)')} AS variance, {q6('avg(sqrt(pow(valence - 128, 2) + pow(arousal - 128, 2)))')} AS centre_distance,
 {q6('avg(CASE WHEN valence <= 2 THEN 1.0 ELSE 0.0 END)')} AS floor_share, {q6('avg(CASE WHEN valence >= 254 THEN 1.0 ELSE 0.0 END)')} AS ceiling_share FROM s GROUP BY 1, 2""")
def _(spark, sf):
    s = D.framed(tr(spark, sf), K, "t", 1, 0, lambda d, w: d.withColumn("step", F.sqrt(
        (F.col("valence") - F.lag("valence").over(w)) ** 2 + (F.col("arousal") - F.lag("arousal").over(w)) ** 2)))
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return s.groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), r6(F.coalesce(F.sum("step"), F.lit(0.0)), "path_length"),
        r6(F.coalesce(F.avg("step"), F.lit(0.0)), "mean_speed"), r6(F.max("valence") - F.min("valence"), "value_range"),
        r6(F.var_pop("valence"), "variance"),
        r6(F.avg(F.sqrt((F.col("valence") - 128) ** 2 + (F.col("arousal") - 128) ** 2)), "centre_distance"),
        r6(share(F.col("valence") <= 2), "floor_share"), r6(share(F.col("valence") >= 254), "ceiling_share"))


@query("wn21_padded_past_window", T + f"""SELECT a.subject, a.video, a.t, k.k, {q6('coalesce(b.valence, 0)')} AS x FROM trace a CROSS JOIN (SELECT unnest(range(4)) AS k) k
LEFT JOIN trace b ON b.subject = a.subject AND b.video = a.video AND b.t = a.t - 3 + k.k""")
def _(spark, sf):
    def add(d, w):
        return d.withColumn("s", F.array(*[F.coalesce(F.lag("valence", 3 - i).over(w), F.lit(0.0)) if i < 3 else F.col("valence") for i in range(4)]))

    return D.framed(tr(spark, sf), K, "t", 3, 0, add).select(*K, "t", F.posexplode("s").alias("k", "x")).select(
        *K, "t", F.col("k").cast("long").alias("k"), r6("x"))


@query("wn22_circular_shift", T + f""", n AS (SELECT subject, video, max(t) + 1 AS n FROM trace GROUP BY 1, 2)
SELECT a.subject, a.video, (a.t + 3) % n.n AS t, {q6('a.valence')} AS rolled FROM trace a JOIN n USING (subject, video)""")
def _(spark, sf):
    # A roll moves each row to t + shift; no self join is needed.
    t = tr(spark, sf)
    return D.attach(t, A.trial_lengths(t), K).select(*K, ((F.col("t") + 3) % F.col("n")).alias("t"), r6("valence", "rolled"))


@query("ts18_context_features", with_(TRACE, LONG) + f""", m AS (SELECT video, axis, t, quantile_cont(value, 0.5) AS med FROM long GROUP BY 1, 2, 3),
u AS (SELECT l.video, l.axis, l.t, any_value(med) AS med, 1.4826 * quantile_cont(abs(value - med), 0.5) AS mad FROM long l JOIN m ON m.video = l.video AND m.axis = l.axis AND m.t = l.t GROUP BY 1, 2, 3),
s AS (SELECT video, axis, t, avg(med) OVER w AS prior, avg(mad) OVER w AS unc, count(*) OVER (PARTITION BY video, axis) AS n FROM u WINDOW w AS (PARTITION BY video, axis ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
g AS (SELECT *, {GRAD.format(x='prior')} AS slope FROM s WINDOW w AS (PARTITION BY video, axis ORDER BY t))
SELECT l.subject, l.video, l.axis, l.t, {q6('least(greatest((prior - 128) / 127, -1), 1)')} AS prior, {q6('least(greatest(unc / 64, 0), 4)')} AS uncertainty,
 {q6('least(greatest(slope / 32, -4), 4)')} AS slope, {q6('l.t / CAST(greatest(n - 1, 1) AS DOUBLE)')} AS progress
FROM long l JOIN g ON g.video = l.video AND g.axis = l.axis AND g.t = l.t""")
def _(spark, sf):
    long = A.long_axes(tr(spark, sf), *K, "t")
    key = ["video", "axis"]
    ref = P.smooth(P.median_and_mad(long, [*key, "t"]), key, 3, {"med": "prior", "mad": "unc"})
    ref = D.framed(ref.drop("n", "med", "mad"), key, "t", 1, 1, lambda d, w: d.withColumn("slope", Wn.gradient("prior", w)))
    n = ref.groupBy(*key).agg((F.max("t") + 1).alias("n"))
    ref = D.attach(ref, n, key)
    return long.drop("value").join(ref, [*key, "t"]).select(
        "subject", "video", "axis", "t", r6(P.clip((F.col("prior") - 128) / 127, -1.0, 1.0), "prior"),
        r6(P.clip(F.col("unc") / 64, 0.0, 4.0), "uncertainty"), r6(P.clip(F.col("slope") / 32, -4.0, 4.0), "slope"),
        r6(F.col("t") / F.greatest(F.col("n") - 1, F.lit(1)), "progress"))


@query("jn6_matched_control", with_(TRACE, TEMPLATE, PEAKS) + """, sc AS (SELECT video, greatest(stddev_pop(g), 1e-6) AS sg, greatest(stddev_pop(progress), 1e-6) AS sp, greatest(stddev_pop(magnitude), 1e-6) AS sm FROM tpl GROUP BY 1),
c AS (SELECT * FROM tpl WHERE t >= 5 AND t < n - 5 AND NOT EXISTS (SELECT 1 FROM peaks p WHERE p.video = tpl.video AND p.t = tpl.t)),
d AS (SELECT p.video, p.t AS peak, c.t AS control, round(pow((c.g - a.g) / sg, 2) + pow((c.progress - a.progress) / sp, 2) + pow((c.magnitude - a.magnitude) / sm, 2), 9) AS dist
 FROM peaks p JOIN tpl a ON a.video = p.video AND a.t = p.t JOIN c ON c.video = p.video JOIN sc ON sc.video = p.video)
SELECT video, peak, arg_min(control, {'a': dist, 'b': control}) AS control FROM d GROUP BY 1, 2""")
def _(spark, sf):
    return matched_controls(template(spark, sf))


def matched_controls(tpl):
    """Nearest non-peak second of the same item on three scaled features.

    Progress is one of the features, so a control further away in progress than
    the best distance found in the peak's own neighbourhood cannot win.  Pass
    one bounds the distance with the seconds around the peak; pass two opens
    only the progress cells within that bound.
    """
    pk = peaks(tpl)
    scale = tpl.groupBy("video").agg(*[F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"s_{c}") for c in ("g", "progress", "magnitude")],
                                     F.max("n").alias("len"))
    feats = tpl.join(scale, "video").select("video", "t", "n", "len", F.col("s_progress").alias("sp"),
                                            (F.col("g") / F.col("s_g")).alias("a"), (F.col("progress") / F.col("s_progress")).alias("b"),
                                            (F.col("magnitude") / F.col("s_magnitude")).alias("c"))
    controls = feats.filter((F.col("t") >= 5) & (F.col("t") < F.col("n") - 5)).join(pk, ["video", "t"], "left_anti")
    targets = feats.join(pk, ["video", "t"]).withColumnRenamed("t", "peak")
    cand = controls.select("video", F.col("t").alias("control"), F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("c").alias("cc"))
    dist = F.round((F.col("ca") - F.col("a")) ** 2 + (F.col("cb") - F.col("b")) ** 2 + (F.col("cc") - F.col("c")) ** 2, 9)
    # the last control before the peak (or the item's first one) gives a finite bound
    marks = feats.join(controls.select("video", "t", F.lit(True).alias("is_c")), ["video", "t"], "left")
    seen = D.running(marks, ["video"], "t", F.when(F.col("is_c"), F.col("t")), "prev", "max")
    first = controls.groupBy("video").agg(F.min("t").alias("first"))
    near = seen.select("video", F.col("t").alias("peak"), "prev").join(first, "video").select(
        "video", "peak", F.coalesce("prev", "first").alias("control"))
    bound = targets.join(near, ["video", "peak"]).join(cand, ["video", "control"]).withColumn(
        "limit", F.sqrt(dist)).drop("control", "ca", "cb", "cc")
    step = (F.col("limit") * F.col("sp") * F.greatest(F.col("len") - 1, F.lit(1)) + 2).cast("long")
    lo, hi = F.greatest(F.lit(5).cast("long"), F.col("peak") - step), F.least(F.col("len") - 6, F.col("peak") + step)
    asked = bound.withColumn("control", F.explode(F.sequence(lo, hi))).drop("limit")
    return asked.join(cand, ["video", "control"]).groupBy("video", "peak").agg(
        F.min_by("control", F.struct(dist, F.col("control"))).alias("control"))
