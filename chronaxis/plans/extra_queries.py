"""Cross-fitted priors, staged anchor selection, item subsets and the full-pipeline bootstrap."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import functions as F

from ..operators import align as Al
from ..operators import distributed as D
from ..operators import folds as Fo
from ..operators import priors as P
from ..operators import reliability as Rl
from ..operators import resample as Rs
from ..sources import adapters as A
from ..sources.shared import written
from .base_queries import long_rows, oof
from .prior_queries import CURVE, K3, LEN, anchors, bounded, curves, functional, gaussian, near5
from .registry import CATEGORY, LONG, TRACE, q6, query, r6, with_
from .timing_queries import DEFAULT

K2 = ["subject", "video"]


# ---- cross-fitted category prior -----------------------------------------------------

CROSSFIT = f"""tl AS (SELECT subject, video, max(t) + 1 AS n FROM trace GROUP BY 1, 2), il AS (SELECT video, {CATEGORY} AS category, max(n) AS m FROM tl GROUP BY 1, 2),
cv AS (SELECT s.subject, l.video, l.axis, l.t, quantile_cont(l.value, 0.5) AS x FROM (SELECT DISTINCT subject FROM trace) s JOIN long l ON l.subject <> s.subject GROUP BY 1, 2, 3, 4),
cl AS (SELECT subject, video, axis, max(t) + 1 AS n FROM cv GROUP BY 1, 2, 3),
pr AS (SELECT cl.subject, a.video, cl.axis, a.m, b.video AS sv, cl.n AS sn, i, CASE WHEN a.m = 1 THEN 0 ELSE i * (cl.n - 1) / CAST(a.m - 1 AS DOUBLE) END AS pos FROM il a JOIN il b ON a.category = b.category AND a.video <> b.video JOIN cl ON cl.video = b.video, LATERAL (SELECT unnest(range(a.m)) AS i) r),
tp AS (SELECT pr.subject, pr.video, pr.axis, pr.i AS t, avg((1 - (pos - floor(pos))) * lo.x + (pos - floor(pos)) * hi.x) AS prior FROM pr JOIN cv lo ON lo.subject = pr.subject AND lo.video = sv AND lo.axis = pr.axis AND lo.t = CAST(floor(pos) AS BIGINT)
 JOIN cv hi ON hi.subject = pr.subject AND hi.video = sv AND hi.axis = pr.axis AND hi.t = least(CAST(floor(pos) AS BIGINT) + 1, sn - 1) GROUP BY 1, 2, 3, 4)"""


MID = {f"{side}{k}": (lambda n, f=f, k=k: f((n - 2) / 2) + k) for side, f in (("a", F.floor), ("b", F.ceil)) for k in (0, 1)}
AXES = ("valence", "arousal")


def middle_blocks(tr, size):
    """(video, c, valence, arousal): by second the middle values that decide the median of all but one, and the median of all."""
    long = A.long_axes(tr, "video", "t")
    ranks = {**MID, "lo": lambda n: F.floor((n - 1) / 2), "hi": lambda n: F.ceil((n - 1) / 2)}
    mid = D.order_statistics(long, ["video", "axis", "t"], F.col("value"), ranks)
    mid = mid.select("video", "axis", "t", F.struct("n", *MID, ((F.col("lo") + F.col("hi")) / 2).alias("med")).alias("s"))
    both = mid.groupBy("video", "t").agg(*[F.max(F.when(F.col("axis") == i, F.col("s"))).alias(name) for i, name in enumerate(AXES)])
    return D.blocks(tr.select("video", "t").distinct().join(both, ["video", "t"], "left"), ["video"], "t", AXES, 1, size)


def others_at(mid, own):
    """Median of everybody but the subject, from the middle values of a second and the subject's own value (null: none)."""
    low = F.when(own > mid["a0"], mid["a0"]).otherwise(mid["a1"])
    high = F.when(own > mid["b0"], mid["b0"]).otherwise(mid["b1"])
    return F.when(own.isNull(), mid["med"]).when(mid["n"] > 1, (low + high) / 2)


def cross_fitted_prior(tr, size=D.CHUNK):
    """(subject, video, axis, t, prior): mean of the other items of the category without the subject, stretched to the item's length.

    A trial asks each source item for the blocks its own seconds fall on; where the
    subject has no row there, the median of all already is the curve without it.  All
    travels as one array per block of a trial, and is opened at the end.
    """
    tr = tr.withColumns({name: F.col(name).cast("double") for name in AXES})
    seconds = tr.groupBy("video", "t").agg(F.count(F.lit(1)).alias("k"))
    # without its only longest subject an item ends where two subjects still are
    items = seconds.groupBy("video").agg((F.max("t") + 1).alias("m"), (F.max(F.when(F.col("k") > 1, F.col("t"))) + 1).alias("second")).withColumn("category", A.category())
    trials = A.trial_lengths(tr)
    sources = items.select("category", F.col("video").alias("source"), F.col("m").alias("longest"), "second")
    pairs = items.select("video", "m", "category").join(sources, "category").filter(F.col("video") != F.col("source")).drop("category")
    own = trials.select("subject", F.col("video").alias("source"), F.col("n").alias("own"))
    asked = trials.join(pairs, "video").join(own, ["subject", "source"], "left")
    alone = (F.col("own") == F.col("longest")) & ((F.col("second") < F.col("longest")) | F.col("second").isNull())
    asked = asked.withColumn("len", F.when(alone, F.col("second")).otherwise(F.col("longest"))).filter("len > 0")
    at = lambda t: F.when(F.col("m") == 1, F.lit(0.0)).otherwise(t * (F.col("len") - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    block = lambda t: F.floor(F.floor(at(t)) / size)
    asked = asked.withColumn("tc", F.explode(F.sequence(F.lit(0).cast("long"), D.chunk_of(F.col("n") - 1, size))))
    asked = asked.withColumns({"first": F.col("tc") * size, "last": F.least((F.col("tc") + 1) * size, F.col("n")) - 1})
    asked = asked.withColumn("c", F.explode(F.sequence(block(F.col("first")), block(F.col("last"))))).select("subject", "source", "c", "video", "tc", "first", "last", "m", "len")
    mine = D.blocks(tr, ["subject", "video"], "t", AXES, 1, size).withColumnRenamed("video", "source")
    got = asked.join(mine, ["subject", "source", "c"], "left").join(
        middle_blocks(tr, size).withColumnsRenamed({"video": "source", **{name: f"mid_{name}" for name in AXES}}), ["source", "c"])

    def piece(name):
        start = F.greatest(F.col("c") * size - 1, F.lit(0))
        x = lambda t: others_at(F.get(f"mid_{name}", (t - start).cast("int")), F.get(name, (t - start).cast("int")))

        def value(t):
            low = F.floor(at(t))
            share = at(t) - low
            return F.when(F.floor(low / size) == F.col("c"), (1 - share) * x(low) + share * x(F.least(low + 1, F.col("len") - 1)))
        return F.transform(F.sequence("first", "last"), value).alias(name)
    pieces = got.select("subject", "video", "tc", F.struct("source", "c", *[piece(name) for name in AXES]).alias("p"))
    whole = pieces.groupBy("subject", "video", "tc").agg(F.sort_array(F.collect_list("p")).alias("p"))

    def mean(name):
        parts = F.col(f"p.{name}")

        def at_second(_x, i):
            known = F.filter(F.transform(parts, lambda a: F.get(a, i)), lambda v: v.isNotNull())
            return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))
        return F.transform(parts[0], at_second)
    axes = F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), mean(name).alias("prior")) for i, name in enumerate(AXES)]))
    opened = whole.select("subject", "video", "tc", axes.alias("s")).select("subject", "video", "s.axis", "tc", F.posexplode("s.prior").alias("i", "prior"))
    return opened.select(*K3, (F.col("tc") * size + F.col("i")).alias("t"), "prior")


@query("ts13_cross_fitted_prior", with_(TRACE, LONG, CROSSFIT) + f"SELECT l.subject, l.video, l.axis, l.t, {q6('tp.prior')} AS prior FROM long l JOIN tp ON tp.subject = l.subject AND tp.video = l.video AND tp.axis = l.axis AND tp.t = l.t")
def _(spark, sf):
    return cross_fitted_prior(A.trace(spark, sf)).select(*K3, "t", r6("prior"))


# ---- staged anchor selection -----------------------------------------------------------

def stage_errors(spark, sf):
    """Per trial the error after each stage, written once: choosing and scoring both read it."""
    def build():
        base = oof(spark, sf).select(*K3, "t", "fold", "value", "prior")
        a = anchors(spark, sf)
        fixed = bounded(base, a, 0.75, 0.25, 24.0).select(*K3, "t", "fixed")
        w = gaussian(near5(spark, sf), 20.0)
        src = long_rows(spark, sf).select(F.col("subject").alias("who"), "video", "axis", "t", "value")
        ret = w.join(src, ["who", "video", "axis"]).groupBy(*K3, "t").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("near"))
        fun = functional(spark, sf, 50.0, 2, 0.8, 30.0).select(*K3, "t", "correction")
        j = base.join(fixed, [*K3, "t"]).join(ret, [*K3, "t"], "left").join(fun, [*K3, "t"])
        near, moved = F.coalesce("near", "prior"), P.clip(F.col("prior") + F.col("correction"))
        forms = {"0_prior": F.col("prior"), "1_anchored": F.col("fixed"), "2_retrieval": P.clip(0.5 * F.col("fixed") + 0.5 * near), "3_ensemble": P.clip(0.5 * F.col("fixed") + 0.25 * near + 0.25 * moved)}
        return j.groupBy("fold", *K2).agg(*[F.avg(F.abs(e - F.col("value"))).alias(n) for n, e in forms.items()])
    return written(spark, "anchor_stage_errors", sf, build)


@query("cv6_nested_anchor_stages")
def _(spark, sf):
    """Prior, rating correction, retrieval and functional ensemble: each stage chosen on the other folds."""
    t = stage_errors(spark, sf)
    forms = [c for c in t.columns if c not in ("fold", *K2)]
    cells = t.groupBy("fold").agg(F.count(F.lit(1)).alias("k"), *[F.sum(n).alias(n) for n in forms])
    inner = Fo.to_training(cells, 5).groupBy("vfold").agg(*[(F.sum(n) / F.sum("k")).alias(n) for n in forms])
    # a later stage is kept only when it is better than every earlier one
    best = F.lit("0_prior")
    score = F.col("0_prior")
    for n in forms[1:]:
        best = F.when(F.col(n) < score, n).otherwise(best)
        score = F.least(score, F.col(n))
    pick = inner.select(F.col("vfold").alias("fold"), best.alias("stage"), score.alias("inner_mae"))
    own = t.unpivot(["fold", *K2], forms, "stage", "mae")
    return own.join(pick, ["fold", "stage"]).groupBy("fold", "stage").agg(F.count(F.lit(1)).alias("trials"), r6(F.max("inner_mae"), "inner_mae"), r6(F.avg("mae"), "outer_mae"))


# ---- item subsets ------------------------------------------------------------------------

SIZES = 8  # largest subset reported

SUB = f"""du AS (SELECT video, CAST(max(t) + 1 AS DOUBLE) AS d FROM trace GROUP BY 1),
s(k, video, total) AS (SELECT 1, video, d FROM du UNION ALL SELECT k + 1, du.video, total + d FROM s JOIN du ON du.video > s.video WHERE k < {SIZES})"""


@query("ag13_subset_burden", with_(TRACE, SUB).replace("WITH", "WITH RECURSIVE", 1) + f"""SELECT CAST(k AS BIGINT) AS k, count(*) AS subsets, {q6('avg(total) / 60')} AS expected, {q6('min(total) / 60')} AS low, {q6('max(total) / 60')} AS high,
 {q6('quantile_cont(total, 0.05) / 60')} AS p05, {q6('quantile_cont(total, 0.95) / 60')} AS p95 FROM s GROUP BY k""")
def _(spark, sf):
    """Distribution of total duration over every k-subset of items, without listing subsets.

    Each item is a tiny distribution over (taken, seconds); halves are merged in
    a tree, so subsets are counted, and a merge meets at most k * seconds states.
    """
    top = SIZES
    items = D.dense_index(A.trace(spark, sf), "video", F.substring("video", 1, 1), "node")
    dur = A.trace(spark, sf).groupBy("video").agg((F.max("t") + 1).alias("d")).join(items, "video")
    state = dur.select("node", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("total")), F.struct(F.lit(1).cast("long").alias("k"), F.col("d").alias("total")))).alias("s"),
                       F.lit(1).cast("long").alias("c")).select("node", "s.*", "c")
    levels = math.ceil(math.log2(max(items.count(), 2)))
    for _level in range(levels):
        up = F.floor(F.col("node") / 2).alias("up")
        left = state.filter("node % 2 = 0").select(up, F.col("k").alias("k1"), F.col("total").alias("t1"), F.col("c").alias("c1"))
        right = state.filter("node % 2 = 1").select(up, F.col("k").alias("k2"), F.col("total").alias("t2"), F.col("c").alias("c2"))
        j = left.join(right, "up", "left").filter(F.col("k1") + F.coalesce("k2", F.lit(0)) <= top)
        zero = lambda c, d: F.coalesce(c, F.lit(d).cast("long"))
        state = j.groupBy(F.col("up").alias("node"), (F.col("k1") + zero("k2", 0)).alias("k"), (F.col("t1") + zero("t2", 0)).alias("total")).agg(F.sum(F.col("c1") * zero("c2", 1)).alias("c"))
    s = state.filter("k > 0")
    q = lambda p: r6(F.percentile("total", F.lit(p), F.col("c")) / 60)
    return s.groupBy("k").agg(F.sum("c").alias("subsets"), r6(F.sum(F.col("c") * F.col("total")) / F.sum("c") / 60, "expected"), r6(F.min("total") / 60, "low"), r6(F.max("total") / 60, "high"), q(0.05).alias("p05"), q(0.95).alias("p95"))


# ---- full-pipeline bootstrap -----------------------------------------------------------

@query("bs8_full_pipeline_bootstrap")
def _(spark, sf):
    return full_pipeline(spark, sf, 2)


def full_pipeline(spark, sf, draws):
    """Resample the panel, rebuild every reference without the subject's copies, realign, re-estimate.

    A drawn panel is a multiplicity per subject.  A subject drawn m times has m
    equal values at a second, so leaving its identity out means skipping m equal
    entries of the sorted list; order statistics keyed by m give the median of
    the rest without listing the others per subject.
    """
    long = long_rows(spark, sf)
    p = D.dense_index(long, "subject", F.floor(F.col("subject") / 4096))
    n = p.agg(F.count(F.lit(1)).alias("n")).scalar()
    w = written(spark, f"panel_{draws}", sf, lambda: Rs.multiplicities(p, "idx", n, "fp", draws, "m").join(p, "idx").select("draw", "subject", "m"))
    rows = long.join(w, "subject")
    copies = rows.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select("draw", "video", "axis", "t", "value")
    skip = w.select("draw", "m").distinct()
    key = ["draw", "m", "video", "axis", "t"]
    m = F.col("m")
    ranks = {"a0": lambda k: F.floor((k - m - 1) / 2), "a1": lambda k: F.floor((k - m - 1) / 2) + m, "b0": lambda k: F.ceil((k - m - 1) / 2), "b1": lambda k: F.ceil((k - m - 1) / 2) + m}
    mid = D.order_statistics(copies.join(skip, "draw"), key, F.col("value"), ranks, total="_total")
    x = F.col("value")
    low, high = F.when(x > F.col("a0"), F.col("a0")).otherwise(F.col("a1")), F.when(x > F.col("b0"), F.col("b0")).otherwise(F.col("b1"))
    ref0 = rows.join(mid, key).filter(F.col("_total") > F.col("m")).withColumn("others", (low + high) / 2)
    dk = ["draw", *K3]
    ref = written(spark, f"panel_reference_{draws}", sf, lambda: P.smooth(ref0.select(*dk, "t", "value", "others"), dk, 3, {"others": "prior"}))
    mp = Al.align(ref, dk, DEFAULT)
    both = mp.groupBy("draw", *K2, "t").agg(F.max(F.when(F.col("axis") == 0, F.col("w"))).alias("wv"), F.max(F.when(F.col("axis") == 1, F.col("w"))).alias("wa"))
    c = D.running(both.withColumn("raw", Al.consensus(F.col("wv"), F.col("wa"))), ["draw", *K2], "t", F.col("raw"), "w", "max")
    q = c.groupBy("draw", *K2).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("x")).join(w, ["draw", "subject"])
    v = Rl.variance_components(q.withColumnRenamed("video", "item"), ["draw"], wp="m")
    return v.select("draw", r6("grand"), r6("var_subject"), r6("var_item"), r6("var_residual"), r6(Rl.relative_g(F.lit(15)), "relative_g"))


# ---- specification builders --------------------------------------------------------------

SPECS = [("current", 1), ("current", 3), ("current", 5)]


@query("uf1_spec_builders", with_(TRACE, LONG, CURVE, LEN) + " UNION ALL ".join(
    f"SELECT '{m}_r{r}' AS name, count(*) AS seconds, {q6(f'avg(p)')} AS mean_prior FROM (SELECT avg(x) OVER (PARTITION BY video, axis ORDER BY t ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS p FROM curve)" for m, r in SPECS))
def _(spark, sf):
    """Specs are rows of a candidate table; each builds its prior as a pure DataFrame function."""
    c = curves(spark, sf)
    parts = [P.smooth(c, ["video", "axis"], r, {"x": "p"}).select(F.lit(f"{m}_r{r}").alias("name"), "p") for m, r in SPECS]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("name").agg(F.count(F.lit(1)).alias("seconds"), r6(F.avg("p"), "mean_prior"))
