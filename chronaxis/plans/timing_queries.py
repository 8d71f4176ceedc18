"""Timing studies: alignment to group references and what is made of it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import align as Al
from ..operators import distributed as D
from ..operators import priors as P
from ..operators import reliability as Rl
from ..operators import resample as Rs
from ..operators import windows as Wn
from ..sources import adapters as A
from ..sources.shared import parked, written
from .base_queries import oof
from .prior_queries import K3, loo
from .registry import query, r6
from .window_queries import peaks, template

K2 = ["subject", "video"]
DEFAULT = Al.WarpSettings()


def held_out_rows(spark, sf):
    return oof(spark, sf).select(*K3, "t", "fold", "value", "prior")


def row_blocks(spark, sf):
    """Values and references of every trial as arrays; the reference reaches as far as a mapping may."""
    return written(spark, "row_blocks", sf, lambda: Al.trial_blocks(held_out_rows(spark, sf), [*K3, "fold"], halo=DEFAULT.band))


def signal_blocks(spark, sf, s=DEFAULT):
    """Alignment signals of every trial; settings with equal smoothing share them."""
    name = f"signals_r{s.radius}_{'d' if s.derivative else 'l'}"
    return written(spark, name, sf, lambda: Al.signal_blocks(row_blocks(spark, sf), K3, s))


def signal_rows(spark, sf, s=DEFAULT):
    """Alignment signals per second."""
    return Al.signal_seconds(signal_blocks(spark, sf, s), K3)


def solved(spark, sf):
    """Every trial's axis solved against its held-out reference."""
    return written(spark, "solved", sf, lambda: Al.solve_blocks(signal_blocks(spark, sf), K3, DEFAULT))


def mappings(spark, sf):
    """Axis mappings of every trial to its held-out reference, per second."""
    return Al.seconds(solved(spark, sf), K3)


def by_objective(spark, sf):
    """Solved trials and chunks under each objective."""
    def build():
        from functools import reduce
        return reduce(lambda a, b: a.unionByName(b), [
            Al.solve_blocks(signal_blocks(spark, sf), K3, Al.WarpSettings(objective=o)).withColumn("objective", F.lit(o))
            for o in ("direct_step", "step_zero", "path_mean", "mixed_step_mean")])
    return written(spark, "by_objective", sf, build)


def joint_lags(spark, sf):
    """Mean absolute lag of one mapping from both axes together."""
    def build():
        joint = parked(Al.join_axes(signal_blocks(spark, sf), K2), "joint-signals")
        m = Al.seconds(Al.solved_once(joint, K2, DEFAULT), K2)
        return m.groupBy(*K2).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("multivariate"))
    return written(spark, "joint_lags", sf, build)


SERIES = ("v", "a", "pv", "pa", "wv", "wa", "w", "pv_v", "pa_v", "pv_a", "pa_a", "pv_c", "pa_c")


def timed_blocks(spark, sf):
    """(subject, video, start, fold, n, series..): everything a trial's seconds have, as arrays by block.

    Values v, a; references pv, pa; both axis mappings wv, wa and their consensus w,
    which is monotone because they are; the references read at each of them.
    """
    def build():
        side = lambda c, a: F.max(F.when(F.col("axis") == a, F.col(c)))
        rows = row_blocks(spark, sf).groupBy(*K2, "start", "lead", "fold").agg(side("value", 0).alias("v"), side("value", 1).alias("a"), side("prior", 0).alias("rv"), side("prior", 1).alias("ra"))
        maps = Al.mapped(solved(spark, sf), K3).groupBy(*K2, "start").agg(side("w", 0).alias("wv"), side("w", 1).alias("wa"))
        j = rows.join(maps, [*K2, "start"]).withColumn("w", F.zip_with("wv", "wa", Al.consensus))
        read = lambda r, w: F.transform(w, lambda x: F.get(F.col(r), (x - F.col("start") + F.col("lead")).cast("int")))
        size = F.size("v")
        own = [F.slice(r, F.col("lead") + 1, size).alias(f"p{r[1]}") for r in ("rv", "ra")]
        moved = [read(r, w).alias(f"p{r[1]}_{k}") for w, k in (("wv", "v"), ("wa", "a"), ("w", "c")) for r in ("rv", "ra")]
        n = F.max(F.col("start") + size).over(Window.partitionBy(*K2))
        return j.select(*K2, "start", "fold", n.alias("n"), "v", "a", *own, "wv", "wa", "w", *moved)
    return written(spark, "timed_blocks", sf, build)


def by_second(blocks, series, *keep):
    """Blocks second by second, without an exchange."""
    rows = blocks.select(*keep, "start", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size(series[0]) - 1).alias("_i"), *series)).alias("_s"))
    return rows.select(*keep, (F.col("start") + F.col("_s._i")).alias("t"), *[F.col(f"_s.{c}").alias(c) for c in series])


def timed(spark, sf):
    """(subject, video, t, wv, wa, w): both axis mappings and the monotone consensus."""
    return by_second(timed_blocks(spark, sf), ("wv", "wa", "w"), *K2)


@query("ts6_banded_mapping")
def _(spark, sf):
    return mappings(spark, sf)


@query("uf2_alignment_jobs")
def _(spark, sf):
    m = mappings(spark, sf)
    return m.groupBy(*K3).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("t") - F.col("w"))).alias("widest"))


@query("ts7_alignment_objectives")
def _(spark, sf):
    c = Al.costs(by_objective(spark, sf), ["objective", *K3])
    step = F.when(F.col("objective") == "step_zero", 0.0).when(F.col("objective") == "mixed_step_mean", 0.05 / F.col("path_length")).otherwise(0.05)
    per = (F.col("local_cost") + F.col("warp_cost") + step * F.col("steps")) / F.col("path_length")
    return c.select("objective", *K3, r6("local_cost"), r6("warp_cost"), "steps", "path_length", r6(per, "cost_per_node"))


def moved_reference(spark, sf):
    """Each second with the reference read at the mapped seconds."""
    return by_second(timed_blocks(spark, sf), SERIES, *K2, "fold", "n")


def reference_events(spark, sf):
    """(fold, video, n, t, event): seconds of strong change of the reference.

    A reference is the same for all trials of its fold, item and length, so one of them stands for all.
    """
    t = timed_blocks(spark, sf)
    like = ["fold", "video", "n"]
    one = t.groupBy(*like).agg(F.min("subject").alias("subject"))
    rows = by_second(t.join(one, [*like, "subject"]), ("pv", "pa"), *like)
    g = Wn.add_gradient(rows, like, {"pv": "gv", "pa": "ga"})
    return Wn.event_mask(g.withColumn("g", F.round(F.sqrt(F.col("gv") ** 2 + F.col("ga") ** 2), 6)), like, "g").select(*like, "t", "event")


@query("jn14_reference_at_mapping")
def _(spark, sf):
    return moved_reference(spark, sf).select(*K2, "t", "w", r6("pv_c", "valence_reference"), r6("pa_c", "arousal_reference"))


def decomposition(spark, sf):
    def build():
        events = written(spark, "reference_events", sf, lambda: reference_events(spark, sf))
        packed = D.blocks(events, ["fold", "video", "n"], "t", ["event"], 0, Al.LONG)
        packed = packed.select("fold", "video", "n", (F.col("c") * Al.LONG).alias("start"), "event")
        j = by_second(timed_blocks(spark, sf).join(packed, ["fold", "video", "n", "start"]), (*SERIES, "event"), *K2, "fold")
        lag = F.col("t") - F.col("w")
        j = j.withColumn("lag", lag).withColumn("amp", (F.abs(F.col("v") - F.col("pv_c")) + F.abs(F.col("a") - F.col("pa_c"))) / 2)
        mad = lambda x, y: F.avg(F.abs(F.col(x) - F.col(y)))
        on = lambda c, e: F.avg(F.when(F.col("event") == e, c))
        out = j.groupBy(*K2).agg(
            F.count(F.lit(1)).alias("n"), F.max("fold").alias("fold"),
            mad("v", "pv").alias("baseline_valence"), mad("a", "pa").alias("baseline_arousal"),
            mad("v", "pv_a").alias("valence_from_arousal"), mad("a", "pa_v").alias("arousal_from_valence"),
            mad("v", "pv_v").alias("self_valence"), mad("a", "pa_a").alias("self_arousal"),
            F.avg(F.abs("lag")).alias("q"), F.avg("lag").alias("b"),
            F.avg(F.abs(F.col("wv") - F.col("wa"))).alias("axis_disagreement"),
            F.avg(F.abs(F.col("t") - F.col("wv"))).alias("q_valence"), F.avg(F.abs(F.col("t") - F.col("wa"))).alias("q_arousal"),
            F.avg("amp").alias("amplitude"), on(F.abs("lag"), True).alias("event_lag"), on(F.abs("lag"), False).alias("stable_lag"),
            on(F.col("amp"), True).alias("event_amplitude"), on(F.col("amp"), False).alias("stable_amplitude"))
        med = D.quantiles(timed(spark, sf), K2, lag, {"median_lag": 0.5}).select(*K2, "median_lag")
        return out.join(med, K2).withColumn("gain_valence", F.col("baseline_valence") - F.col("valence_from_arousal")).withColumn(
            "gain_arousal", F.col("baseline_arousal") - F.col("arousal_from_valence")).withColumn(
            "gain", (F.col("gain_valence") + F.col("gain_arousal")) / 2)
    return written(spark, "decomposition", sf, build)


@query("ts9_trial_decomposition")
def _(spark, sf):
    d = decomposition(spark, sf)
    return d.select(*K2, "n", *[r6(c) for c in d.columns if c not in (*K2, "n", "fold")])


@query("ag5_trial_lags")
def _(spark, sf):
    return decomposition(spark, sf).select(*K2, r6("q"), r6("b"))


@query("dq10_target_invariant")
def _(spark, sf):
    d = decomposition(spark, sf)
    t = timed(spark, sf).groupBy(*K2).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("q2"), F.avg(F.col("t") - F.col("w")).alias("b2"))
    j = d.join(t, K2)
    return j.agg(F.count(F.lit(1)).alias("trials"), F.count_if(F.col("q") + 1e-9 < F.abs("b")).alias("violations"),
                 r6(F.max(F.abs(F.col("q") - F.col("q2"))), "max_q_difference"), r6(F.max(F.abs(F.col("b") - F.col("b2"))), "max_b_difference"))


@query("ts10_lag_estimands")
def _(spark, sf):
    joint = joint_lags(spark, sf)
    d = decomposition(spark, sf)
    return d.join(joint, K2).select(*K2, r6("q", "consensus"), r6((F.col("q_valence") + F.col("q_arousal")) / 2, "axis_mean"), r6("multivariate"),
                                    r6("q_valence", "valence_only"), r6("q_arousal", "arousal_only"))


def loo_rows(spark, sf):
    """Every trial with the smoothed median of all other subjects as its reference."""
    l = loo(spark, sf)
    smooth = P.smooth(l, K3, 3, {"others": "prior"})
    # a trial may end in seconds only it has; positions stay contiguous from 0
    return smooth.select(*K3, "t", "value", "prior")


@query("ts22_reference_deviation")
def _(spark, sf):
    return lopo_matrix(spark, sf).select(*K2, r6("q"), r6("b"))


def lopo_matrix(spark, sf):
    def build():
        ref = written(spark, "loo_reference", sf, lambda: loo_rows(spark, sf))
        m = Al.align(ref, K3, DEFAULT)
        both = m.groupBy(*K2, "t").agg(F.max(F.when(F.col("axis") == 0, F.col("w"))).alias("wv"), F.max(F.when(F.col("axis") == 1, F.col("w"))).alias("wa"))
        c = D.running(both.withColumn("raw", Al.consensus(F.col("wv"), F.col("wa"))), K2, "t", F.col("raw"), "w", "max")
        return c.groupBy(*K2).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("q"), F.avg(F.col("t") - F.col("w")).alias("b"))
    return written(spark, "lopo", sf, build)


@query("ts20_fold_safe_targets")
def _(spark, sf):
    val = decomposition(spark, sf).select("fold", F.lit("validation").alias("role"), *K2, "q", "b")
    train = lopo_matrix(spark, sf).join(A.subject_folds(A.trace(spark, sf)), "subject").select("fold", F.lit("training").alias("role"), *K2, "q", "b")
    return val.unionByName(train).select("fold", "role", *K2, r6("q"), r6("b"))


@query("cq7_timing_study")
def timing_study(spark, sf):
    """Held-out lags and cross-axis gains with subject-level intervals and a sign-flip test."""
    d = decomposition(spark, sf)
    s = d.groupBy("subject").agg(F.avg("gain").alias("x"))
    s = s.join(D.dense_index(s, "subject", F.floor(F.col("subject") / 4096)), "subject")
    n = s.agg(F.count(F.lit(1)).alias("n"))
    i = Rs.interval(Rs.bootstrap_mean(s, "idx", "x", n.scalar(), "tm", 200))
    obs = s.agg(F.avg("x").alias("m"))
    flip = F.when(Rs.hash_value("tf", F.col("draw"), F.col("subject")) % 2 == 0, F.col("x")).otherwise(-F.col("x"))
    null = s.withColumn("draw", Rs.draws(200)).groupBy("draw").agg(F.avg(flip).alias("z"))
    p = null.agg(((1.0 + F.count_if(F.abs("z") >= F.abs(obs.scalar()))) / 201).alias("p"))
    t = d.agg(F.count(F.lit(1)).alias("trials"), F.avg("q").alias("mean_q"), F.avg("b").alias("mean_b"))
    return i.select(r6(obs.scalar(), "mean_gain"), r6("low"), r6("high"), r6(p.scalar(), "p"), t.select("trials").scalar().alias("trials"),
                    r6(t.select("mean_q").scalar(), "mean_q"), r6(t.select("mean_b").scalar(), "mean_b"))


@query("cq10_alignment_sensitivity")
def _(spark, sf):
    from functools import reduce
    settings = {
        "primary": Al.WarpSettings(), "band_5": Al.WarpSettings(band=5), "band_15": Al.WarpSettings(band=15),
        "warp_low": Al.WarpSettings(warp_penalty=0.05), "warp_high": Al.WarpSettings(warp_penalty=0.30),
        "step_low": Al.WarpSettings(step_penalty=0.0), "step_high": Al.WarpSettings(step_penalty=0.15),
        "radius_0": Al.WarpSettings(radius=0), "level": Al.WarpSettings(derivative=False)}
    parts = []
    for name, s in settings.items():
        m = Al.seconds(Al.solved_once(signal_blocks(spark, sf, s), K3, s), K3).groupBy(*K2).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("q"))
        parts.append(m.withColumn("setting", F.lit(name)))
    stack = reduce(lambda a, b: a.unionByName(b), parts)
    base = parts[0].select(*K2, F.col("q").alias("q0"))
    return stack.join(base, K2).groupBy("setting").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("q"), "mean_q"), r6(S.correlation("q", "q0"), "agreement"),
                                                      r6(F.avg(F.abs(F.col("q") - F.col("q0"))), "mean_shift"))


@query("cq11_high_change_contrast")
def _(spark, sf):
    from .window_queries import matched_controls
    pairs = matched_controls(template(spark, sf))
    lag = timed(spark, sf).select(*K2, "t", F.abs(F.col("t") - F.col("w")).alias("l"))
    peak = lag.withColumnRenamed("t", "peak").withColumnRenamed("l", "lp")
    ctrl = lag.withColumnRenamed("t", "control").withColumnRenamed("l", "lc")
    j = pairs.join(peak, ["video", "peak"]).join(ctrl, ["subject", "video", "control"])
    s = j.groupBy("subject").agg(F.avg(F.col("lp") - F.col("lc")).alias("d"))
    return s.agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("d"), "contrast"), r6(F.stddev_pop("d"), "spread"))


@query("cq12_own_versus_other_warp")
def _(spark, sf):
    return own_other(spark, sf).groupBy("fold").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("own_gain"), "own_gain"), r6(F.avg("other_gain"), "other_gain"),
                                                   r6(F.avg(F.col("own_gain") - F.col("other_gain")), "advantage"))


def own_other(spark, sf):
    """Gain with the subject's own warp against the mean over all other donors' warps.

    A donor's mapping only matters through the reference second it names, so
    donors are counted per (fold, video, t, mapped second).  A receiver second
    meets at most 2*band+1 counted seconds instead of every donor, and its own
    vote is taken off.
    """
    def build():
        r = moved_reference(spark, sf)
        cell = ["fold", "video", "t"]
        curve = r.groupBy("fold", "video", "t").agg(F.max("pv").alias("pv"), F.max("pa").alias("pa"))
        votes_a = r.groupBy(*cell, F.col("wa").alias("w")).agg(F.count(F.lit(1)).alias("k"))
        votes_v = r.groupBy(*cell, F.col("wv").alias("w")).agg(F.count(F.lit(1)).alias("k"))
        at = curve.withColumnRenamed("t", "w")
        va = votes_a.join(at.select("fold", "video", "w", F.col("pv").alias("x")), ["fold", "video", "w"])
        vv = votes_v.join(at.select("fold", "video", "w", F.col("pa").alias("x")), ["fold", "video", "w"])
        la = va.groupBy(*cell).agg(F.collect_list(F.struct("x", "k")).alias("la"))
        lv = vv.groupBy(*cell).agg(F.collect_list(F.struct("x", "k")).alias("lv"))
        j = r.join(la, cell).join(lv, cell)

        def total(lst, x):
            return F.aggregate(lst, F.lit(0.0), lambda s, e: s + e["k"] * F.abs(F.col(x) - e["x"]))

        count = lambda lst: F.aggregate(lst, F.lit(0).cast("long"), lambda s, e: s + e["k"])
        own_v, own_a = F.abs(F.col("v") - F.col("pv_a")), F.abs(F.col("a") - F.col("pa_v"))
        n = count("la") - 1
        sec = j.select(*K2, "fold", F.abs(F.col("v") - F.col("pv")).alias("bv"), F.abs(F.col("a") - F.col("pa")).alias("ba"), own_v.alias("sv"), own_a.alias("sa"),
                       F.try_divide(total("la", "v") - own_v, n).alias("dv"), F.try_divide(total("lv", "a") - own_a, n).alias("da"))
        t = sec.groupBy(*K2, "fold").agg(*[F.avg(c).alias(c) for c in ("bv", "ba", "sv", "sa", "dv", "da")])
        return t.select(*K2, "fold", ((F.col("bv") - F.col("sv") + F.col("ba") - F.col("sa")) / 2).alias("own_gain"),
                        ((F.col("bv") - F.col("dv") + F.col("ba") - F.col("da")) / 2).alias("other_gain"))
    return written(spark, "own_other", sf, build)


@query("cq15_lopo_reliability")
def _(spark, sf):
    m = Rl.centred(lopo_matrix(spark, sf).withColumnRenamed("video", "item"), "q")
    c = Rl.variance_components(m, x="q")
    k = Rl.curve(c, 15)
    return k.select("k", r6("var_subject"), r6("var_item"), r6("var_residual"), r6("relative_g"), r6("absolute_phi"))


@query("cq17_estimand_reliability")
def _(spark, sf):
    d = decomposition(spark, sf)
    joint = joint_lags(spark, sf)
    w = d.join(joint, K2).select("subject", F.col("video").alias("item"), F.col("q").alias("consensus"), ((F.col("q_valence") + F.col("q_arousal")) / 2).alias("axis_mean"),
                                 "multivariate", F.col("q_valence").alias("valence_only"), F.col("q_arousal").alias("arousal_only"))
    long = w.unpivot(["subject", "item"], ["consensus", "axis_mean", "multivariate", "valence_only", "arousal_only"], "estimand", "x")
    c = Rl.variance_components(long, ["estimand"])
    return c.select("estimand", r6("grand"), r6("var_subject"), r6("var_item"), r6("var_residual"), r6(Rl.relative_g(F.lit(15)), "relative_g"))


@query("cq18_objective_audit")
def _(spark, sf):
    key = ["objective", *K3]
    solved = by_objective(spark, sf)
    q = Al.seconds(solved, key).groupBy(*key).agg(F.avg(F.abs(F.col("t") - F.col("w"))).alias("q"))
    s = Al.costs(solved, key).join(q, key)
    return s.groupBy("objective").agg(F.count(F.lit(1)).alias("mappings"), r6(F.avg("q"), "mean_q"), r6(F.avg("steps"), "mean_steps"), r6(F.avg("path_length"), "mean_path"),
                                      r6(F.avg(F.col("local_cost") / F.col("path_length")), "local_per_node"))


@query("bs10_circular_null")
def _(spark, sf):
    return circular_null(spark, sf, 3)


def circular_null(spark, sf, bank):
    """Cross-axis gain after each axis is rolled by its own hash-chosen shift."""
    rows = held_out_rows(spark, sf)
    n = rows.groupBy(*K2).agg((F.max("t") + 1).alias("n"))
    j = D.attach(rows.withColumn("bank", Rs.draws(bank)), n, K2)
    least = F.least(F.lit(11), F.greatest(F.floor(F.col("n") / 4), F.lit(1)))
    spread = F.greatest(F.col("n") - 2 * least, F.lit(1))
    shift = least + Rs.hash_value("cs", F.col("bank"), F.col("subject"), F.col("video"), F.col("axis")) % spread
    rolled = j.withColumn("to", (F.col("t") + shift) % F.col("n"))
    key = ["bank", *K3]
    moved = rolled.select(*key, F.col("to").alias("t"), F.col("value").alias("rolled"))
    both = written(spark, f"rolled_{bank}", sf, lambda: j.select(*key, "t", "value", "prior").join(moved, [*key, "t"]))
    m = Al.align(both, key, DEFAULT, "rolled", "prior")
    other = m.withColumn("axis", 1 - F.col("axis"))
    ref = rows.select(*K3, F.col("t").alias("w"), F.col("prior").alias("moved"))
    g = both.join(other, [*key, "t"]).join(ref, [*K3, "w"]).groupBy("bank", *K2).agg(
        (F.avg(F.abs(F.col("value") - F.col("prior"))) - F.avg(F.abs(F.col("value") - F.col("moved")))).alias("gain"))
    return g.groupBy("bank").agg(F.count(F.lit(1)).alias("trials"), r6(F.avg("gain"), "null_gain"))


@query("bs11_donor_reassignment")
def _(spark, sf):
    """Mean advantage of the own warp when donors are a one-to-one derangement."""
    d = decomposition(spark, sf).select(*K2, "fold")
    draws = 4
    key = ["draw", "fold", "video"]
    r = Rs.shuffled_rank(d.withColumn("draw", Rs.draws(draws)), key, ["dr", F.col("draw"), F.col("subject"), F.col("video")], "subject", "k")
    n = r.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    r = r.join(n, key)
    donors = r.select(*key, F.col("k").alias("dk"), F.col("subject").alias("donor"))
    pairs = r.withColumn("dk", F.col("k") % F.col("n") + 1).join(donors, [*key, "dk"]).filter("donor <> subject").select("draw", "fold", "video", "subject", "donor")
    # receiver and donor share fold and item, so the donor has read the receiver's reference at its own mappings
    t = timed_blocks(spark, sf)
    donated = t.select(F.col("subject").alias("donor"), "video", "start", F.col("pv_a").alias("pv_d"), F.col("pa_v").alias("pa_d"))
    j = pairs.join(t.select(*K2, "start", "v", "a"), K2).join(donated, ["donor", "video", "start"])
    j = by_second(j, ("v", "a", "pv_d", "pa_d"), "draw", *K2).filter("v IS NOT NULL AND pv_d IS NOT NULL")
    e = j.groupBy("draw", *K2).agg(((F.avg(F.abs(F.col("v") - F.col("pv_d"))) + F.avg(F.abs(F.col("a") - F.col("pa_d")))) / 2).alias("other"))
    own = decomposition(spark, sf).select(*K2, ((F.col("valence_from_arousal") + F.col("arousal_from_valence")) / 2).alias("own"))
    s = e.join(own, K2).groupBy("draw").agg(F.avg(F.col("other") - F.col("own")).alias("x"))
    return s.agg(r6(F.avg("x"), "mean_advantage"), r6((1.0 + F.count_if(F.col("x") <= 0)) / (draws + 1), "p"))


@query("cv11_reference_panels")
def _(spark, sf):
    """Agreement of references built from smaller training panels with the full one."""
    from ..operators.folds import to_training
    tr = A.trace(spark, sf)
    long = A.long_axes(tr, *K2, "t").join(A.subject_folds(tr), "subject")
    train = to_training(long, 5)
    rank = F.pmod(Rs.hash_value("pn", F.col("vfold"), F.col("subject")), F.lit(100))
    panel = train.withColumn("share", F.explode(F.array(F.lit(25), F.lit(50), F.lit(100)))).filter(rank < F.col("share"))
    curve = P.population_curve(panel, ["share", "vfold", "video", "axis"])
    full = curve.filter("share = 100").select("vfold", "video", "axis", "t", F.col("med").alias("full"))
    return curve.join(full, ["vfold", "video", "axis", "t"]).groupBy("share").agg(F.count(F.lit(1)).alias("seconds"), r6(F.avg(F.abs(F.col("med") - F.col("full"))), "mean_shift"),
                                                                                 r6(S.correlation("med", "full"), "agreement"))
