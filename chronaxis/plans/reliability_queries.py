"""Reliability, resampling and inference on the subject x item matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distributed as D
from ..operators import reliability as Rl
from ..operators import resample as Rs
from ..sources import adapters as A
from ..sources.tables import read
from .registry import MATRIX, TRACE, draw_sql, q6, query, r6, with_
from .scalar_queries import CORR, WILSON

MX = with_(MATRIX)
PID = "pid AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS idx, count(*) OVER () AS n FROM (SELECT DISTINCT subject FROM matrix))"
VID = "vid AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS vdx, count(*) OVER () AS n FROM (SELECT DISTINCT item FROM matrix))"
SMEAN = "smean AS (SELECT subject, avg(x) AS x FROM matrix GROUP BY 1)"


def hash_sql(*parts):
    return f"CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


def comp_sql(src, keys="", wp="1", wv="1"):
    """Components with weights, by definition: weighted means, then squared deviations."""
    k = f"{keys}, " if keys else ""
    using = f"USING ({keys})" if keys else "ON true"
    part = f"PARTITION BY {keys}" if keys else ""
    part_s, part_i = (f"PARTITION BY {keys}, subject", f"PARTITION BY {keys}, item") if keys else ("PARTITION BY subject", "PARTITION BY item")
    return f"""SELECT {k} max(PP) AS P, max(VV) AS V, max(g) AS grand,
  max(VV) * sum(wp * wv * pow(pm - g, 2)) / max(VV) / (max(PP) - 1) AS ms_subject,
  max(PP) * sum(wp * wv * pow(vm - g, 2)) / max(PP) / (max(VV) - 1) AS ms_item,
  sum(wp * wv * pow(x - pm - vm + g, 2)) / ((max(PP) - 1) * (max(VV) - 1)) AS ms_residual
 FROM (SELECT *, sqrt(sum(wp * wv) OVER ({part}) * (sum(wp) OVER ({part_i})) / (sum(wv) OVER ({part_s}))) AS PP,
   sum(wv) OVER ({part_s}) AS VV, sum(wv * x) OVER ({part_s}) / sum(wv) OVER ({part_s}) AS pm,
   sum(wp * x) OVER ({part_i}) / sum(wp) OVER ({part_i}) AS vm, sum(wp * wv * x) OVER ({part}) / sum(wp * wv) OVER ({part}) AS g
  FROM (SELECT *, CAST({wp} AS DOUBLE) AS wp, CAST({wv} AS DOUBLE) AS wv FROM {src}))
 {'GROUP BY ' + keys if keys else ''}"""


TRUNC = """*, (ms_subject - ms_residual) / V AS raw_subject, (ms_item - ms_residual) / P AS raw_item, greatest((ms_subject - ms_residual) / V, 0) AS var_subject,
 greatest((ms_item - ms_residual) / P, 0) AS var_item, greatest(ms_residual, 0) AS var_residual"""
COMP = f"comp AS (SELECT {TRUNC} FROM ({comp_sql('matrix')}))"
G = "CASE WHEN var_subject + var_residual / {k} > 0 THEN var_subject / (var_subject + var_residual / {k}) ELSE 0 END"
PHI = "CASE WHEN var_subject + (var_item + var_residual) / {k} > 0 THEN var_subject / (var_subject + (var_item + var_residual) / {k}) ELSE 0 END"


def mx(spark, sf):
    return A.rating_matrix(spark, sf)


def comp(spark, sf):
    return Rl.variance_components(Rl.centred(mx(spark, sf)))


def indexed(spark, sf):
    """Matrix plus dense subject and item indices and both counts."""
    m = mx(spark, sf)
    p = D.dense_index(m, "subject", F.floor(F.col("subject") / 4096))
    v = D.dense_index(m, "item", F.floor(F.col("item") / 4096), "vdx")
    return m, p, v


def count_of(df):
    return df.agg(F.count(F.lit(1)).alias("c")).scalar()


@query("ag18_variance_components", with_(MATRIX, COMP) + "SELECT CAST(P AS BIGINT) AS subjects, CAST(V AS BIGINT) AS items, " + ", ".join(
    f"{q6(c)} AS {c}" for c in ("ms_subject", "ms_item", "ms_residual", "raw_subject", "raw_item", "var_subject", "var_item", "var_residual")) + " FROM comp")
def _(spark, sf):
    return comp(spark, sf).select(F.col("P").cast("long").alias("subjects"), F.col("V").cast("long").alias("items"), *[
        r6(c) for c in ("ms_subject", "ms_item", "ms_residual", "raw_subject", "raw_item", "var_subject", "var_item", "var_residual")])


@query("sc14_sc15_reliability_curve", with_(MATRIX, COMP) + f"SELECT k, {q6(G.format(k='k'))} AS relative_g, {q6(PHI.format(k='k'))} AS absolute_phi FROM comp, (SELECT unnest(range(1, 16)) AS k)")
def _(spark, sf):
    return Rl.curve(comp(spark, sf), 15).select("k", r6("relative_g"), r6("absolute_phi"))


@query("tk5_items_required", with_(MATRIX, COMP) + f"""SELECT CAST(thr AS DOUBLE) AS threshold, min(k) FILTER ({G.format(k='k')} >= thr) AS relative_k, min(k) FILTER ({PHI.format(k='k')} >= thr) AS absolute_k
FROM comp, (SELECT unnest(range(1, 101)) AS k), (SELECT unnest([0.05, 0.1, 0.2, 0.7]) AS thr) GROUP BY thr""")
def _(spark, sf):
    c = Rl.curve(comp(spark, sf), 100).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.05, 0.1, 0.2, 0.7)))))
    first = lambda m: F.min(F.when(F.col(m) >= F.col("threshold"), F.col("k")))
    return c.groupBy("threshold").agg(first("relative_g").alias("relative_k"), first("absolute_phi").alias("absolute_k"))


CUBE = "cube AS (SELECT l_suppkey AS subject, l_returnflag AS category, CAST(year(l_shipdate) AS INTEGER) AS item, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2, 3)"
AG19 = """w AS (SELECT *, avg(x) OVER () AS g, avg(x) OVER (PARTITION BY subject) AS pm, avg(x) OVER (PARTITION BY category) AS cm, avg(x) OVER (PARTITION BY category, item) AS vm, avg(x) OVER (PARTITION BY subject, category) AS pcm FROM cube),
s AS (SELECT count(DISTINCT subject) AS P, count(DISTINCT category) AS C, count(*) / count(DISTINCT subject) / count(DISTINCT category) AS V, sum(pow(pm - g, 2)) AS ssp, sum(pow(cm - g, 2)) AS ssc, sum(pow(vm - cm, 2)) AS ssv, sum(pow(pcm - pm - cm + g, 2)) AS sspc, sum(pow(x - (pcm + vm - cm), 2)) AS ssr FROM w),
m AS (SELECT *, ssp / (P - 1) AS msp, ssv / (C * (V - 1)) AS msv, sspc / ((P - 1) * (C - 1)) AS mspc, ssr / ((P - 1) * C * (V - 1)) AS msr FROM s)"""


@query("ag19_category_components", with_(CUBE, AG19) + f"SELECT {q6('(msp - mspc) / (C * V)')} AS raw_participant, {q6('(msv - msr) / P')} AS raw_item_in_category, {q6('(mspc - msr) / V')} AS raw_participant_by_category, {q6('msr')} AS raw_residual, {q6('ssc')} AS category_ss FROM m")
def _(spark, sf):
    c = category_components(category_cube(spark, sf))
    return c.select(r6("raw_participant"), r6("raw_item_in_category"), r6("raw_participant_by_category"), r6("raw_residual"), r6("category_ss"))


def category_cube(spark, sf):
    return read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.col("l_returnflag").alias("category"),
                                               F.year("l_shipdate").alias("item")).agg(F.avg("l_quantity").alias("x"))


def category_components(cube):
    """Participant, item-in-category, participant x category and residual components.

    All means come from one GROUPING SETS pass over the centred cells; sums of
    squares follow from the sums of squared means of the balanced design.
    """
    c = Rl.centred(cube)
    gs = c.groupingSets([["subject"], ["category"], ["category", "item"], ["subject", "category"], []], "subject", "category", "item").agg(
        F.grouping_id().alias("gid"), F.avg("x").alias("mu"), F.count(F.lit(1)).alias("k"), F.sum(F.col("x") ** 2).alias("xx"))
    # grouping ids of (subject, category, item): 3 subject, 5 category, 4 category+item, 1 subject+category, 7 all
    at = lambda g, e: F.sum(F.when(F.col("gid") == g, e))
    sq = F.col("mu") ** 2 * F.col("k")
    s = gs.agg(at(3, sq).alias("q_p"), at(5, sq).alias("q_c"), at(4, sq).alias("q_v"), at(1, sq).alias("q_pc"), at(7, F.col("xx")).alias("q_t"),
               at(7, sq).alias("q_g"), F.count_if(F.col("gid") == 3).alias("n_p"), F.count_if(F.col("gid") == 5).alias("n_c"),
               F.count_if(F.col("gid") == 4).alias("n_cv"))
    P, C, V = F.col("n_p"), F.col("n_c"), F.col("n_cv") / F.col("n_c")
    ssp, ssc, ssv = F.col("q_p") - F.col("q_g"), F.col("q_c") - F.col("q_g"), F.col("q_v") - F.col("q_c")
    sspc = F.col("q_pc") - F.col("q_p") - F.col("q_c") + F.col("q_g")
    ssr = F.col("q_t") - F.col("q_pc") - F.col("q_v") + F.col("q_c")
    m = s.select(P.alias("P"), C.alias("C"), V.alias("V"), ssc.alias("category_ss"), (ssp / (P - 1)).alias("msp"), (ssv / (C * (V - 1))).alias("msv"),
                 (sspc / ((P - 1) * (C - 1))).alias("mspc"), (ssr / ((P - 1) * C * (V - 1))).alias("msr"))
    return m.select("*", ((F.col("msp") - F.col("mspc")) / (F.col("C") * F.col("V"))).alias("raw_participant"),
                    ((F.col("msv") - F.col("msr")) / F.col("P")).alias("raw_item_in_category"),
                    ((F.col("mspc") - F.col("msr")) / F.col("V")).alias("raw_participant_by_category"), F.col("msr").alias("raw_residual"))


@query("cq19_category_reliability", with_(CUBE, AG19) + f""", r AS (SELECT k, greatest((msp - mspc) / (C * V), 0) AS p, greatest((mspc - msr) / V, 0) / C + msr / (C * k) AS rel, greatest((msv - msr) / P, 0) / (C * k) AS extra FROM m, (SELECT unnest(range(1, 9)) AS k))
SELECT k, {q6('CASE WHEN p + rel > 0 THEN p / (p + rel) ELSE 0 END')} AS relative_g, {q6('CASE WHEN p + rel + extra > 0 THEN p / (p + rel + extra) ELSE 0 END')} AS absolute_phi FROM r""")
def _(spark, sf):
    z = F.lit(0.0)
    c = category_components(category_cube(spark, sf)).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(8).cast("long"))))
    p = F.greatest("raw_participant", z)
    rel = F.greatest("raw_participant_by_category", z) / F.col("C") + F.col("msr") / (F.col("C") * F.col("k"))
    extra = F.greatest("raw_item_in_category", z) / (F.col("C") * F.col("k"))
    return c.select("k", r6(F.when(p + rel > 0, p / (p + rel)).otherwise(0.0), "relative_g"),
                    r6(F.when(p + rel + extra > 0, p / (p + rel + extra)).otherwise(0.0), "absolute_phi"))


HALVES = "halves AS (SELECT subject, avg(x) FILTER (item % 2 = 1) AS a, avg(x) FILTER (item % 2 = 0) AS b, avg(x) AS x FROM matrix GROUP BY 1)"


def halves(spark, sf):
    odd = F.col("item") % 2 == 1
    return mx(spark, sf).groupBy("subject").agg(F.avg(F.when(odd, F.col("x"))).alias("a"), F.avg(F.when(~odd, F.col("x"))).alias("b"), F.avg("x").alias("x"))


@query("ag22_subject_profiles", with_(MATRIX, HALVES) + f"SELECT subject, {q6('x')} AS overall, {q6('a')} AS odd_mean, {q6('b')} AS even_mean FROM halves")
def _(spark, sf):
    return halves(spark, sf).select("subject", r6("x", "overall"), r6("a", "odd_mean"), r6("b", "even_mean"))


@query("ag20_icc", with_(MATRIX, HALVES) + f""", w AS (SELECT subject, (a + b) / 2 AS rm, a, b FROM halves), s AS (SELECT count(*) AS n, avg(a) AS ca, avg(b) AS cb, avg(rm) AS g FROM w),
m AS (SELECT 2 * sum(pow(rm - g, 2)) / (max(n) - 1) AS msr, sum(pow(a - rm - ca + g, 2) + pow(b - rm - cb + g, 2)) / (max(n) - 1) AS mse FROM w, s)
SELECT {q6('CASE WHEN msr + mse > 0 THEN (msr - mse) / (msr + mse) ELSE 0 END')} AS icc FROM m""")
def _(spark, sf):
    return icc(halves(spark, sf), "a", "b").select(r6("icc"))


def icc(pairs, a, b):
    """Consistency of two measurements: (MSrow - MSerror) / (MSrow + MSerror).

    With two columns the row part is the variance of the sum and the error part
    that of the difference, so one aggregate is enough.
    """
    n1 = F.count(F.lit(1)) - 1
    msr, mse = F.var_pop(F.col(a) + F.col(b)) * F.count(F.lit(1)) / n1 / 2, F.var_pop(F.col(a) - F.col(b)) * F.count(F.lit(1)) / n1 / 2
    return pairs.agg(msr.alias("r"), mse.alias("e"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.max(F.abs(F.col(a) - F.col(b))).alias("shift"),
                     S.correlation(a, b).alias("pearson")).withColumn(
        "icc", F.when(F.col("r") + F.col("e") > 0, (F.col("r") - F.col("e")) / (F.col("r") + F.col("e"))).otherwise(0.0))


@query("mt10_profile_agreement", with_(MATRIX, HALVES) + f""", rk AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM halves)
SELECT {q6(CORR.format(x='a', y='b'))} AS pearson, {q6(CORR.format(x='ra', y='rb'))} AS spearman, {q6('avg(abs(a - b))')} AS mae, {q6('max(abs(a - b))')} AS maximum_shift FROM rk""")
def _(spark, sf):
    h = halves(spark, sf)
    # a subject without items of one half has no mean there and ranks last, as in SQL
    rk = D.ranked(D.ranked(h, [], F.col("a"), [], 0.25, ordinal="", average="ra", nulls_last=True), [], F.col("b"), [], 0.25, ordinal="", average="rb", nulls_last=True)
    return rk.agg(r6(S.correlation("a", "b"), "pearson"), r6(S.correlation("ra", "rb"), "spearman"),
                  r6(F.avg(F.abs(F.col("a") - F.col("b"))), "mae"), r6(F.max(F.abs(F.col("a") - F.col("b"))), "maximum_shift"))


@query("mt8_item_total", with_(MATRIX) + f""", c AS (SELECT *, x - avg(x) OVER (PARTITION BY item) AS d, count(*) OVER (PARTITION BY subject) AS v FROM matrix),
o AS (SELECT item, d, (sum(d) OVER (PARTITION BY subject) - d) / (v - 1) AS other FROM c) SELECT item, {q6(CORR.format(x='d', y='other'))} AS r FROM o GROUP BY item""")
def _(spark, sf):
    return item_total(mx(spark, sf)).select("item", r6("r"))


def item_total(m):
    mu = m.groupBy("item").agg(F.avg("x").alias("mu"))
    d = m.join(mu, "item").withColumn("d", F.col("x") - F.col("mu"))
    tot = d.groupBy("subject").agg(F.sum("d").alias("s"), F.count(F.lit(1)).alias("v"))
    o = d.join(tot, "subject").withColumn("other", (F.col("s") - F.col("d")) / (F.col("v") - 1))
    return o.groupBy("item").agg(S.correlation("d", "other").alias("r"))


@query("mt11_within_subject_spearman", with_(MATRIX) + f""", y AS (SELECT l_suppkey AS subject, CAST(year(l_shipdate) AS INTEGER) AS item, avg(l_discount) AS y FROM lineitem GROUP BY 1, 2),
r AS (SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY x, item) - 1 AS rx, row_number() OVER (PARTITION BY subject ORDER BY y, item) - 1 AS ry FROM matrix JOIN y USING (subject, item)),
s AS (SELECT subject, {CORR.format(x='rx', y='ry')} AS rho FROM r GROUP BY 1) SELECT count(*) AS subjects, {q6('avg(rho)')} AS macro_spearman FROM s""")
def _(spark, sf):
    j = read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.year("l_shipdate").alias("item")).agg(
        F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"))
    # one row per item and subject, so a window holds at most the item catalogue
    w = Window.partitionBy("subject")
    r = j.withColumn("rx", F.row_number().over(w.orderBy("x", "item")) - 1).withColumn("ry", F.row_number().over(w.orderBy("y", "item")) - 1)
    s = r.groupBy("subject").agg(S.correlation("rx", "ry").alias("rho"))
    return s.agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("rho"), "macro_spearman"))


RB = 200


@query("bs1_cluster_bootstrap", with_(MATRIX, PID, SMEAN) + f""", d AS (SELECT draw, {draw_sql("'b1'", 'draw', 'idx', 'n')} AS pick FROM pid, (SELECT unnest(range({RB})) AS draw)),
s AS (SELECT draw, avg(x) AS stat FROM d JOIN pid ON pid.idx = d.pick JOIN smean USING (subject) GROUP BY draw)
SELECT {q6('(SELECT avg(x) FROM smean)')} AS observed, {q6('quantile_cont(stat, 0.025)')} AS low, {q6('quantile_cont(stat, 0.975)')} AS high FROM s""")
def _(spark, sf):
    m, p, _v = indexed(spark, sf)
    sm = m.groupBy("subject").agg(F.avg("x").alias("x")).join(p, "subject")
    i = Rs.interval(Rs.bootstrap_mean(sm, "idx", "x", count_of(p), "b1", RB))
    return i.select(r6(sm.agg(F.avg("x")).scalar(), "observed"), r6("low"), r6("high"))


CROSS = f"""dp AS (SELECT draw, {draw_sql("'cp'", 'draw', 'idx', 'n')} AS idx, count(*) AS wp FROM pid, (SELECT unnest(range(60)) AS draw) GROUP BY 1, 2),
dv AS (SELECT draw, {draw_sql("'cv'", 'draw', 'vdx', 'n')} AS vdx, count(*) AS wv FROM vid, (SELECT unnest(range(60)) AS draw) GROUP BY 1, 2),
cells AS (SELECT draw, subject, item, x, wp, wv FROM dp JOIN pid USING (idx) JOIN dv USING (draw) JOIN vid USING (vdx) JOIN matrix USING (subject, item))"""


def crossed_cells(spark, sf, r=60):
    """Cells with both multiplicities; a cell of weight zero never appears."""
    m, p, v = indexed(spark, sf)
    wp = Rs.multiplicities(p, "idx", count_of(p), "cp", r, "wp").join(p, "idx").select("draw", "subject", "wp")
    wv = Rs.multiplicities(v, "vdx", count_of(v), "cv", r, "wv").join(v, "vdx").select("draw", "item", "wv")
    return Rl.centred(m).join(wp, "subject").join(wv, ["draw", "item"]), m


@query("bs2_crossed_bootstrap", with_(MATRIX, PID, VID, CROSS) + f""", s AS (SELECT draw, sum(wp * wv * x) / sum(wp * wv) AS stat FROM cells GROUP BY 1)
SELECT {q6('quantile_cont(stat, 0.025)')} AS low, {q6('quantile_cont(stat, 0.975)')} AS high, count(*) AS draws FROM s""")
def _(spark, sf):
    cells, m = crossed_cells(spark, sf)
    w = F.col("wp") * F.col("wv")
    s = cells.groupBy("draw").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("stat"))
    g = m.agg(F.avg("x")).scalar()
    return Rs.interval(s).select(r6(F.col("low") + g, "low"), r6(F.col("high") + g, "high"), "draws")


@query("bs6_reliability_bootstrap", with_(MATRIX, PID, VID, CROSS) + f""", c AS (SELECT {TRUNC} FROM ({comp_sql('cells', 'draw', 'wp', 'wv')})),
g AS (SELECT draw, k, {G.format(k='k')} AS rg, {PHI.format(k='k')} AS ph FROM c, (SELECT unnest([1, 7, 15]) AS k))
SELECT CAST(k AS BIGINT) AS k, {q6('quantile_cont(rg, 0.025)')} AS g_low, {q6('quantile_cont(rg, 0.975)')} AS g_high, {q6('quantile_cont(ph, 0.025)')} AS phi_low, {q6('quantile_cont(ph, 0.975)')} AS phi_high FROM g GROUP BY k""")
def _(spark, sf):
    cells, _m = crossed_cells(spark, sf)
    c = Rl.variance_components(cells, ["draw"], wp="wp", wv="wv")
    g = c.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 7, 15)])))
    g = g.withColumn("rg", Rl.relative_g(F.col("k"))).withColumn("ph", Rl.absolute_phi(F.col("k")))
    q = lambda x, p: r6(F.percentile(x, F.lit(p)))
    return g.groupBy("k").agg(q("rg", 0.025).alias("g_low"), q("rg", 0.975).alias("g_high"), q("ph", 0.025).alias("phi_low"), q("ph", 0.975).alias("phi_high"))


@query("bs3_sign_flip", with_(MATRIX, SMEAN) + f""", g AS (SELECT subject, x - (SELECT quantile_cont(x, 0.5) FROM smean) AS d FROM smean),
n AS (SELECT draw, avg(CASE WHEN {hash_sql("'sf'", 'draw', 'subject')} % 2 = 0 THEN d ELSE -d END) AS null_mean FROM g, (SELECT unnest(range({RB})) AS draw) GROUP BY draw)
SELECT {q6('(SELECT avg(d) FROM g)')} AS observed, {q6(f'(1.0 + count(*) FILTER (abs(null_mean) >= abs((SELECT avg(d) FROM g)))) / {RB + 1}')} AS p FROM n""")
def _(spark, sf):
    sm = mx(spark, sf).groupBy("subject").agg(F.avg("x").alias("x"))
    med = D.quantiles(sm, [], F.col("x"), {"med": 0.5}, 0.25).select("med").scalar()
    g = sm.select("subject", (F.col("x") - med).alias("d"))
    obs = g.agg(F.avg("d"))
    flip = F.when(Rs.hash_value("sf", F.col("draw"), F.col("subject")) % 2 == 0, F.col("d")).otherwise(-F.col("d"))
    n = g.withColumn("draw", Rs.draws(RB)).groupBy("draw").agg(F.avg(flip).alias("z"))
    return n.agg(F.count_if(F.abs("z") >= F.abs(obs.scalar())).alias("c")).select(r6(obs.scalar(), "observed"), r6((1.0 + F.col("c")) / (RB + 1), "p"))


@query("bs4_label_permutation", with_(MATRIX, PID) + f""", pm AS (SELECT draw, item, x, row_number() OVER (PARTITION BY draw, item ORDER BY {hash_sql("'lp'", 'draw', 'item', 'subject')}, subject) AS subject FROM matrix, (SELECT unnest(range(40)) AS draw)),
c AS (SELECT {TRUNC} FROM ({comp_sql('pm', 'draw')})), o AS (SELECT {TRUNC} FROM ({comp_sql('matrix')})), og AS (SELECT {G.format(k='V')} AS g FROM o), ng AS (SELECT {G.format(k='V')} AS g FROM c)
SELECT {q6('(SELECT g FROM og)')} AS observed, {q6('avg(g)')} AS null_mean, {q6('(1.0 + count(*) FILTER (g >= (SELECT g FROM og) )) / 41')} AS p FROM ng""")
def _(spark, sf):
    m = Rl.centred(mx(spark, sf))
    pm = Rs.shuffled_rank(m.withColumn("draw", Rs.draws(40)), ["draw", "item"], ["lp", F.col("draw"), F.col("item"), F.col("subject")], "subject", "to")
    null = Rl.variance_components(pm.select("draw", "item", "x", F.col("to").alias("subject")), ["draw"]).withColumn("g", Rl.relative_g(F.col("V")))
    obs = Rl.variance_components(m).select(Rl.relative_g(F.col("V")).alias("g"))
    return null.agg(F.avg("g").alias("m"), F.count_if(F.col("g") >= obs.scalar()).alias("c")).select(
        r6(obs.scalar(), "observed"), r6("m", "null_mean"), r6((1.0 + F.col("c")) / 41, "p"))


@query("bs5_category_permutation", with_(MATRIX) + f""", pm AS (SELECT draw, subject, x, row_number() OVER (PARTITION BY draw, subject ORDER BY {hash_sql("'cq'", 'draw', 'subject', 'item')}, item) AS label FROM matrix, (SELECT unnest(range(100)) AS draw)),
nm AS (SELECT draw, label, avg(x) AS mu FROM pm GROUP BY 1, 2), ns AS (SELECT draw, var_pop(mu) * count(*) AS s FROM nm GROUP BY 1), om AS (SELECT item, avg(x) AS mu FROM matrix GROUP BY 1), os AS (SELECT var_pop(mu) * count(*) AS s FROM om)
SELECT {q6('(SELECT s FROM os)')} AS observed, {q6('(1.0 + count(*) FILTER (s >= (SELECT s FROM os) - 1e-15)) / 101')} AS p FROM ns""")
def _(spark, sf):
    return category_permutation(mx(spark, sf), "cq", 100)


def category_permutation(m, seed, r):
    """Shuffle labels inside each subject; the label set is the item catalogue."""
    w = Window.partitionBy("draw", "subject").orderBy(Rs.hash_value(seed, F.col("draw"), F.col("subject"), F.col("item")), "item")
    pm = m.withColumn("draw", Rs.draws(r)).withColumn("label", F.row_number().over(w))
    stat = F.var_pop("mu") * F.count(F.lit(1))
    null = pm.groupBy("draw", "label").agg(F.avg("x").alias("mu")).groupBy("draw").agg(stat.alias("s"))
    obs = m.groupBy("item").agg(F.avg("x").alias("mu")).agg(stat.alias("s"))
    return null.agg(F.count_if(F.col("s") >= obs.scalar() - 1e-15).alias("c")).select(r6(obs.scalar(), "observed"), r6((1.0 + F.col("c")) / (r + 1), "p"))


@query("bs7_two_level_bootstrap", with_(MATRIX, PID, VID) + f""", d AS (SELECT draw, {draw_sql("'t1'", 'draw', 'idx', 'n')} AS pick, {hash_sql("'t2'", 'draw', 'idx')} % (SELECT max(n) FROM vid) AS vpick FROM pid, (SELECT unnest(range(100)) AS draw)),
s AS (SELECT draw, avg(x) AS stat FROM d JOIN pid ON pid.idx = d.pick JOIN vid ON vid.vdx = d.vpick JOIN matrix USING (subject, item) GROUP BY 1)
SELECT {q6('quantile_cont(stat, 0.025)')} AS low, {q6('quantile_cont(stat, 0.975)')} AS high FROM s""")
def _(spark, sf):
    m, p, v = indexed(spark, sf)
    slots = p.select(F.col("idx").alias("slot")).withColumn("draw", Rs.draws(100))
    d = slots.select("draw", (Rs.hash_value("t1", F.col("draw"), F.col("slot")) % count_of(p)).alias("idx"),
                     (Rs.hash_value("t2", F.col("draw"), F.col("slot")) % count_of(v)).alias("vdx"))
    d = d.groupBy("draw", "idx", "vdx").agg(F.count(F.lit(1)).alias("w"))
    cells = m.join(p, "subject").join(v, "item").select("idx", "vdx", "x")
    s = d.join(cells, ["idx", "vdx"]).groupBy("draw").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("stat"))
    return Rs.interval(s).select(r6("low"), r6("high"))


@query("bs9_endpoint_error", with_(MATRIX, PID, SMEAN) + f""", d AS (SELECT draw, {draw_sql("'b1'", 'draw', 'idx', 'n')} AS pick FROM pid, (SELECT unnest(range({RB})) AS draw)),
s AS (SELECT draw, avg(x) AS stat FROM d JOIN pid ON pid.idx = d.pick JOIN smean USING (subject) GROUP BY draw),
e AS (SELECT d2, {draw_sql("'mc'", 'd2', 'draw', RB)} AS pick FROM s, (SELECT unnest(range(40)) AS d2)), q AS (SELECT d2, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM e JOIN s ON s.draw = e.pick GROUP BY d2)
SELECT {q6('stddev_samp(lo)')} AS lower_mcse, {q6('stddev_samp(hi)')} AS upper_mcse FROM q""")
def _(spark, sf):
    m, p, _v = indexed(spark, sf)
    sm = m.groupBy("subject").agg(F.avg("x").alias("x")).join(p, "subject")
    s = Rs.bootstrap_mean(sm, "idx", "x", count_of(p), "b1", RB).select(F.col("draw").alias("idx"), "stat")
    e = Rs.multiplicities(s, "idx", F.lit(RB), "mc", 40, "w").join(s, "idx")
    q = e.groupBy("draw").agg(F.percentile("stat", F.array(F.lit(0.025), F.lit(0.975)), F.col("w")).alias("q"))
    return q.agg(r6(F.stddev_samp(F.col("q")[0]), "lower_mcse"), r6(F.stddev_samp(F.col("q")[1]), "upper_mcse"))


@query("bs12_split_half", with_(MATRIX) + f""", h AS (SELECT draw, item, row_number() OVER (PARTITION BY draw, item % 2 ORDER BY {hash_sql("'sh'", 'draw', 'item')}, item) AS k, count(*) OVER (PARTITION BY draw, item % 2) AS n FROM (SELECT DISTINCT item FROM matrix), (SELECT unnest(range(30)) AS draw)),
p AS (SELECT draw, subject, avg(x) FILTER (k <= (n + 1) // 2) AS a, avg(x) FILTER (k > (n + 1) // 2) AS b FROM matrix JOIN h USING (item) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY draw ORDER BY a) AS ra, rank() OVER (PARTITION BY draw ORDER BY b) AS rb FROM p),
c AS (SELECT draw, {CORR.format(x='a', y='b')} AS pearson, {CORR.format(x='ra', y='rb')} AS spearman FROM r GROUP BY 1)
SELECT count(*) AS repeats, {q6('avg(pearson)')} AS pearson, {q6('avg(spearman)')} AS spearman, {q6('avg(2 * pearson / (1 + pearson))')} AS corrected, {q6('quantile_cont(pearson, 0.5)')} AS median FROM c""")
def _(spark, sf):
    m = mx(spark, sf)
    group = Window.partitionBy("draw", (F.col("item") % 2))  # item catalogue only
    h = m.select("item").distinct().withColumn("draw", Rs.draws(30))
    h = h.withColumn("k", F.row_number().over(group.orderBy(Rs.hash_value("sh", F.col("draw"), F.col("item")), "item"))).withColumn(
        "first", F.col("k") <= F.floor((F.count(F.lit(1)).over(group) + 1) / 2))
    p = m.join(h, "item").groupBy("draw", "subject").agg(F.avg(F.when(F.col("first"), F.col("x"))).alias("a"), F.avg(F.when(~F.col("first"), F.col("x"))).alias("b"))
    r = D.ranked(D.ranked(p, ["draw"], F.col("a"), [], 0.25, ordinal="", average="ra"), ["draw"], F.col("b"), [], 0.25, ordinal="", average="rb")
    c = r.groupBy("draw").agg(S.correlation("a", "b").alias("pearson"), S.correlation("ra", "rb").alias("spearman"))
    return c.agg(F.count(F.lit(1)).alias("repeats"), r6(F.avg("pearson"), "pearson"), r6(F.avg("spearman"), "spearman"),
                 r6(F.avg(S.spearman_brown(F.col("pearson"))), "corrected"), r6(F.percentile("pearson", F.lit(0.5)), "median"))


@query("bs13_stratified_item_bootstrap", with_(MATRIX) + f""", it AS (SELECT item, item % 2 AS cat, row_number() OVER (PARTITION BY item % 2 ORDER BY item) - 1 AS k, count(*) OVER (PARTITION BY item % 2) AS n FROM (SELECT DISTINCT item FROM matrix)),
d AS (SELECT draw, cat, {hash_sql("'si'", 'draw', 'cat', 'k')} % n AS k, count(*) AS wv FROM it, (SELECT unnest(range(40)) AS draw) GROUP BY 1, 2, 3), cells AS (SELECT draw, subject, item, x, wv FROM d JOIN it USING (cat, k) JOIN matrix USING (item)),
c AS (SELECT {TRUNC} FROM ({comp_sql('cells', 'draw', '1', 'wv')})) SELECT {q6("quantile_cont(" + G.format(k='V') + ", 0.025)")} AS low, {q6("quantile_cont(" + G.format(k='V') + ", 0.975)")} AS high FROM c""")
def _(spark, sf):
    m = Rl.centred(mx(spark, sf))
    cat = Window.partitionBy("cat")  # item catalogue only
    it = m.select("item").distinct().withColumn("cat", F.col("item") % 2)
    it = it.withColumn("k", (F.row_number().over(cat.orderBy("item")) - 1).cast("long")).withColumn("n", F.count(F.lit(1)).over(cat))
    d = it.withColumn("draw", Rs.draws(40)).select("draw", "cat", (Rs.hash_value("si", F.col("draw"), F.col("cat"), F.col("k")) % F.col("n")).alias("k"))
    d = d.groupBy("draw", "cat", "k").agg(F.count(F.lit(1)).alias("wv")).join(it, ["cat", "k"]).select("draw", "item", "wv")
    c = Rl.variance_components(m.join(d, "item"), ["draw"], wv="wv").select(Rl.relative_g(F.col("V")).alias("stat"))
    return Rs.interval(c).select(r6("low"), r6("high"))


@query("bs15_interval_summary", f"SELECT event_type, {q6('quantile_cont(value, 0.025)')} AS low, {q6('quantile_cont(value, 0.975)')} AS high FROM events GROUP BY 1")
def _(spark, sf):
    return D.quantiles(read(spark, sf, "events"), ["event_type"], F.col("value"), {"low": 0.025, "high": 0.975}).select("event_type", r6("low"), r6("high"))


@query("ag10_distribution_summary", f"SELECT event_type, {q6('avg(value)')} AS mean, {q6('quantile_cont(value, 0.5)')} AS median, {q6('quantile_cont(value, 0.05)')} AS p05, {q6('quantile_cont(value, 0.95)')} AS p95, {q6('min(value)')} AS low, {q6('max(value)')} AS high FROM events GROUP BY 1")
def _(spark, sf):
    e = read(spark, sf, "events")
    q = D.quantiles(e, ["event_type"], F.col("value"), {"median": 0.5, "p05": 0.05, "p95": 0.95}).drop("n")
    a = e.groupBy("event_type").agg(F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return a.join(q, "event_type").select("event_type", *[r6(c) for c in ("mean", "median", "p05", "p95", "low", "high")])


@query("ag9_multi_level_mean", with_(CUBE) + f""", s AS (SELECT subject, category, avg(x) AS x FROM cube GROUP BY 1, 2) SELECT category, count(*) AS subjects, {q6('avg(x)')} AS macro FROM s GROUP BY 1""")
def _(spark, sf):
    s = category_cube(spark, sf).groupBy("subject", "category").agg(F.avg("x").alias("x"))
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("subjects"), r6(F.avg("x"), "macro"))


@query("ag11_scope_totals", with_(CUBE) + f"""SELECT subject, coalesce(category, 'all') AS scope, count(*) AS cells, {q6('avg(x)')} AS mean FROM cube GROUP BY GROUPING SETS ((subject), (subject, category))""")
def _(spark, sf):
    g = category_cube(spark, sf).groupingSets([["subject"], ["subject", "category"]], "subject", "category").agg(F.count(F.lit(1)).alias("cells"), r6(F.avg("x"), "mean"))
    return g.select("subject", F.coalesce("category", F.lit("all")).alias("scope"), "cells", "mean")


@query("ag14_reliability_cost", with_(MATRIX, COMP, TRACE) + f""", du AS (SELECT video, max(t) + 1 AS d FROM trace GROUP BY 1), o AS (SELECT d, row_number() OVER (ORDER BY d, video) AS k, sum(d) OVER (ORDER BY d, video) AS lo, sum(d) OVER (ORDER BY d DESC, video DESC) AS hi, row_number() OVER (ORDER BY d DESC, video DESC) AS kd FROM du)
SELECT k.k, {q6('k.k * (SELECT avg(d) FROM du) / 60')} AS expected_minutes, {q6('(SELECT lo FROM o WHERE o.k = k.k) / 60')} AS minimum_minutes, {q6('(SELECT hi FROM o WHERE o.kd = k.k) / 60')} AS maximum_minutes, {q6('sqrt(var_residual / k.k)')} AS relative_sem, {q6('sqrt((var_item + var_residual) / k.k)')} AS absolute_sem FROM (SELECT k FROM o) k, comp""")
def _(spark, sf):
    du = A.trace(spark, sf).groupBy("video").agg((F.max("t") + 1).alias("d"))
    up = D.running(D.ranked(du, [], F.col("d"), ["video"], ordinal="k").withColumn("_t", F.col("k") - 1), [], "_t", F.col("d"), "lo")
    down = D.running(D.ranked(du, [], F.col("d"), [F.col("video").desc()], descending=True, ordinal="k").withColumn("_t", F.col("k") - 1), [], "_t", F.col("d"), "hi")
    mean = du.agg(F.avg("d")).scalar()
    c = comp(spark, sf)
    one = lambda e: c.select(e.alias("v")).scalar()
    return up.select("k", "lo").join(down.select("k", "hi"), "k").select(
        "k", r6(F.col("k") * mean / 60, "expected_minutes"), r6(F.col("lo") / 60, "minimum_minutes"), r6(F.col("hi") / 60, "maximum_minutes"),
        r6(F.sqrt(one(F.col("var_residual")) / F.col("k")), "relative_sem"),
        r6(F.sqrt(one(F.col("var_item") + F.col("var_residual")) / F.col("k")), "absolute_sem"))


GAIN = "gain AS (SELECT subject, a - b AS g FROM halves)"


@query("ag17_threshold_ledger", with_(MATRIX, HALVES, GAIN) + f""", t AS (SELECT i / 20.0 AS thr FROM (SELECT unnest(range(41)) AS i)),
c AS (SELECT thr, count(*) FILTER (g >= thr) AS up, count(*) FILTER (g <= -thr) AS down, count(*) AS n FROM gain, t GROUP BY thr)
SELECT CAST(thr AS DOUBLE) AS threshold, 'gain' AS direction, up AS hits, {q6('up / CAST(n AS DOUBLE)')} AS proportion FROM c UNION ALL SELECT CAST(thr AS DOUBLE), 'loss', down, {q6('down / CAST(n AS DOUBLE)')} FROM c""")
def _(spark, sf):
    return ledger(halves(spark, sf).withColumn("g", F.col("a") - F.col("b")), "g", 41, 20).select("threshold", "direction", "hits", r6(F.col("hits") / F.col("n"), "proportion"))


def ledger(gains, g, points, per_unit):
    """Counts at or beyond every threshold of a grid, both directions.

    Each value is placed in its grid cell once; counts per threshold are a
    running sum over the fixed grid, so rows are never multiplied by it.
    """
    cell = lambda x: F.least(F.floor(x * per_unit + 1e-12), F.lit(points - 1))
    both = gains.select(F.explode(F.array(
        F.struct(F.lit("gain").alias("direction"), cell(F.col(g)).alias("cell")),
        F.struct(F.lit("loss").alias("direction"), cell(-F.col(g)).alias("cell")))).alias("s")).select("s.*")
    n = gains.agg(F.count(F.lit(1)).alias("n"))
    counts = both.groupBy("direction", "cell").agg(F.count(F.lit(1)).alias("k"))
    reach = counts.filter("cell >= 0").select("direction", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cell"))).alias("i"))
    got = reach.groupBy("direction", "i").agg(F.sum("k").alias("hits"))
    grid = n.select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("i")).select(
        "n", "i", F.explode(F.array(F.lit("gain"), F.lit("loss"))).alias("direction"))
    return grid.join(got, ["direction", "i"], "left").select((F.col("i") / per_unit).alias("threshold"), "direction", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"), "n")


@query("cq24_decision_curves", with_(MATRIX, HALVES, GAIN) + f""", t AS (SELECT i / 20.0 AS thr FROM (SELECT unnest(range(41)) AS i)),
k AS (SELECT CAST(thr AS DOUBLE) AS threshold, 'gain' AS direction, CAST(count(*) FILTER (g >= thr) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM gain, t GROUP BY thr UNION ALL SELECT CAST(thr AS DOUBLE), 'loss', CAST(count(*) FILTER (g <= -thr) AS DOUBLE), CAST(count(*) AS DOUBLE) FROM gain, t GROUP BY thr)
SELECT threshold, direction, CAST(c AS BIGINT) AS hits, {q6(f'greatest(0, {WILSON[0]} - {WILSON[1]})')} AS low, {q6(f'least(1, {WILSON[0]} + {WILSON[1]})')} AS high FROM k""")
def _(spark, sf):
    l = ledger(halves(spark, sf).withColumn("g", F.col("a") - F.col("b")), "g", 41, 20)
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return l.select("threshold", "direction", "hits", r6(lo, "low"), r6(hi, "high"))


@query("tk9_best_worst", with_(MATRIX, HALVES, GAIN) + f"SELECT {q6('min(g)')} AS worst, {q6('max(g)')} AS best, {q6('quantile_cont(g, 0.75) - quantile_cont(g, 0.25)')} AS iqr, arg_min(subject, {{'a': g, 'b': subject}}) AS worst_subject FROM gain")
def _(spark, sf):
    g = halves(spark, sf).withColumn("g", F.col("a") - F.col("b"))
    q = D.quantiles(g, [], F.col("g"), {"q1": 0.25, "q3": 0.75}, 0.25)
    return g.agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.min_by("subject", F.struct("g", "subject")).alias("worst_subject")).select(
        r6("lo", "worst"), r6("hi", "best"), r6(q.select(F.col("q3") - F.col("q1")).scalar(), "iqr"), "worst_subject")


@query("cv2_shuffled_folds", with_(MATRIX, PID) + f"""SELECT subject, rep, CASE WHEN rep = 0 THEN idx % 5 ELSE (row_number() OVER (PARTITION BY rep ORDER BY {hash_sql("'cv'", 'rep', 'subject')}, subject) - 1) % 5 END AS fold FROM pid, (SELECT unnest(range(4)) AS rep)""")
def _(spark, sf):
    _m, p, _v = indexed(spark, sf)
    s = Rs.shuffled_rank(p.withColumn("rep", Rs.draws(4)), ["rep"], ["cv", F.col("rep"), F.col("subject")], "subject", "k")
    return s.select("subject", "rep", F.when(F.col("rep") == 0, F.col("idx") % 5).otherwise((F.col("k") - 1) % 5).alias("fold"))


@query("cv3_stratified_item_folds", f"""WITH i AS (SELECT p_partkey AS item, p_brand AS category FROM part), c AS (SELECT category, row_number() OVER (ORDER BY {hash_sql("'sc'", 'category')}, category) - 1 AS ci FROM (SELECT DISTINCT category FROM i)),
r AS (SELECT item, category, ci, row_number() OVER (PARTITION BY category ORDER BY {hash_sql("'si'", 'item')}, item) - 1 AS pos FROM i JOIN c USING (category)) SELECT item, (ci + pos + 3) % 5 AS fold FROM r""")
def _(spark, sf):
    i = read(spark, sf, "part").select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("category"))
    c = Rs.shuffled_rank(i.select("category").distinct(), [], ["sc", F.col("category")], "category", "ci")
    r = Rs.shuffled_rank(i, ["category"], ["si", F.col("item")], "item", "pos").join(c, "category")
    return r.select("item", ((F.col("ci") - 1 + F.col("pos") - 1 + 3) % 5).alias("fold"))


@query("cv7_calibration_subsets", with_(MATRIX) + f"""SELECT subject, rep, item FROM (SELECT subject, item, rep, row_number() OVER (PARTITION BY subject, rep ORDER BY {hash_sql("'cs'", 'subject', 'rep', 'item')}, item) AS k FROM matrix, (SELECT unnest(range(3)) AS rep)) WHERE k <= 2""")
def _(spark, sf):
    return calibration(mx(spark, sf), 2, 3).select("subject", "rep", "item")


def calibration(m, k, repeats):
    """k items per (subject, repeat) in hash order; a group is one subject's item list."""
    w = Window.partitionBy("subject", "rep").orderBy(Rs.hash_value("cs", F.col("subject"), F.col("rep"), F.col("item")), "item")
    return m.withColumn("rep", Rs.draws(repeats)).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k).drop("_k")


@query("cv8_balanced_subsets", with_(CUBE) + f""", r AS (SELECT subject, category, item, row_number() OVER (PARTITION BY subject, category ORDER BY {hash_sql("'cb'", 'subject', 'category', 'item')}, item) AS k, {hash_sql("'cx'", 'subject', 'category')} AS ch FROM cube),
e AS (SELECT subject, category, row_number() OVER (PARTITION BY subject ORDER BY ch, category) AS ck FROM (SELECT DISTINCT subject, category, ch FROM r)) SELECT subject, category, item FROM r JOIN e USING (subject, category) WHERE k <= 1 + CASE WHEN ck <= 4 % 3 THEN 1 ELSE 0 END""")
def _(spark, sf):
    # budget 4 over 3 categories: one item each, one more for the remainder category
    cube = category_cube(spark, sf)
    h = lambda *p: Rs.hash_value(*[x if i == 0 else F.col(x) for i, x in enumerate(p)])
    inside = Window.partitionBy("subject", "category").orderBy(h("cb", "subject", "category", "item"), "item")
    r = cube.withColumn("k", F.row_number().over(inside))
    e = cube.select("subject", "category").distinct().withColumn(
        "ck", F.row_number().over(Window.partitionBy("subject").orderBy(h("cx", "subject", "category"), "category")))
    return r.join(e, ["subject", "category"]).filter(F.col("k") <= 1 + F.when(F.col("ck") <= 4 % 3, 1).otherwise(0)).select("subject", "category", "item")


@query("cq8_reliability_study", with_(MATRIX, COMP, PID, VID, CROSS) + f""", c AS (SELECT {TRUNC} FROM ({comp_sql('cells', 'draw', 'wp', 'wv')})), b AS (SELECT quantile_cont({G.format(k='7')}, 0.025) AS lo, quantile_cont({G.format(k='7')}, 0.975) AS hi FROM c)
SELECT {q6(G.format(k='7'))} AS relative_g, {q6('lo')} AS low, {q6('hi')} AS high, CASE WHEN lo > 0.5 THEN 'PASS' WHEN hi < 0.5 THEN 'FAILED' ELSE 'PARTIAL' END AS gate FROM comp, b""")
def _(spark, sf):
    cells, m = crossed_cells(spark, sf)
    i = Rs.interval(Rl.variance_components(cells, ["draw"], wp="wp", wv="wv").select(Rl.relative_g(F.lit(7)).alias("stat")))
    g = comp(spark, sf).select(Rl.relative_g(F.lit(7)).alias("g"), F.lit(0).alias("one"))
    # two one-row results side by side
    return i.withColumn("one", F.lit(0)).join(g, "one").select(
        r6("g", "relative_g"), r6("low"), r6("high"), S.gate_status(F.col("low"), F.col("high"), 0.5).alias("gate"))


@query("flt12_study_gates", with_(MATRIX, COMP) + f"""SELECT CASE WHEN {G.format(k='7')} >= 0.7 THEN 'pass' ELSE 'stop' END AS trait_gate, CASE WHEN {G.format(k='2')} >= 0.5 THEN 'brief budget supported' ELSE 'brief budget not supported' END AS brief_budget FROM comp""")
def _(spark, sf):
    return comp(spark, sf).select(F.when(Rl.relative_g(F.lit(7)) >= 0.7, "pass").otherwise("stop").alias("trait_gate"),
                                  F.when(Rl.relative_g(F.lit(2)) >= 0.5, "brief budget supported").otherwise("brief budget not supported").alias("brief_budget"))
