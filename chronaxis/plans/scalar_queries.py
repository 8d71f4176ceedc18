"""Scalar functions over the trace, route and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import distributed as D
from ..sources import adapters as A
from ..sources.tables import read
from .base_queries import OOF_ALL, oof
from .registry import TRACE, q6, query, r6, with_

T = with_(TRACE)
CORR = "CASE WHEN count(*) < 3 OR stddev_pop({x}) < 1e-12 OR stddev_pop({y}) < 1e-12 THEN 0 ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END"


@query("sc1_rating_rescale", f"""SELECT event_id, 1 + event_id % 9 AS rating, {q6('1 + (event_id % 9) * 254.0 / 8')} AS label FROM events""")
def _(spark, sf):
    e = read(spark, sf, "events").select("event_id", (1 + F.col("event_id") % 9).alias("rating"))
    return e.select("event_id", "rating", r6(S.rating_to_label(F.col("rating")), "label"))


@query("sc2_label_clip", OOF_ALL + f"SELECT subject, video, t, axis, {q6('least(greatest(prior + least(greatest(3 * (value - prior), -20), 20), 1), 255)')} AS clipped FROM oof")
def _(spark, sf):
    step = S.clip(3 * (F.col("value") - F.col("prior")), -20.0, 20.0)
    return oof(spark, sf).select("subject", "video", "t", "axis", r6(S.clip(F.col("prior") + step, 1.0, 255.0), "clipped"))


@query("sc3_gated_stack", T + f"""SELECT subject, video, t, {q6('least(greatest(128 + least(greatest(0.5 * (valence - 60) + 0.25 * (arousal - 128), -30), 30), 1), 255)')} AS stacked,
 {q6('128.0')} AS fallback FROM trace""")
def _(spark, sf):
    v, a = F.col("valence") - 60, F.col("arousal") - 128
    p = F.lit(128.0)
    return A.trace(spark, sf).select("subject", "video", "t", r6(S.gated_stack(p, [(0.5, v), (0.25, a), (0.0, v)], 30.0), "stacked"),
                                     r6(S.gated_stack(p, [(0.0, v), (0.0, a)], 0.0), "fallback"))


@query("sc12_spearman_brown", T + f""", c AS (SELECT subject, {CORR.format(x='valence', y='arousal')} AS r FROM trace GROUP BY subject)
SELECT subject, {q6('r')} AS r, {q6('CASE WHEN abs(1 + r) >= 1e-12 THEN 2 * r / (1 + r) END')} AS corrected FROM c""")
def _(spark, sf):
    c = A.trace(spark, sf).groupBy("subject").agg(S.correlation("valence", "arousal").alias("r"))
    return c.select("subject", r6("r"), r6(S.spearman_brown(F.col("r")), "corrected"))


WILSON = "(c / n + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n)", "1.959963984540054 * sqrt(c / n * (1 - c / n) / n + 3.8414588206941236 / (4 * n * n)) / (1 + 3.8414588206941236 / n)"


@query("sc13_wilson_interval", T + f""", k AS (SELECT video, CAST(count(*) FILTER (valence > 50) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM trace GROUP BY video)
SELECT video, CAST(c AS BIGINT) AS hits, {q6(f'greatest(0, {WILSON[0]} - {WILSON[1]})')} AS low, {q6(f'least(1, {WILSON[0]} + {WILSON[1]})')} AS high FROM k""")
def _(spark, sf):
    k = A.trace(spark, sf).groupBy("video").agg(F.count_if(F.col("valence") > 50).alias("hits"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("hits"), F.col("n"))
    return k.select("video", "hits", r6(lo, "low"), r6(hi, "high"))


@query("sc17_iso_dates", """, """.join(["WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y') || '-13-01' ELSE strftime(o_orderdate, '%Y-%m-%d') || 'T00' END AS s FROM orders)"]) + """
SELECT o_orderkey % 4 AS form, count(*) AS records, count(*) FILTER (regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$') AND try_strptime(s, '%Y-%m-%d') IS NOT NULL) AS valid FROM d GROUP BY 1""")
def _(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    s = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy/MM/dd"))
         .when(k == 2, F.concat(F.date_format(d, "yyyy"), F.lit("-13-01"))).otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00"))))
    return read(spark, sf, "orders").select(k.alias("form"), S.iso_date(s).alias("ok")).groupBy("form").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("ok").alias("valid"))


@query("sc18_content_digest", "SELECT doc_id, sha256(text) AS digest, regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS well_formed FROM documents")
def _(spark, sf):
    d = F.sha2("text", 256)
    return read(spark, sf, "documents").select("doc_id", d.alias("digest"), d.rlike("^[0-9a-f]{64}$").alias("well_formed"))


@query("sc19_canonical_json", """SELECT c_custkey, '{"id":' || c_custkey || ',"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}' AS canonical FROM customer""")
def _(spark, sf):
    c = read(spark, sf, "customer")
    return c.select("c_custkey", F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
                                                    F.col("c_mktsegment").alias("segment"))).alias("canonical"))


@query("sc20_normalized_text", """SELECT doc_id, md5(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]', '', 'g')) AS digest,
 length(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^a-z0-9]', '', 'g')) AS kept FROM documents""")
def _(spark, sf):
    n = S.normalized_text(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("kept"))


@query("sc21_name_match", """WITH n AS (SELECT p_partkey, regexp_replace(lower(list_extract(string_split(p_name, ' '), -1)), '[^a-z0-9]', '', 'g') AS l,
 regexp_replace(lower(list_extract(string_split(p_type, ' '), -1)), '[^a-z0-9]', '', 'g') AS r FROM part)
SELECT p_partkey, (ends_with(l, r) OR ends_with(r, l)) AND l <> '' AND r <> '' AS same_family FROM n""")
def _(spark, sf):
    left = S.normalized_text(F.element_at(F.split("p_name", " "), -1))
    right = S.normalized_text(F.element_at(F.split("p_type", " "), -1))
    return read(spark, sf, "part").select("p_partkey", (
        (F.endswith(left, right) | F.endswith(right, left)) & (left != "") & (right != "")).alias("same_family"))


@query("sc22_half_up", T + "SELECT subject, video, t, CAST(floor(valence + 0.5) AS BIGINT) AS v, CAST(floor((t - 5) / 2.0 + 0.5) AS BIGINT) AS h FROM trace")
def _(spark, sf):
    return A.trace(spark, sf).select("subject", "video", "t", S.half_up(F.col("valence")).alias("v"), S.half_up((F.col("t") - 5) / 2.0).alias("h"))


@query("sc23_skew_kurtosis", T + f""", m AS (SELECT subject, video, avg(valence) AS mu, stddev_pop(valence) AS sd FROM trace GROUP BY 1, 2)
SELECT subject, video, {q6('CASE WHEN any_value(sd) < 1e-6 THEN 0 ELSE avg(pow(valence - mu, 3)) / pow(any_value(sd), 3) END')} AS skew,
 {q6('CASE WHEN any_value(sd) < 1e-6 THEN 0 ELSE avg(pow(valence - mu, 4)) / pow(any_value(sd), 4) - 3 END')} AS kurt FROM trace JOIN m USING (subject, video) GROUP BY 1, 2""")
def _(spark, sf):
    guard = lambda c: F.when(F.stddev_pop("valence") < 1e-6, 0.0).otherwise(c)
    return A.trace(spark, sf).groupBy("subject", "video").agg(
        r6(guard(F.skewness("valence")), "skew"), r6(guard(F.kurtosis("valence")), "kurt"))


@query("sc24_spec_names", """SELECT 'phase' || CASE p_size % 5 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' WHEN 3 THEN '0.75' ELSE '1' END
 || CASE p_size % 3 WHEN 0 THEN '_uniform' WHEN 1 THEN '_tau15' ELSE '_tau30' END || '_smooth' || (p_size % 4) AS name, count(*) AS parts FROM part GROUP BY 1""")
def _(spark, sf):
    p = F.col("p_size")
    w = F.regexp_replace(((p % 5) / 4.0).cast("string"), r"\.0$", "")
    tau = F.when(p % 3 == 0, "_uniform").otherwise(F.concat(F.lit("_tau"), (p % 3 * 15).cast("string")))
    name = F.concat(F.lit("phase"), w, tau, F.lit("_smooth"), (p % 4).cast("string"))
    return read(spark, sf, "part").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("parts"))


@query("sc25_trial_weights", T + f""", n AS (SELECT subject, video, count(*) AS n FROM trace GROUP BY 1, 2), k AS (SELECT count(*) AS k FROM n)
SELECT subject, video, n, {q6('1e6 / (k * n)')} AS weight_ppm FROM n, k""")
def _(spark, sf):
    n = A.trial_lengths(A.trace(spark, sf))
    k = n.agg(F.count(F.lit(1)).alias("k"))
    return n.select("subject", "video", "n", r6(1e6 / (k.scalar() * F.col("n")), "weight_ppm"))


@query("uf4_sql_functions", T + f""", k AS (SELECT video, CAST(count(*) FILTER (valence > 50) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM trace GROUP BY video)
SELECT video, {q6(f'greatest(0, {WILSON[0]} - {WILSON[1]})')} AS low, {q6('1 + (n % 9) * 31.75')} AS label, CAST(floor(c / n * 100 + 0.5) AS BIGINT) AS percent FROM k""")
def _(spark, sf):
    S.register_sql(spark)
    k = A.trace(spark, sf).groupBy("video").agg(F.count_if(F.col("valence") > 50).cast("double").alias("c"), F.count(F.lit(1)).cast("double").alias("n"))
    return k.select("video", r6(F.expr("wilson_low(c, n)"), "low"), r6(F.expr("rating_to_label(1 + n % 9)"), "label"),
                    F.expr("half_up(c / n * 100)").alias("percent"))


@query("flt11_gate_status", T + f""", k AS (SELECT subject, CAST(count(*) FILTER (valence > 35) AS DOUBLE) AS c, CAST(count(*) AS DOUBLE) AS n FROM trace GROUP BY subject)
SELECT subject, CASE WHEN {WILSON[0]} - {WILSON[1]} > 0.5 THEN 'PASS' WHEN {WILSON[0]} + {WILSON[1]} < 0.5 THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM k""")
def _(spark, sf):
    k = A.trace(spark, sf).groupBy("subject").agg(F.count_if(F.col("valence") > 35).alias("c"), F.count(F.lit(1)).alias("n"))
    lo, hi = S.wilson(F.col("c"), F.col("n"))
    return k.select("subject", S.gate_status(lo, hi, 0.5).alias("status"))


@query("rg12_guarded_correlation", T + f"""SELECT video, subject, {q6(CORR.format(x='valence', y='arousal'))} AS r,
 {q6('CASE WHEN var_pop(valence) < 1e-12 THEN 0 ELSE covar_pop(valence, arousal) / var_pop(valence) END')} AS slope FROM trace GROUP BY 1, 2""")
def _(spark, sf):
    slope = F.when(F.var_pop("valence") < 1e-12, 0.0).otherwise(F.try_divide(F.covar_pop("valence", "arousal"), F.var_pop("valence")))
    return A.trace(spark, sf).groupBy("video", "subject").agg(r6(S.correlation("valence", "arousal"), "r"), r6(slope, "slope"))


@query("sc16_holm", T + f""", k AS (SELECT subject, video, (1.0 + count(*) FILTER (valence > 120)) / (1.0 + count(*)) AS p FROM trace GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p, subject) AS rn, count(*) OVER (PARTITION BY video) AS m FROM k)
SELECT subject, video, {q6('p')} AS p, {q6('max(least(1, (m - rn + 1) * p)) OVER (PARTITION BY video ORDER BY rn)')} AS adjusted FROM o""")
def _(spark, sf):
    k = A.trace(spark, sf).groupBy("subject", "video").agg(
        ((1.0 + F.count_if(F.col("valence") > 120)) / (1.0 + F.count(F.lit(1)))).alias("p"))
    return holm(k, ["video"], "p", ["subject"], 0.01).select("subject", "video", r6("p"), r6("adjusted"))


def holm(df, keys, p, ties, width):
    """Step-down adjustment inside each family: running maximum of (m-rank+1)*p."""
    placed = D.ranked(df, keys, F.col(p), ties, width, ordinal="_rn").withColumn("_t", F.col("_rn") - 1)
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    both = D.attach(placed, size, keys, "_t", "_m")
    return D.running(both, keys, "_t", F.least(F.lit(1.0), (F.col("_m") - F.col("_rn") + 1) * F.col(p)), "adjusted", "max")


@query("mt6_auroc", f"""WITH l AS (SELECT quality, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
r AS (SELECT *, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM l)
SELECT count(*) FILTER (quality = 1) AS positives, count(*) FILTER (quality = 0) AS negatives,
 {q6('CASE WHEN count(*) FILTER (quality = 1) = 0 OR count(*) FILTER (quality = 0) = 0 THEN 0.5 ELSE (sum(rk) FILTER (quality = 1) - count(*) FILTER (quality = 1) * (count(*) FILTER (quality = 1) + 1) / 2.0) / (count(*) FILTER (quality = 1) * count(*) FILTER (quality = 0)) END')} AS auroc FROM r""")
def _(spark, sf):
    from ..operators import metrics as M
    l = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("y", F.col("quality") == 1)
    return M.auroc(l, "y", "n_chars", 16.0).select("positives", "negatives", r6("auroc"))


@query("mt7_average_precision", f"""WITH l AS (SELECT doc_id, toxic, n_chars FROM labels JOIN documents USING (doc_id)),
r AS (SELECT toxic, sum(toxic) OVER (ORDER BY n_chars DESC, doc_id) AS hits, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM l)
SELECT count(*) FILTER (toxic = 1) AS positives, {q6('coalesce(sum(hits / CAST(k AS DOUBLE)) FILTER (toxic = 1) / nullif(count(*) FILTER (toxic = 1), 0), 0)')} AS average_precision FROM r""")
def _(spark, sf):
    from ..operators import metrics as M
    l = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("y", F.col("toxic") == 1)
    return M.average_precision(l, "y", "n_chars", "doc_id", 16.0).select("positives", r6("average_precision"))
