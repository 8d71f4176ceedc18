"""Streaming jobs run to completion over the given files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import distributed as D
from ..sources.routes import routes
from ..sources.tables import read
from ..streaming import jobs as J
from .quality_queries import scratch
from .registry import q6, query, r6
from .rule_queries import ACTION, ROUTES


# Every event is emitted: an end mark moves the watermark past the last one.
SW = """WITH seen AS (SELECT event_id, user_id AS subject, event_type AS video, ts, least(greatest(value, 1), 255) AS x, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t FROM events)"""


def run(spark, sf, name, build):
    """Each run takes new sink and checkpoint folders in the shared folder."""
    base = scratch(spark, f"{name}-{uuid.uuid4().hex[:8]}", sf)
    return J.drain(build, f"{base}/out", f"{base}/state")


def run_events(spark, sf, name, job):
    """An event-time job over all events, closed by an end mark."""
    base = scratch(spark, f"{name}-{uuid.uuid4().hex[:8]}", sf)
    closing = f"{base}/closing"
    read(spark, sf, "events").limit(0).write.parquet(closing)  # the folder must exist
    return J.drain(job(J.event_stream(spark, sf, closing=closing)), f"{base}/out", f"{base}/state", closing)


@query("sm1_streaming_route_audit", "WITH " + ROUTES + f" SELECT id, {ACTION} AS audited_action FROM routes")
def _(spark, sf):
    path = scratch(spark, "route-feed", sf)
    r = routes(spark, sf).select("id", "deployment_stage", "route_capability", "evidence")
    r.write.mode("overwrite").json(path)
    feed = spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 2).json(path)
    return run(spark, sf, "routes", J.route_audit(feed)).select("id", "audited_action")


@query("sm2_streaming_ema", SW + f""" SELECT a.subject, a.video, a.event_id, {q6("sum(CASE WHEN b.t = 0 THEN pow(0.8, a.t) * b.x ELSE 0.2 * pow(0.8, a.t - b.t) * b.x END)")} AS ema
FROM seen a JOIN seen b ON a.subject = b.subject AND a.video = b.video AND b.t <= a.t GROUP BY 1, 2, 3""")
def _(spark, sf):
    return run_events(spark, sf, "ema", lambda e: J.ema(e, 0.8)).select("subject", "video", "event_id", r6("ema"))


@query("sm3_streaming_trailing_mean", SW + f""" SELECT subject, video, event_id, {q6('avg(x) OVER (PARTITION BY subject, video ORDER BY t ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)')} AS mean,
 {q6('coalesce(lag(x, 2) OVER (PARTITION BY subject, video ORDER BY t), first_value(x) OVER (PARTITION BY subject, video ORDER BY t))')} AS lagged FROM seen""")
def _(spark, sf):
    return run_events(spark, sf, "trail", lambda e: J.trailing(e, 4, 2)).select("subject", "video", "event_id", r6("mean"), r6("lagged"))


@query("sm4_streaming_context", SW + f""", c AS (SELECT *, coalesce(lag(x, 2) OVER w, first_value(x) OVER w) AS x2, coalesce(lag(x, 1) OVER w, x) AS x1 FROM seen WINDOW w AS (PARTITION BY subject, video ORDER BY t))
SELECT subject, video, event_id, {q6('x2')} AS x2, {q6('x1')} AS x1, {q6('x - x2')} AS change FROM c""")
def _(spark, sf):
    return run_events(spark, sf, "ctx", J.context).select("subject", "video", "event_id", r6("x2"), r6("x1"), r6("change"))


@query("sm5_streaming_chunks", SW + f""", w AS (SELECT event_type AS video, least(greatest(value, 1), 255) AS x, time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR * k AS start FROM events, (SELECT unnest([0, 1]) AS k))
SELECT start, video, count(*) AS n, {q6('avg(x)')} AS mean FROM w GROUP BY 1, 2""")
def _(spark, sf):
    return run_events(spark, sf, "chunks", lambda e: J.chunk_aggregate(e, "6 hours", "3 hours")).select(
        F.col("start").cast("timestamp_ntz").alias("start"), "video", "n", r6("mean"))


@query("sm6_streaming_sessions", SW + f""", g AS (SELECT user_id AS subject, ts, least(greatest(value, 1), 255) AS x, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY subject ORDER BY ts) AS k FROM g)
SELECT min(ts) AS start, subject, count(*) AS n, {q6('min(x)')} AS low, {q6('max(x)')} AS high FROM s GROUP BY subject, k""")
def _(spark, sf):
    return run_events(spark, sf, "sess", lambda e: J.sessions(e, "30 minutes")).select(
        F.col("start").cast("timestamp_ntz").alias("start"), "subject", "n", r6("low"), r6("high"))


@query("sm7_streaming_gated_residual", f"""WITH p AS (SELECT event_type, quantile_cont(least(greatest(value, 1), 255), 0.5) AS prior FROM events GROUP BY 1)
SELECT event_id, {q6('least(greatest(prior + least(greatest(0.5 * (least(greatest(value, 1), 255) - prior), -20), 20), 1), 255)')} AS corrected FROM events JOIN p USING (event_type)""")
def _(spark, sf):
    from ..operators import priors as P
    e = read(spark, sf, "events").select(F.col("event_type").alias("video"), P.clip(F.col("value")).alias("x"))
    prior = D.quantiles(e, ["video"], F.col("x"), {"prior": 0.5}).drop("n")
    return run(spark, sf, "gate", J.gated_residual(J.event_stream(spark, sf), prior, 0.5, 20.0)).select("event_id", r6("corrected"))
