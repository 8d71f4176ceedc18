"""Query registry and the shared SQL snippets of the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark query and, where SQL can say it, its oracle."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark, measured=True)
            return fn(spark, sf_dir)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def r6(c: Column | str, name: str | None = None) -> Column:
    """Six decimals, so that summation order does not show.

    The tiny offset moves exact half-way decimals off the rounding edge.
    """
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double") + 3e-9, 6)
    out = out + F.lit(0.0)  # no negative zero
    label = name or (c if isinstance(c, str) else None)
    return out.alias(label) if label else out


def q6(expr: str) -> str:
    """The SQL twin of :func:`r6`."""
    return f"(round(CAST({expr} AS DOUBLE) + 3e-9, 6) + 0.0)"


TRACE = """trace AS (
  SELECT user_id AS subject, event_type AS video,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS t,
         least(greatest(value, 1), 255) AS valence,
         1 + CAST(json_extract_string(props, '$.k') AS DOUBLE) * 254 / 99 AS arousal
  FROM events)"""

LONG = """long AS (
  SELECT subject, video, t, 0 AS axis, valence AS value FROM trace
  UNION ALL SELECT subject, video, t, 1, arousal FROM trace)"""

CATEGORY = ("CASE WHEN video IN ('click','view') THEN 'browse' "
            "WHEN video IN ('purchase','signup') THEN 'convert' ELSE 'fault' END")

FOLDS = """folds AS (
  SELECT subject, (dense_rank() OVER (ORDER BY subject) - 1) % 5 AS fold
  FROM (SELECT DISTINCT subject FROM trace))"""

MATRIX = """matrix AS (
  SELECT l_suppkey AS subject, CAST(year(l_shipdate) AS INTEGER) AS item, avg(l_quantity) AS x
  FROM lineitem GROUP BY 1, 2)"""

CONTENT = """content AS (
  SELECT label AS video, vec_id, CAST(embedding AS DOUBLE[]) AS features,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t
  FROM embeddings)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def draw_sql(seed: str, draw: str, slot: str, n: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {seed}, {draw}, {slot})), 1, 8)) AS BIGINT) % {n})"


def hash_draw(seed, draw, slot, n) -> Column:
    """Uniform 0..n-1 from a hash, equal in both engines."""
    text = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), draw.cast("string"), slot.cast("string")))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long") % n
