"""Hash-based resampling: draws are columns, not loops.

A draw is a pure function of (seed, draw, slot), so a lost task recomputes the
same sample, and both facets of a crossed design use multiplicities instead of
a join of two sampled lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributed as D

HASH_WIDTH = float(1 << 20)


def hash_value(*parts) -> Column:
    """32-bit number from the md5 of the '|'-joined parts."""
    text = F.md5(F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]))
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def draws(r: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r - 1).cast("long")))


def multiplicities(ids: DataFrame, idx: str, n: Column, seed: str, r: int, out: str) -> DataFrame:
    """(draw, idx, out): how often each unit is drawn when n are drawn with replacement.

    Every unit also acts as one slot, so the slot table is the unit table itself.
    A small file of units is one task, in which every draw of every unit would
    be counted, so the drawn units are dealt by (draw, unit) before they are.
    """
    slots = ids.select(F.col(idx).alias("_slot"), n.alias("_n")).withColumn("draw", draws(r))
    picked = slots.select("draw", (hash_value(seed, F.col("draw"), F.col("_slot")) % F.col("_n")).alias(idx))
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return picked.repartition(parts, "draw", idx).groupBy("draw", idx).agg(F.count(F.lit(1)).alias(out))


def bootstrap_mean(values: DataFrame, idx: str, x: str, n: Column, seed: str, r: int) -> DataFrame:
    """(draw, stat): mean of x over n drawn units."""
    m = multiplicities(values, idx, n, seed, r, "m")
    return m.join(values.select(idx, x), idx).groupBy("draw").agg((F.sum(F.col("m") * F.col(x)) / F.sum("m")).alias("stat"))


def interval(stats: DataFrame, column: str = "stat", *keys: str) -> DataFrame:
    """Exact 2.5 / 97.5 percentiles over the draws (the draw count is a parameter, so groups are bounded)."""
    p = F.percentile(column, F.array(F.lit(0.025), F.lit(0.975)))
    g = stats.groupBy(*keys) if keys else stats
    return g.agg(F.avg(column).alias("mean"), p.alias("_p"), F.count(F.lit(1)).alias("draws")).select(
        *keys, "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"), "draws")


def shuffled_rank(df: DataFrame, keys: Sequence[str], seed_parts: list, tie: str, out: str) -> DataFrame:
    """1-based rank of each row in a hash order inside its key, spread over hash ranges."""
    h = df.withColumn("_h", hash_value(*seed_parts))
    return D.ranked(h, keys, F.col("_h"), [tie], HASH_WIDTH, ordinal=out).drop("_h")
