"""Variance components and reliability of subject x item matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variance_components(matrix: DataFrame, keys: Sequence[str] = (), subject: str = "subject", item: str = "item",
                        x: str = "x", wp: str | None = None, wv: str | None = None) -> DataFrame:
    """Balanced two-facet components per key, optionally with drawn multiplicities.

    With multiplicities the duplicates count as new facet levels: means are
    weighted and the degrees of freedom stay (levels - 1).  The three sums of
    squares come from one pass over the cells and two small roll-ups.
    """
    p, v = (F.col(wp) if wp else F.lit(1)), (F.col(wv) if wv else F.lit(1))
    base = matrix.withColumn("_x", F.col(x)).withColumn("_p", p.cast("double")).withColumn("_v", v.cast("double"))
    rows = base.groupBy(*keys, subject).agg(
        F.sum(F.col("_v") * F.col("_x")).alias("sx"), F.sum(F.col("_v") * F.col("_x") ** 2).alias("sxx"),
        F.sum("_v").alias("nv"), F.max("_p").alias("w"))
    cols = base.groupBy(*keys, item).agg(
        F.sum(F.col("_p") * F.col("_x")).alias("sx"), F.sum("_p").alias("np"), F.max("_v").alias("w"))
    r = rows.groupBy(*keys) if keys else rows
    c = cols.groupBy(*keys) if keys else cols
    ra = r.agg(F.sum("w").alias("P"), F.max("nv").alias("V"), F.sum(F.col("w") * F.col("sxx")).alias("_xx"),
               F.sum(F.col("w") * F.col("sx")).alias("_s"), F.sum(F.col("w") * (F.col("sx") / F.col("nv")) ** 2).alias("_pp"))
    ca = c.agg(F.sum(F.col("w") * (F.col("sx") / F.col("np")) ** 2).alias("_vv"))
    j = ra.join(ca, list(keys)) if keys else ra.withColumn("_vv", ca.scalar())
    P, V = F.col("P"), F.col("V")
    g = F.col("_s") / (P * V)
    ssp = V * (F.col("_pp") - P * g * g)
    ssv = P * (F.col("_vv") - V * g * g)
    sst = F.col("_xx") - P * V * g * g
    j = j.withColumn("ms_subject", ssp / (P - 1)).withColumn("ms_item", ssv / (V - 1)).withColumn(
        "ms_residual", (sst - ssp - ssv) / ((P - 1) * (V - 1))).withColumn("grand", g)
    j = j.withColumn("raw_subject", (F.col("ms_subject") - F.col("ms_residual")) / V).withColumn(
        "raw_item", (F.col("ms_item") - F.col("ms_residual")) / P)
    zero = F.lit(0.0)
    return j.select(
        *keys, "P", "V", "grand", "ms_subject", "ms_item", "ms_residual", "raw_subject", "raw_item",
        F.greatest("raw_subject", zero).alias("var_subject"), F.greatest("raw_item", zero).alias("var_item"),
        F.greatest("ms_residual", zero).alias("var_residual"))


def relative_g(k: Column) -> Column:
    d = F.col("var_subject") + F.col("var_residual") / k
    return F.when(d > 0, F.col("var_subject") / d).otherwise(0.0)


def absolute_phi(k: Column) -> Column:
    d = F.col("var_subject") + (F.col("var_item") + F.col("var_residual")) / k
    return F.when(d > 0, F.col("var_subject") / d).otherwise(0.0)


def curve(components: DataFrame, top: int) -> DataFrame:
    """Both coefficients for k = 1..top items."""
    k = components.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(top).cast("long"))))
    return k.withColumn("relative_g", relative_g(F.col("k"))).withColumn("absolute_phi", absolute_phi(F.col("k")))


def first_k(components: DataFrame, keys: Sequence[str], threshold: float, coefficient: str, top: int = 100) -> DataFrame:
    """Smallest k reaching the threshold, null when the cap is not enough."""
    c = curve(components, top)
    hit = F.min(F.when(F.col(coefficient) >= threshold, F.col("k")))
    return (c.groupBy(*keys) if keys else c).agg(hit.alias("k"))


def centred(matrix: DataFrame, x: str = "x") -> DataFrame:
    """Subtract the grand mean once, so that squared sums keep their digits."""
    return matrix.withColumn(x, F.col(x) - matrix.agg(F.avg(x)).scalar())
