"""Comparisons against every donor of a group, by order instead of by pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import distributed as D


def mean_distance(queries: DataFrame, points: DataFrame, keys: Sequence[str], at: str, value: str, out: str = "distance",
                  width: float = 1.0) -> DataFrame:
    """Mean |at - value| over all points of the query's group.

    Queries and points are put in one order per group; the number and the sum
    of the points below a query, with the group totals, give the mean exactly.
    Nothing is paired, so a group of any size costs its own length.
    """
    q = queries.select("*", F.lit(0).alias("_is"), F.col(at).cast("double").alias("_v"))
    p = points.select(*keys, F.lit(1).alias("_is"), F.col(value).cast("double").alias("_v"))
    both = q.unionByName(p, allowMissingColumns=True)
    placed = D.ranked(both, keys, F.col("_v"), ["_is"], width, ordinal="_k").withColumn("_t", F.col("_k") - 1)
    low = D.running(placed, keys, "_t", F.col("_is").cast("double"), "_nb")
    low = D.running(low, keys, "_t", F.when(F.col("_is") == 1, F.col("_v")).otherwise(0.0), "_sb")
    total = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(value).cast("double")).alias("_s"))
    x = F.col("_v")
    dist = (x * F.col("_nb") - F.col("_sb") + (F.col("_s") - F.col("_sb")) - x * (F.col("_n") - F.col("_nb"))) / F.col("_n")
    return low.filter("_is = 0").join(total, list(keys)).withColumn(out, dist).drop("_is", "_v", "_k", "_t", "_nb", "_sb", "_s").withColumnRenamed("_n", "donors")
