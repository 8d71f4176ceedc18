"""Transfer of group curves between items of a category, without item pairs.

A template for an item of length m is a weighted mean over the other items of
its category, each resampled to m.  Resampling depends on the target only
through m, and the duration weight only through (source length, m), so one sum
per (category, m, second) serves every target of that length; the target's own
share is taken off afterwards.  Work grows with items x distinct lengths, not
with item pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributed as D
from . import priors as P


def stretched(curves: DataFrame, lengths: DataFrame, cell: Sequence[str], source: str, phase_weight: float,
              column: str = "x") -> DataFrame:
    """Every curve at every target length of its category: phase/absolute blend.

    ``curves``: (cell.., source, category, axis, t, x); ``lengths``: (category, m).
    """
    keys = [*cell, source, "category", "axis"]
    # one row per (curve, target length); the grid is opened from it
    ends = curves.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    asked = ends.join(lengths, "category").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    pos = F.when(F.col("m") == 1, F.lit(0.0)).otherwise(F.col("i") * (F.col("_n") - 1) / F.greatest(F.col("m") - 1, F.lit(1)))
    phase = P.sample_at(curves, keys, asked.withColumn("_pos", pos), [column]).drop("_pos")
    absolute = curves.select(*keys, F.col("t").alias("_at"), F.col(column).alias("_abs"))
    both = phase.withColumn("_at", F.least(F.col("i"), F.col("_n") - 1)).join(absolute, [*keys, "_at"])
    return both.withColumn("piece", phase_weight * F.col(column) + (1 - phase_weight) * F.col("_abs")).select(
        *keys, F.col("_n").alias("source_len"), "m", "i", "piece")


def duration_weight(tau: float | None) -> Column:
    if tau is None:
        return F.lit(1.0)
    return F.exp(-F.abs(F.col("source_len") - F.col("m")).cast("double") / float(tau))


def leave_item_out(pieces: DataFrame, targets: DataFrame, cell: Sequence[str], tau: float | None) -> DataFrame:
    """Weighted category mean per target item with the item itself taken off.

    ``targets``: (video, category, m).  Output: (cell.., video, axis, t, sources, template).
    """
    w = duration_weight(tau)
    sums = pieces.groupBy(*cell, "category", "axis", "m", "i").agg(
        F.sum(w).alias("_w"), F.sum(w * F.col("piece")).alias("_s"), F.count(F.lit(1)).alias("_k"))
    own = pieces.join(targets.select("video", "m"), ["video", "m"]).select(
        *cell, "video", "axis", "i", w.alias("_ow"), "piece")
    wanted = targets.join(sums, ["category", "m"])
    j = wanted.join(own, [*cell, "video", "axis", "i"], "left")
    k = F.col("_k") - F.when(F.col("piece").isNotNull(), 1).otherwise(0)
    num = F.col("_s") - F.coalesce(F.col("_ow") * F.col("piece"), F.lit(0.0))
    den = F.col("_w") - F.coalesce(F.col("_ow"), F.lit(0.0))
    return j.select(*cell, "video", "axis", F.col("i").alias("t"), k.alias("sources"),
                    F.when(k > 0, num / den).alias("template"))
