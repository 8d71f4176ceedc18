"""Error metrics on long prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import distributed as D


def trial_error(oof: DataFrame, pred: str = "prior", *extra: str) -> DataFrame:
    """Mean absolute error of each (subject, video) over seconds and axes."""
    return oof.groupBy(*extra, "subject", "video").agg(F.avg(F.abs(F.col(pred) - F.col("value"))).alias("mae"))


def macro_mae(oof: DataFrame, pred: str = "prior", *extra: str) -> DataFrame:
    """Mean over trials of the trial error."""
    per = trial_error(oof, pred, *extra)
    grouped = per.groupBy(*extra) if extra else per
    return grouped.agg(F.count(F.lit(1)).alias("trials"), F.avg("mae").alias("macro_mae"))


def auroc(rows: DataFrame, target: str, score: str, width: float, *keys: str) -> DataFrame:
    """Area under the ROC curve from average ranks; 0.5 with one class only.

    Copies are counted per distinct score before any ordering.
    """
    pos, neg = F.count_if(F.col(target)), F.count_if(~F.col(target))
    cells = rows.groupBy(*keys, F.col(score).cast("double").alias("_x")).agg(
        pos.alias("_p"), neg.alias("_q")).withColumn("_b", F.floor(F.col("_x") / F.lit(width)))
    cells = cells.withColumn("_m", F.col("_p") + F.col("_q"))
    bins = cells.groupBy(*keys, "_b").agg(F.sum("_m").alias("_bm"))
    bins = D.prefix_offsets(bins, keys, "_b", "_bm", "_before").drop("_bm")
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.join(bins, [*keys, "_b"]).withColumn(
        "_rank", F.col("_before") + F.coalesce(F.sum("_m").over(inside), F.lit(0)) + (F.col("_m") + 1) / 2)
    g = ranked.groupBy(*keys) if keys else ranked
    out = g.agg(F.sum("_p").alias("p"), F.sum("_q").alias("q"), F.sum(F.col("_rank") * F.col("_p")).alias("s"))
    p, q = F.col("p"), F.col("q")
    area = F.coalesce(F.try_divide(F.col("s") - p * (p + 1) / 2, (p * q).cast("double")), F.lit(0.5))
    return out.select(*keys, p.alias("positives"), q.alias("negatives"), area.alias("auroc"))


def average_precision(rows: DataFrame, target: str, score: str, tie: str, width: float, *keys: str) -> DataFrame:
    """Average precision; ties keep the order of ``tie``."""
    placed = D.ranked(rows, keys, F.col(score), [tie], width, descending=True, ordinal="_pos")
    hits = D.running(placed.withColumn("_t", F.col("_pos") - 1), keys, "_t",
                     F.col(target).cast("long"), "_hits")
    g = hits.groupBy(*keys) if keys else hits
    total = F.count_if(F.col(target))
    return g.agg(
        total.alias("positives"),
        F.coalesce(F.try_divide(F.sum(F.when(F.col(target), F.col("_hits") / F.col("_pos"))), total.cast("double")),
                   F.lit(0.0)).alias("average_precision"),
    )
