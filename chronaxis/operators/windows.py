"""Row-frame operators over trials, all chunk-safe."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributed as D


def lagged(source: str, k: int, w) -> Column:
    """x(t-k); the first value of the key stands in before the start."""
    return F.coalesce(F.lag(source, k).over(w), F.first(source).over(w.rowsBetween(-k, 0)))


def led(source: str, k: int, w) -> Column:
    return F.coalesce(F.lead(source, k).over(w), F.last(source).over(w.rowsBetween(0, k)))


def gradient(source: str, w) -> Column:
    """Central difference inside, one-sided at the ends, 0 for a single row."""
    back, ahead, x = F.lag(source, 1).over(w), F.lead(source, 1).over(w), F.col(source)
    return (
        F.when(back.isNotNull() & ahead.isNotNull(), (ahead - back) / 2)
        .when(ahead.isNotNull(), ahead - x)
        .when(back.isNotNull(), x - back)
        .otherwise(F.lit(0.0))
    )


def add_gradient(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    def add(d, w):
        for source, out in columns.items():
            d = d.withColumn(out, gradient(source, w))
        return d

    return D.framed(df, keys, "t", 1, 1, add)


def robust_z(df: DataFrame, keys: Sequence[str], source: str, out: str, width: float = 1.0) -> DataFrame:
    """(x - median) / scale; scale is 1.4826*MAD, else the std, else zeros (below 1e-6)."""
    stats = df.groupBy(*keys).agg(F.stddev_pop(source).alias("_sd"), (F.max("t") + 1).alias("_len"))
    med = D.quantiles(df, keys, F.col(source), {"_med": 0.5}, width).drop("n")
    one = D.attach(df, med.join(stats, list(keys)), keys, length="_len")
    mad = D.quantiles(one, keys, F.abs(F.col(source) - F.col("_med")), {"_mad": 0.5}, width).drop("n")
    full = mad.join(stats.select(*keys, "_len"), list(keys)).withColumnRenamed("_len", "_len2")
    two = D.attach(one, full, keys, length="_len2")
    s = 1.4826 * F.col("_mad")
    scale = F.when(s >= 1e-6, s).when(F.col("_sd") >= 1e-6, F.col("_sd"))
    z = F.coalesce((F.col(source) - F.col("_med")) / scale, F.lit(0.0))
    return two.withColumn(out, z).drop("_med", "_mad", "_sd", "_len", "_len2")


def event_mask(df: DataFrame, keys: Sequence[str], strength: str, fraction: float = 0.25, out: str = "event",
               width: float = 1.0) -> DataFrame:
    """Exactly ceil(n*fraction) strongest rows of the key, ties by time."""
    placed = D.ranked(df, keys, F.col(strength), ["t"], width, descending=True, ordinal="_k")
    size = df.groupBy(*keys).agg((F.max("t") + 1).alias("_len"))
    both = D.attach(placed, size, keys, length="_len")
    n = F.col("_len")
    take = F.least(F.greatest(F.lit(1), F.ceil(n * fraction)), F.greatest(n - 1, F.lit(1)))
    return both.withColumn(out, F.col("_k") <= take).drop("_k", "_len")


BLOCK = 64


def ema(df: DataFrame, keys: Sequence[str], source: str, decay: float, out: str) -> DataFrame:
    """Causal EMA seeded by the first value, reset at every key.

    Blocks of 64 rows are scanned independently; the state entering a block is
    a weighted sum of earlier block ends.  Its frame stops where the weight is
    zero in double precision, so no key is walked by one task.
    """
    if decay == 0.0:
        return df.withColumn(out, F.col(source))
    d = F.lit(float(decay))
    i = F.col("t") % BLOCK
    gain = F.when(F.col("t") == 0, F.lit(1.0)).otherwise(1 - d)
    rows = df.withColumn("_blk", D.chunk_of("t", BLOCK))
    local = Window.partitionBy(*keys, "_blk").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_y", F.pow(d, i) * F.sum(gain * F.col(source) * F.pow(d, -i)).over(local))
    # state at the end of each block, starting the block from zero
    ends = rows.groupBy(*keys, "_blk").agg(F.max_by("_y", "t").alias("_end"))
    per_block = float(decay) ** BLOCK
    reach = max(1, math.ceil(745.0 / (-math.log(decay) * BLOCK))) + 1

    def carry(b, w):
        terms = F.lit(0.0)
        for k in range(1, reach + 1):
            terms = terms + F.coalesce(F.lag("_end", k).over(w), F.lit(0.0)) * (per_block ** (k - 1))
        return b.withColumn("_carry", terms)

    states = D.framed(ends, keys, "_blk", reach, 0, carry).drop("_end")
    return (
        rows.join(states, [*keys, "_blk"])
        .withColumn(out, F.col("_y") + F.pow(d, i + 1) * F.col("_carry"))
        .drop("_blk", "_y", "_carry")
    )


def chunks(df: DataFrame, keys: Sequence[str], length: int, stride: int) -> DataFrame:
    """Rows of every fixed-length chunk; short chunks at the end are dropped."""
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("t") - (length - 1)) / stride))
    last = F.floor(F.col("t") / stride)
    member = df.withColumn("chunk", F.explode(F.when(first <= last, F.sequence(first, last))))
    full = Window.partitionBy(*keys, "chunk")
    return member.withColumn("_c", F.count(F.lit(1)).over(full)).filter(F.col("_c") == length).drop("_c")
