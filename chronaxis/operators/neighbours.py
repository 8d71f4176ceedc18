"""Exact nearest neighbours: on one rating axis by order, on several by grids of growing cells."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import distributed as D


def nearest_on_axis(df: DataFrame, keys: Sequence[str], value: str, who: str, k: int, width: float = 1.0) -> DataFrame:
    """The k other rows with the smallest |difference| per row, ties by ``who``.

    In (value, who) order the candidates above a row are the next k rows; in
    (value, who descending) order those below it are the previous k rows; rows
    with the very same value are covered by the first k of their tie block.
    The union of the three short lists holds the exact answer.
    """
    pick = F.struct(F.col(who).alias("who"), F.col(value).cast("double").alias("x"))
    df = df.withColumn("_me", pick)

    def gather(placed, side, out):
        placed = placed.withColumn("_t", F.col("_rk") - 1)
        reach = (0, k) if side == "after" else (k, 0)

        def add(d, w):
            frame = w.rowsBetween(1, k) if side == "after" else w.rowsBetween(-k, -1)
            return d.withColumn(out, F.collect_list("_me").over(frame))

        return D.framed(placed, keys, "_t", *reach, add).drop("_t", "_rk")

    up = gather(D.ranked(df, keys, F.col(value), [who], width, ordinal="_rk"), "after", "_up")
    down = gather(D.ranked(up, keys, F.col(value), [F.col(who).desc()], width, ordinal="_rk"), "before", "_down")
    # first k+1 of every tie block (k+1 because the row itself may be among them)
    block = D.ranked(df, [*keys, value], F.lit(0.0), [who], width, ordinal="_rk").filter(F.col("_rk") <= k + 1)
    block = block.groupBy(*keys, value).agg(F.collect_list("_me").alias("_tie"))
    joined = down.join(block, [*keys, value], "left")
    others = F.filter(F.array_distinct(F.concat("_up", "_down", F.coalesce("_tie", F.array().cast("array<struct<who:bigint,x:double>>")))),
                      lambda s: s["who"] != F.col(who))
    scored = F.transform(others, lambda s: F.struct(F.abs(s["x"] - F.col(value)).alias("distance"), s["who"].alias("who")))
    return joined.withColumn("near", F.slice(F.array_sort(scored), 1, k)).drop("_me", "_up", "_down", "_tie")


def nearest_in_space(sources: DataFrame, targets: DataFrame, keys: Sequence[str], axes: Sequence[str], who: str, k: int) -> DataFrame:
    """The k sources nearest to each target inside its key, by Euclidean distance over ``axes``, ties by ``who``.

    Adds ``near``, an array of (distance, who) in order; a source with the
    target's own ``who`` never counts.  Rows with a null axis take no part.

    Points are put on grids whose cells double in width from one level to the
    next.  A target climbs to the first level whose own cell holds more than k
    sources; the diagonal of that cell bounds its answer, so only cells one
    level up that this reach can touch are searched.  Points in one place are
    one location that keeps its k + 1 smallest names, and locations are ranked,
    not rows, so a place with a third of all rows costs as much as any other.
    """
    ok = reduce(lambda a, b: a & b, [F.col(a).isNotNull() & ~F.isnan(a) for a in axes])
    src = sources.filter(ok).select(*keys, *[F.col(a).cast("double").alias(a) for a in axes], F.col(who).alias("_who"))
    aim = targets.filter(ok).select(*[c for c in targets.columns if c not in axes], *[F.col(a).cast("double").alias(a) for a in axes])
    place = [*keys, *axes]
    first = src.withColumn("_r", F.row_number().over(Window.partitionBy(*place).orderBy("_who"))).filter(F.col("_r") <= k + 1)
    spots = first.groupBy(*place).agg(F.sort_array(F.collect_list("_who")).alias("_names"))
    asked = aim.select(*place).distinct()

    both = spots.select(*place).unionByName(asked)
    spans = F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(0.0)) if len(axes) > 1 else F.max(axes[0]) - F.min(axes[0])
    frame = both.groupBy(*keys).agg(*[F.min(a).alias(f"_min_{a}") for a in axes], spans.alias("_span"), F.count(F.lit(1)).alias("_k"))
    # Four levels finer than evenly spread points need; the coarsest cell is wider than the key.
    top = F.least(F.lit(40), F.ceil(F.log2(F.col("_k")) / len(axes)) + 4).cast("int")
    frame = frame.withColumn("_top", top + 1).withColumn("_w0", F.greatest(F.col("_span"), F.lit(1e-300)) / F.pow(F.lit(2.0), top) * (1 + 1e-9)).drop("_k", "_span")

    def celled(df: DataFrame) -> DataFrame:
        level = df.join(frame, list(keys)).withColumn("_l", F.explode(F.sequence(F.lit(0), F.col("_top"))))
        width = F.col("_w0") * F.pow(F.lit(2.0), F.col("_l"))
        return level.select(*place, *[c for c in df.columns if c not in place], "_top", "_l", width.alias("_w"),
                            *[F.floor((F.col(a) - F.col(f"_min_{a}")) / width).alias(f"_c_{a}") for a in axes], *[F.col(f"_min_{a}") for a in axes])

    cell = [*keys, "_l", *[f"_c_{a}" for a in axes]]
    there = celled(spots)
    full = there.groupBy(*cell).agg(F.sum(F.size("_names")).alias("_n")).filter(F.col("_n") > k).drop("_n")
    enough = celled(asked).join(full, cell).groupBy(*place).agg(F.min("_l").alias("_have"))
    at = asked.join(enough, place, "left").join(frame, list(keys))
    at = at.withColumn("_l", F.least(F.coalesce(F.col("_have") + 1, F.col("_top")), F.col("_top")))
    at = at.withColumn("_w", F.col("_w0") * F.pow(F.lit(2.0), F.col("_l")))
    reach = F.when(F.col("_have").isNull() | (F.col("_have") == F.col("_top")), F.col("_w")).otherwise(F.col("_w") * (math.sqrt(len(axes)) / 2 * (1 + 1e-9)))
    at = at.withColumn("_u", reach)
    for a in axes:
        low, high = (F.floor((F.col(a) - F.col(f"_min_{a}") + sign * F.col("_u")) / F.col("_w")) for sign in (-1, 1))
        at = at.withColumn(f"_c_{a}", F.explode(F.sequence(low, high)))
    here = there.select(*cell, *[F.col(a).alias(f"_x_{a}") for a in axes], "_names")
    steps = [F.col(f"_x_{a}") - F.col(a) for a in axes]
    distance = F.abs(steps[0]) if len(axes) == 1 else F.sqrt(reduce(lambda p, q: p + q, [s * s for s in steps]))
    found = at.select(*cell, *axes).join(here, cell).select(*place, distance.alias("_d"), "_names")
    order = Window.partitionBy(*place).orderBy("_d", F.col("_names")[0])
    found = found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)
    named = F.transform("_names", lambda n: F.struct(F.col("_d").alias("distance"), n.alias("who")))
    lists = found.groupBy(*place).agg(F.slice(F.sort_array(F.flatten(F.collect_list(named))), 1, k + 1).alias("_list"))
    near = F.slice(F.filter("_list", lambda s: s["who"] != F.col(who)), 1, k)
    return aim.join(lists, place).withColumn("near", near).drop("_list")
