"""Leading item directions of a sparse subject x item table, per held-out fold.

Block power iteration: a thin factor (one short vector per item and fold) is
multiplied by the table and its transpose with two equality joins, made
orthonormal through a small Gram matrix per fold, and repeated until the
residuals of its Ritz vectors are at rounding level.  No item x item matrix is
formed, and a missing cell is a deviation of zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import parked
from .ridge import gram

EXTRA = 6  # columns beyond the wanted rank; they speed up the leading ones
ROUNDS = 200
EXACT = 1e-6  # residual of the wanted Ritz vectors, relative to the largest value, from which rounding decides


def _sums(rate: Column, vector: Column, width: int) -> Column:
    return F.array(*[F.sum(rate * F.element_at(vector, k + 1)) for k in range(width)])


def _turned(vector: str, matrix: str, block: int) -> Column:
    """A short row vector times a matrix that lies flat, row by row."""
    return F.transform(F.sequence(F.lit(1), F.lit(block)), lambda j: F.aggregate(
        F.zip_with(F.sequence(F.lit(0), F.lit(block - 1)), vector, lambda i, x: x * F.element_at(matrix, i * block + j)), F.lit(0.0), lambda a, b: a + b))


def _step(block: int, rank: int):
    """From the Gram of (L, CL): how to make CL orthonormal, how to turn L into Ritz vectors, and how far they are off."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros((2 * block, 2 * block))
        full[pdf["i"], pdf["j"]] = pdf["v"]
        inner, after = full[:block, block:], full[block:, block:]
        size, axes = np.linalg.eigh(after)
        sound = size > 1e-14 * max(size.max(), 1e-300)
        root = axes * np.where(sound, 1 / np.sqrt(np.where(sound, size, 1.0)), 0.0)
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        off = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", turn, after, turn) - values**2, 0.0))
        wrong = float(off[:rank].max() / max(values[0], 1e-300)) if len(values) else 0.0
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "next": [root.ravel()], "ritz": [turn.ravel()], "wrong": [wrong]})
    return run


def loadings(rows: DataFrame, n: int, rank: int) -> DataFrame:
    """fold, item, load: for every fold the ``rank`` leading directions of the other folds' subjects, as unit vectors over items.

    ``rows`` has subject, item, fold and d, the deviation from the item's mean;
    repeated cells add up.  Directions beyond the number of items are zero.  Of
    each direction the entry of largest size is positive.
    """
    block = rank + EXTRA
    rows = parked(rows.select("subject", "item", "fold", "d"), "cells")
    noise = lambda f: F.transform(F.sequence(F.lit(1), F.lit(block)), lambda k: F.xxhash64("item", k, f) / float(1 << 63))
    items = rows.select("item").distinct()
    long = items.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("fold", "item", noise(F.col("fold")).alias("x"))
    shape = "fold long, next array<double>, ritz array<double>, wrong double"

    def turned(table: DataFrame, vector: str, matrix: str) -> DataFrame:
        small = table.select("fold", "item", vector).join(step.select("fold", matrix), "fold")
        return small.select("fold", "item", _turned(vector, matrix, block).alias("x"))

    # A first Gram of the noise alone makes it orthonormal.
    step = parked(gram(long.withColumn("x", F.concat("x", "x")), "fold", "x").groupBy("fold").applyInPandas(_step(block, rank), shape), "turns")
    now = parked(turned(long, "x", "next"), "factor")
    last = np.inf
    for _ in range(ROUNDS):
        wide = now.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("fold", "x"))).alias("_f")).select("item", F.flatten("_f.x").alias("x"))
        seen = rows.join(wide, "item").groupBy("subject", "fold").agg(_sums(F.col("d"), F.col("x"), n * block).alias("y"))
        # A subject takes no part in the factor of its own fold.
        seen = seen.select("subject", F.transform("y", lambda v, k: F.when(F.floor(k / block) == F.col("fold"), 0.0).otherwise(v)).alias("y"))
        back = rows.join(seen, "subject").groupBy("item").agg(_sums(F.col("d"), F.col("y"), n * block).alias("y"))
        back = back.select("item", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.slice("y", f * block + 1, block))).alias("fold", "after"))
        both = parked(now.join(back.withColumn("fold", F.col("fold").cast(now.schema["fold"].dataType)), ["fold", "item"]), "products")
        step = parked(gram(both.withColumn("x", F.concat("x", "after")), "fold", "x").groupBy("fold").applyInPandas(_step(block, rank), shape), "turns")
        wrong = step.agg(F.max("wrong")).first()[0] or 0.0
        if wrong <= EXACT * 1e-2 or (wrong <= EXACT and wrong > last / 2):
            break
        last = wrong
        now = parked(turned(both, "after", "next"), "factor")
    found = turned(both, "x", "ritz").select("fold", "item", F.slice("x", 1, rank).alias("load"))
    peaks = found.groupBy("fold").agg(*[F.max_by(F.element_at("load", r + 1), F.struct(F.abs(F.element_at("load", r + 1)), "item")).alias(f"_p{r}") for r in range(rank)])
    signs = peaks.select("fold", F.array(*[F.when(F.col(f"_p{r}") < 0, -1.0).otherwise(1.0) for r in range(rank)]).alias("_s"))
    return found.join(signs, "fold").select("fold", "item", F.zip_with("load", "_s", lambda a, b: a * b).alias("load"))
