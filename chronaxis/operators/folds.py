"""Fold plans and held-out designs as key tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import distributed as D


def other_folds(fold: Column, n: int) -> Column:
    """Array of the validation folds a training row serves."""
    return F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda f: f != fold)


def to_training(rows: DataFrame, n: int, fold: str = "fold", out: str = "vfold") -> DataFrame:
    """Copy each row to every validation fold it may train (n-1 copies)."""
    return rows.withColumn(out, F.explode(other_folds(F.col(fold), n)))


def round_robin(ids: DataFrame, column: str, bucket: Column, n: int) -> DataFrame:
    """(id, fold): every n-th id of the sorted distinct ids."""
    return D.dense_index(ids, column, bucket).select(column, (F.col("idx") % n).alias("fold"))
