"""Tables of the data model, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distributed as D
from .shared import written
from .tables import read

LABEL_MIN, LABEL_MAX = 1.0, 255.0
AXES = ("valence", "arousal")


def clip_label(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(LABEL_MIN)), F.lit(LABEL_MAX))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subject, video, t, valence, arousal): one row per labelled second.

    Nearly every job starts here, so the placed table is written once.
    """
    return written(spark, "trace", sf_dir, lambda: build_trace(spark, sf_dir))


def build_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(
        F.col("user_id").alias("subject"),
        F.col("event_type").alias("video"),
        "ts",
        "event_id",
        clip_label(F.col("value")).alias("valence"),
        (1 + F.get_json_object("props", "$.k").cast("double") * 254 / 99).alias("arousal"),
    )
    placed = D.positions(e, ["subject", "video"], ["ts", "event_id"], F.to_date("ts"), "t")
    return placed.select("subject", "video", "t", "valence", "arousal")


def long_axes(df: DataFrame, *keep: str) -> DataFrame:
    """Two rating columns to (axis, value) rows; axis 0 valence, 1 arousal."""
    return df.select(
        *keep,
        F.explode(F.array(
            F.struct(F.lit(0).alias("axis"), F.col("valence").alias("value")),
            F.struct(F.lit(1).alias("axis"), F.col("arousal").alias("value")),
        )).alias("_s"),
    ).select(*keep, "_s.axis", "_s.value")


def trial_lengths(tr: DataFrame) -> DataFrame:
    return tr.groupBy("subject", "video").agg((F.max("t") + 1).alias("n"))


def category(video: str | Column = "video") -> Column:
    """Two-level category of an item.  Fixed values."""
    v = F.col(video) if isinstance(video, str) else video
    return (
        F.when(v.isin("click", "view"), "browse")
        .when(v.isin("purchase", "signup"), "convert")
        .otherwise("fault")
    )


def rating_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced subject x item matrix: (subject, item, x)."""
    return written(spark, "matrix", sf_dir, lambda: build_matrix(spark, sf_dir))


def build_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("subject"), F.year("l_shipdate").alias("item"))
        .agg(F.avg("l_quantity").alias("x"))
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, t, vec_id, features): content features per item second."""
    e = read(spark, sf_dir, "embeddings").select(
        F.col("label").alias("video"), "vec_id", F.col("embedding").cast("array<double>").alias("features")
    )
    return D.positions(e, ["video"], ["vec_id"], F.floor(F.col("vec_id") / 65536), "t")


def subject_index(tr: DataFrame, column: str = "subject", width: int = 4096) -> DataFrame:
    return D.dense_index(tr, column, F.floor(F.col(column) / width))


def subject_folds(tr: DataFrame, n: int = 5) -> DataFrame:
    """(subject, fold): every n-th id of the sorted distinct subjects."""
    return subject_index(tr).select("subject", (F.col("idx") % n).alias("fold"))
