"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_folder


#: Whole texts travel in Arrow batches; their size is bounded in bytes, not only in rows.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "5000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def persisted(df: DataFrame, tag: str) -> DataFrame:
    """Write a table below ``spark.checkpoint.dir`` and scan it from there.

    A lost executor then costs a re-read.  Every call takes a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
