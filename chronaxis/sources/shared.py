"""Derived tables that several jobs share, written once per application.

Writing a table cuts its lineage: a lost executor costs a re-read, not a
re-run of the whole chain, and readers keep column pruning and file statistics.
The folder is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[tuple[str, str], tuple[str, object]] = {}
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a scratch folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-chronaxis-")
    return _LOCAL[app]


def written(spark: SparkSession, name: str, scope: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write the table on first use in this application, then scan it."""
    app = spark.sparkContext.applicationId
    digest = hashlib.sha256(f"{name}|{scope}".encode()).hexdigest()[:16]
    key = (app, digest)
    if key not in _WRITTEN:
        df = build()
        path = f"{shared_folder(spark)}/chronaxis/{app}/{name}-{digest}"
        df.write.mode("overwrite").parquet(path)
        _WRITTEN[key] = (path, df.schema)
    path, schema = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def parked(df: DataFrame, name: str) -> DataFrame:
    """Write a table of an iteration under a name of its own, and scan it from there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/chronaxis/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
