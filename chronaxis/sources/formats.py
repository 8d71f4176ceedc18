"""File readers and writers of the data model: declared schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("video_id STRING, target_code STRING, target_label STRING, source_dataset STRING, title STRING, "
            "reported_duration_seconds STRING, annotation_seconds STRING, local_filename STRING, source_reference STRING, "
            "source_excerpt STRING, expected_sha256 STRING, access_status STRING")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Item manifest: trimmed text, lower-case hash, typed numbers; bad rows keep nulls for the checks."""
    raw = spark.read.schema(MANIFEST).option("header", True).option("encoding", "UTF-8").csv(path)
    t = raw.select(*[F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in raw.columns])
    return t.withColumn("video_id", F.expr("try_cast(video_id AS INT)")).withColumn(
        "reported_duration_seconds", F.expr("try_cast(reported_duration_seconds AS INT)")).withColumn(
        "annotation_seconds", F.expr("try_cast(annotation_seconds AS INT)")).withColumn("expected_sha256", F.lower("expected_sha256"))


def read_wide_ratings(spark: SparkSession, path: str, items: int) -> DataFrame:
    """``sub_id, Video_k_Valence, Video_k_Arousal`` to (subject, video, valence, arousal)."""
    names = [f"Video_{k}_{a}" for k in range(1, items + 1) for a in ("Valence", "Arousal")]
    ddl = "sub_id STRING, " + ", ".join(f"{n} DOUBLE" for n in names)
    wide = spark.read.schema(ddl).option("header", True).csv(path)
    long = wide.unpivot("sub_id", names, "name", "rating")
    video = F.regexp_extract("name", r"^Video_(\d+)_", 1).cast("int")
    at = lambda a: F.max(F.when(F.col("name").endswith(a), F.col("rating")))
    return long.groupBy(F.trim("sub_id").alias("subject"), video.alias("video")).agg(at("Valence").alias("valence"), at("Arousal").alias("arousal"))


def read_masks(spark: SparkSession, path: str, channels: int) -> DataFrame:
    """``sub_id, ch-1..ch-n`` to (subject, channel, w); a blank is 0."""
    names = [f"ch-{k}" for k in range(1, channels + 1)]
    wide = spark.read.schema("sub_id STRING, " + ", ".join(f"`{n}` STRING" for n in names)).option("header", True).csv(path)
    return wide.filter(F.trim(F.coalesce("sub_id", F.lit(""))) != "").select(
        F.trim("sub_id").alias("subject"), F.explode(F.array(*[
            F.struct(F.lit(k + 1).alias("channel"), F.coalesce(F.expr(f"try_cast(`{n}` AS DOUBLE)"), F.lit(0.0)).alias("w")) for k, n in enumerate(names)])).alias("s")).select("subject", "s.*")


def read_code_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, position, code): the digits 0-4 standing alone in every text line."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.posexplode(F.regexp_extract_all("value", F.lit(r"\b([0-4])\b"), F.lit(1))).alias("position", "code")).select(
        "line", "position", F.col("code").cast("int").alias("code"))


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def stack_tables(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two tables with the union of their columns."""
    return first.unionByName(second, allowMissingColumns=True)
