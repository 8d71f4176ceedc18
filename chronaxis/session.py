"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Rows joined to a per-key table split hot keys at run time, even when the
    # split costs one more exchange further up.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


# What a plan estimates knows nothing of rows that an explode or a join multiplies: a file of a few MB
# became a broadcast of millions of rows. Finished stages are measured; up to this size they are copied.
BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "1m"}
_GIVEN: dict[str, dict[str, str | None]] = {}


def tune(spark: SparkSession, measured: bool = False) -> SparkSession:
    """Apply the run-time settings; cluster sizing stays with the cluster.

    With ``measured`` only stages of a known small size are broadcast, else
    what the session was given applies.
    """
    given = _GIVEN.setdefault(spark.sparkContext.applicationId, {k: spark.conf.get(k, None) for k in BROADCAST})
    for key, value in {**RUNTIME, **(BROADCAST if measured else given)}.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    return spark


def build(master: str = "local[*]", partitions: int = 8, app: str = "chronaxis") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
