"""Broadcasts of the registered queries follow measured sizes, not estimates."""

from pyspark.sql import functions as F

from chronaxis.plans import registry
from chronaxis.session import tune

LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def test_a_multiplied_table_is_not_broadcast(spark, tmp_path, monkeypatch):
    """A file far below the default limit holds 3.2 million rows once exploded."""
    monkeypatch.setattr(registry, "QUERIES", {})
    given = spark.conf.get(LIMIT)
    path = str(tmp_path / "rows")
    spark.range(100000).write.parquet(path)

    @registry.query("probe")
    def _(s, sf):
        many = s.read.parquet(sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31))))
        return many.join(many.withColumnRenamed("k", "j"), "id")

    plan = registry.QUERIES["probe"](spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    tune(spark)
    assert spark.conf.get(LIMIT) == given


def test_small_finished_stages_are_broadcast(spark):
    tune(spark, measured=True)
    few = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    joined = spark.range(100000).withColumn("k", F.col("id") % 10).join(few, "k")
    joined.collect()
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    tune(spark)
