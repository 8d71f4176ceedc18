"""Route records derived from orders and their customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rulebook import ACTIONS, EVIDENCE
from .tables import read


def _cycle(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def _match(column: str, pairs: dict[str, str]) -> Column:
    out = None
    for k, v in pairs.items():
        out = F.when(F.col(column) == k, v) if out is None else out.when(F.col(column) == k, v)
    return out


STAGE_OF_PRIORITY = {
    "1-URGENT": "REVERSIBLE_PERSONALIZATION", "2-HIGH": "CONSEQUENTIAL_PERSONALIZATION",
    "3-MEDIUM": "OFFLINE_ESTIMATION", "4-NOT SPECIFIED": "OPTIONAL_ACQUISITION", "5-LOW": "RETENTION_TRANSFER"}
CONTROL_OF_SEGMENT = {"AUTOMOBILE": "SUPPORTED", "BUILDING": "PARTIAL", "FURNITURE": "NOT_TESTED",
                      "HOUSEHOLD": "NOT_REPORTED", "MACHINERY": "NOT_APPLICABLE"}


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One route record per order, in the vocabularies of the rule document."""
    o = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate")
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k, cust, nat, cents = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey"), F.floor("o_totalprice")
    scope = F.when(F.col("o_orderstatus") == "F", "MATCHED").when(F.col("o_orderstatus") == "O", "PARTIAL").otherwise(
        F.when(k % 2 == 0, "NOT_TESTED").otherwise("MATCHED"))
    evidence = F.struct(
        scope.alias("interpretation_scope"),
        _cycle(EVIDENCE["comparator_increment"], cents).alias("comparator_increment"),
        _cycle(EVIDENCE["evaluation_mode"], cust).alias("evaluation_mode"),
        _cycle(EVIDENCE["user_outcome"], k).alias("user_outcome"),
        _match("c_mktsegment", CONTROL_OF_SEGMENT).alias("user_control"),
        _cycle(EVIDENCE["safety_reversibility"], nat).alias("safety_reversibility"),
        _cycle(EVIDENCE["persistence"], F.floor(k / 4)).alias("persistence"),
        _cycle(EVIDENCE["transfer"], F.floor(cust / 3)).alias("transfer"),
        _cycle(EVIDENCE["reference_equity"], F.floor(k / 16)).alias("reference_equity"),
    )
    return j.select(
        k.alias("id"),
        F.concat(F.lit("src"), (cust % 6).cast("string")).alias("source_id"),
        _match("o_orderpriority", STAGE_OF_PRIORITY).alias("deployment_stage"),
        F.when(k % 7 == 0, "NOT_AVAILABLE").otherwise("AVAILABLE").alias("route_capability"),
        evidence.alias("evidence"),
        F.concat(F.lit("doi:10."), cust.cast("string"), F.when(k % 13 == 0, "").otherwise("#s"), k.cast("string")).alias("source_locator"),
        _cycle(list(ACTIONS), k).alias("naive_action"),
        "o_orderdate",
    )
