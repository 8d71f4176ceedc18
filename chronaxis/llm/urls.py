"""URL filters: host-suffix and path-prefix expressions against a rule table.

Every URL is expanded into the expressions (host suffix, directory prefix) that
a rule could carry.  Expressions and rules meet in an equi-join on a short hash
prefix; the full digest and the rule's whole path then confirm a match, and the
longest rule decides.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, directory: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, directory), 256)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def url_verdicts(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                 default: str = "allow", prefix_digits: int = 8) -> DataFrame:
    """One row per input row: key, host, path, rule, verdict.

    ``rules`` has host, path and verdict (``allow`` or ``block``).  A rule fits
    its host and all subdomains when the URL's path starts with the rule's path.
    The longest rule (characters of host and path) wins; ``block`` wins a tie,
    then the smaller rule text.  Null URLs and URLs without ``://`` have empty
    host and path, so only a rule with an empty host can fit them.  Repeated
    rows and null keys are kept as rows of their own; other columns of the
    input are not carried.  Rules with a null field are ignored.
    """
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("verdict").alias("rule_verdict")).dropna()
    # No deeper expression than the deepest rule can match.  Two numbers.
    depth = clean.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(_slashes(F.col("rule_path")))).first()
    labels, levels = depth[0] or 1, depth[1] or 0
    clean = clean.withColumn("_full", _digest(F.col("rule_host"), F.regexp_extract("rule_path", r"(?s)^(.*/)", 1)))
    clean = clean.withColumn("_short", F.substring("_full", 1, prefix_digits))

    rows = pages.select(F.col(key).alias("_key"), url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    parts = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
                           lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
    directories = F.transform(
        F.sequence(F.lit(0), F.least(_slashes(F.col("_path")), F.lit(levels))),
        lambda j: F.when(j == 0, F.lit("")).otherwise(F.concat(F.call_function("substring_index", F.col("_path"), F.lit("/"), j), F.lit("/"))))
    expressions = (
        rows.withColumn("_suffix", F.explode(suffixes))
        .withColumn("_directory", F.explode(directories))
        .withColumn("_digest", _digest(F.col("_suffix"), F.col("_directory")))
        .select("_row", "_key", "_host", "_path", "_digest", F.substring("_digest", 1, prefix_digits).alias("_short"))
    )
    joined = expressions.join(clean, "_short", "left")
    fits = (F.col("_digest") == F.col("_full")) & F.col("_path").startswith(F.col("rule_path"))
    name = F.concat("rule_host", "rule_path")
    # Precedence as one sortable value: length, block before allow, smaller text.
    rank = F.when(fits, F.struct(F.length(name).alias("n"), (F.col("rule_verdict") == "block").alias("b"),
                                 name.alias("rule"), F.col("rule_verdict").alias("verdict")))
    best = joined.groupBy("_row", "_key", "_host", "_path").agg(
        F.max(F.struct(rank["n"].alias("n"), rank["b"].alias("b"))).alias("_top"),
        F.collect_set(rank).alias("_all"))
    # At most one rule per expression fits, so the set is bounded by the depth of the rules.
    chosen = F.array_min(F.transform(
        F.filter("_all", lambda r: (r["n"] == F.col("_top.n")) & (r["b"] == F.col("_top.b"))),
        lambda r: F.struct(r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return best.select(F.col("_key").alias(key), F.col("_host").alias("host"), F.col("_path").alias("path"),
                       chosen["rule"].alias("rule"), F.coalesce(chosen["verdict"], F.lit(default)).alias("verdict"))
