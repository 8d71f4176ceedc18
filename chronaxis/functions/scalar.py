"""Scalar Column builders.  All stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def rating_to_label(r: Column) -> Column:
    """1..9 rating to the 1..255 label scale; outside the domain is an error."""
    ok = (r >= 1) & (r <= 9)
    return F.when(ok, 1 + (r - 1) * ((255.0 - 1.0) / (9.0 - 1.0))).otherwise(
        F.raise_error(F.lit("rating outside 1..9")).cast("double"))


def clip(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def gated_stack(prior: Column, parts: list[tuple[float, Column]], cap: float) -> Column:
    """prior + clip(sum(gate*residual), +-cap) on the label range; all gates 0 gives the prior."""
    active = [g * c for g, c in parts if g != 0.0]
    if not active:
        return clip(prior, 1.0, 255.0)
    total = active[0]
    for a in active[1:]:
        total = total + a
    return clip(prior + clip(total, -cap, cap), 1.0, 255.0)


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def spearman_brown(r: Column) -> Column:
    return F.when(F.abs(1 + r) >= 1e-12, 2 * r / (1 + r))


def wilson(count: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper Wilson score limits."""
    n = total.cast("double")
    p = count / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def correlation(x: str, y: str, least: int = 3) -> Column:
    """Pearson correlation; 0 below ``least`` rows or with a flat column."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    flat = (F.count(F.lit(1)) < least) | (sx < 1e-12) | (sy < 1e-12)
    return F.when(flat, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y), sx * sy), F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """L2 norm, floored at 1e-8."""
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-8))


def unit(v: Column) -> Column:
    """L2-normalized vector; the norm is floored at 1e-8."""
    length = norm(v)
    return F.transform(v, lambda x: x / length)


def iso_date(s: Column) -> Column:
    return s.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(s, F.lit("yyyy-MM-dd")).isNotNull()


# Letters with marks and their base letters, one for one.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalized_text(s: Column) -> Column:
    """Lower case, marks dropped, only a-z and 0-9 kept."""
    low = F.replace(F.lower(s), F.lit("ß"), F.lit("ss"))
    return F.regexp_replace(F.translate(low, MARKED, PLAIN), "[^a-z0-9]", "")


def gate_status(low: Column, high: Column, threshold: float) -> Column:
    return F.when(low > threshold, "PASS").when(high < threshold, "FAILED").otherwise("PARTIAL")


def register_sql(spark: SparkSession) -> None:
    """SQL names for the scalar family; Catalyst inlines these bodies."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION rating_to_label(r DOUBLE) RETURNS DOUBLE RETURN 1 + (r - 1) * 31.75")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION clip_label(x DOUBLE) RETURNS DOUBLE RETURN least(greatest(x, 1), 255)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION half_up(x DOUBLE) RETURNS BIGINT RETURN floor(x + 0.5)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION spearman_brown(r DOUBLE) RETURNS DOUBLE RETURN try_divide(2 * r, 1 + r)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION wilson_low(c DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN "
        "greatest(0, ((c / n + 1.9207294103470706 / n) - 1.959963984540054 * sqrt(c / n * (1 - c / n) / n + "
        "0.9603647051735353 / (n * n))) / (1 + 3.8414588206941236 / n))")
