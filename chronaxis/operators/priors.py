"""Group references and trajectory priors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import distributed as D
from .folds import to_training

LO, HI = 1.0, 255.0


def clip(x: Column, lo: float = LO, hi: float = HI) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def population_curve(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Exact pointwise median of the group at every (keys, t)."""
    return D.quantiles(rows, [*keys, "t"], F.col(value), {"med": 0.5})


def median_and_mad(rows: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Median and 1.4826 * median(abs(x - median)) per key, all steps skew-safe."""
    med = D.quantiles(rows, keys, F.col(value), {"med": 0.5})
    back = rows.join(med.drop("n"), list(keys))
    mad = D.quantiles(back, keys, F.abs(F.col(value) - F.col("med")), {"mad": 0.5})
    return med.join(mad.drop("n"), list(keys)).withColumn("mad", 1.4826 * F.col("mad"))


def smooth(df: DataFrame, keys: Sequence[str], radius: int, columns: dict[str, str]) -> DataFrame:
    """Centred moving average; the window shrinks at both ends."""

    def add(d, w):
        for source, out in columns.items():
            d = d.withColumn(out, F.avg(source).over(w.rowsBetween(-radius, radius)))
        return d

    return D.framed(df, keys, "t", radius, radius, add)


def moving_median(df: DataFrame, keys: Sequence[str], radius: int, source: str, out: str) -> DataFrame:
    return D.framed(
        df, keys, "t", radius, radius,
        lambda d, w: d.withColumn(out, F.percentile(source, F.lit(0.5)).over(w.rowsBetween(-radius, radius))),
    )


def triangular(df: DataFrame, keys: Sequence[str], radius: int, source: str, out: str) -> DataFrame:
    """Weights radius+1-distance over the present neighbours."""

    def add(d, w):
        num, den = F.lit(0.0), F.lit(0.0)
        for k in range(-radius, radius + 1):
            x = F.col(source) if k == 0 else (F.lag(source, -k).over(w) if k < 0 else F.lead(source, k).over(w))
            x = F.lag(source, -k).over(w) if k < 0 else (F.lead(source, k).over(w) if k > 0 else F.col(source))
            weight = float(radius + 1 - abs(k))
            num = num + F.coalesce(x * weight, F.lit(0.0))
            den = den + F.when(x.isNotNull(), weight).otherwise(0.0)
        return d.withColumn(out, num / den)

    return D.framed(df, keys, "t", radius, radius, add)


def pooled_window_median(rows: DataFrame, keys: Sequence[str], radius: int, value: str = "value") -> DataFrame:
    """Median of all group rows whose second lies within the radius.

    Every row serves 2r+1 target seconds; targets beyond the curve end are
    dropped by the join to the observed seconds.
    """
    spread = rows.withColumn("_s", F.explode(F.sequence(F.col("t") - radius, F.col("t") + radius)))
    spread = spread.drop("t").withColumnRenamed("_s", "t")
    pooled = D.quantiles(spread, [*keys, "t"], F.col(value), {"med": 0.5})
    ends = rows.groupBy(*keys).agg(F.max("t").alias("_end"))
    return pooled.join(ends, list(keys)).filter((F.col("t") >= 0) & (F.col("t") <= F.col("_end"))).drop("_end")


def clamp_lookup(rows: DataFrame, curve: DataFrame, keys: Sequence[str], shift: int = 0) -> DataFrame:
    """Join rows to a curve at t+shift, clamped to the curve's first and last second."""
    ends = curve.groupBy(*keys).agg((F.max("t") + 1).alias("_len"))
    asked = rows.join(ends, list(keys)).withColumn(
        "_at", F.greatest(F.lit(0).cast("long"), F.least(F.col("t") + shift, F.col("_len") - 1))
    )
    return asked.join(curve.withColumnRenamed("t", "_at"), [*keys, "_at"]).drop("_at", "_len")


def held_out_reference(long: DataFrame, folds: DataFrame, n: int, radius: int) -> DataFrame:
    """Smoothed group median per (vfold, video, axis, t) without the fold's own subjects."""
    curve = D.medians_without(long.join(folds, "subject"), ["video", "axis", "t"], F.col("value"), "fold", n, {str(f): [f] for f in range(n)})
    curve = curve.withColumn("vfold", F.col("set").cast("long")).drop("set")
    return smooth(curve, ["vfold", "video", "axis"], radius, {"med": "prior"})


def population_oof(long: DataFrame, folds: DataFrame, n: int = 5, radius: int = 3, reference: DataFrame | None = None) -> DataFrame:
    """Every labelled second predicted once from the other folds' subjects."""
    ref = held_out_reference(long, folds, n, radius) if reference is None else reference
    ref = ref.select("vfold", "video", "axis", "t", "prior")
    rows = long.join(folds, "subject").withColumnRenamed("fold", "vfold")
    return clamp_lookup(rows, ref, ["vfold", "video", "axis"]).withColumnRenamed("vfold", "fold")


def resample_phase(curve: DataFrame, keys: Sequence[str], targets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation of curves onto a grid of another length on [0, 1].

    ``targets`` holds (keys.., m): one row per wanted (curve, length).  Output
    rows are (keys.., m, i).  Positions are i*(n-1)/(m-1); the two neighbours
    arrive by one equi-join on an exploded pair (floor, ceil).
    """
    ends = curve.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    grid = targets.join(ends, list(keys)).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    return sample_at(curve, keys, grid.withColumn(
        "_pos",
        F.when(F.col("m") == 1, F.lit(0.0)).otherwise(
            F.col("i") * (F.col("_n") - 1) / F.greatest(F.col("m") - 1, F.lit(1))),
    ), columns).drop("_pos", "_n")


def sample_at(curve: DataFrame, keys: Sequence[str], asked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Linear interpolation at fractional positions ``_pos`` (ends in ``_n``)."""
    p = F.least(F.greatest(F.col("_pos"), F.lit(0.0)), (F.col("_n") - 1).cast("double"))
    lo = F.floor(p)
    placed = asked.withColumn("_lo", lo).withColumn("_w", p - lo)
    placed = placed.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    low = curve.select(*keys, F.col("t").alias("_lo"), *[F.col(c).alias(f"_l_{c}") for c in columns])
    high = curve.select(*keys, F.col("t").alias("_hi"), *[F.col(c).alias(f"_h_{c}") for c in columns])
    out = placed.join(low, [*keys, "_lo"]).join(high, [*keys, "_hi"])
    for c in columns:
        out = out.withColumn(c, (1 - F.col("_w")) * F.col(f"_l_{c}") + F.col("_w") * F.col(f"_h_{c}"))
    drop = ["_lo", "_hi", "_w"] + [f"_l_{c}" for c in columns] + [f"_h_{c}" for c in columns]
    return out.drop(*drop)
