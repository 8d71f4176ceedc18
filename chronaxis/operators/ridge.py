"""Linear models from distributed sufficient statistics.

Rows never leave their partitions: each partition folds its Arrow batches into
one d x d matrix per key, the small matrices are summed by Spark, and each key's
system is solved by a grouped task of d*d rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys.., m_c, s_c): mean and population std per column, std floored at 1e-6."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    g = (df.groupBy(*keys) if keys else df.groupBy()).agg(
        *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m_{c}") for c in columns],
        *[(F.stddev_pop(c) if not weight else F.sqrt(F.greatest(F.lit(0.0), F.sum(w * F.col(c) ** 2) / F.sum(w) - (F.sum(w * F.col(c)) / F.sum(w)) ** 2))).alias(f"p_{c}")
          for c in columns])
    return g.select(*keys, *[F.col(f"m_{c}") for c in columns], *[F.greatest(F.col(f"p_{c}"), F.lit(1e-6)).alias(f"s_{c}") for c in columns])


def with_keys(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach a one-row-per-key table; without keys it is a single row read as scalars."""
    if keys:
        return df.join(small, list(keys))
    row = small.select(F.struct("*").alias("_row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")


def standardized(df: DataFrame, stats: DataFrame, keys: Sequence[str], columns: Sequence[str], clip: float | None = 8.0) -> DataFrame:
    """Adds ``z``: the ARRAY of standardized (and clipped) features."""
    j = with_keys(df, stats, keys)
    z = []
    for c in columns:
        e = (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")
        z.append(F.least(F.greatest(e, F.lit(-clip)), F.lit(clip)) if clip is not None else e)
    return j.withColumn("z", F.array(*z)).drop(*[f"m_{c}" for c in columns], *[f"s_{c}" for c in columns])


def gram(df: DataFrame, key: str, vector: str, target: Column | None = None, weight: Column | None = None) -> DataFrame:
    """(key, i, j, v): sums of w*x_i*x_j per key; a target becomes the last index."""
    x = F.col(vector) if target is None else F.concat(F.col(vector), F.array(target.cast("double")))
    rows = df.select(F.col(key).cast("long").alias("k"), x.alias("x"),
                     (weight.cast("double") if weight is not None else F.lit(1.0)).alias("w"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby("k"):
                x = np.stack(part["x"].to_numpy())
                g = (x * part["w"].to_numpy()[:, None]).T @ x
                held[k] = held[k] + g if k in held else g
        for k, g in held.items():
            d = len(g)
            i, j = np.divmod(np.arange(d * d), d)
            yield pd.DataFrame({"k": k, "i": i, "j": j, "v": g.ravel()})

    return rows.mapInPandas(fold, "k long, i int, j int, v double").groupBy(F.col("k").alias(key), "i", "j").agg(F.sum("v").alias("v"))


def ridge_path(g: DataFrame, key: str, alphas: Sequence[float], free: int = 0) -> DataFrame:
    """(key, alpha, i, beta) for every penalty from one decomposition per key.

    The first ``free`` coefficients are not penalized (intercepts).
    """
    alphas = [float(a) for a in alphas]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        full = np.zeros((d, d))
        full[pdf["i"], pdf["j"]] = pdf["v"]
        x, y = full[:-1, :-1], full[:-1, -1]
        out = []
        if free == 0:
            values, vectors = np.linalg.eigh(x)
            values = np.maximum(values, 0.0)
            turned = vectors.T @ y
        for a in alphas:
            if free == 0:
                beta = vectors @ (turned / np.maximum(values + a, 1e-12))
            else:
                pen = np.full(d - 1, a)
                pen[:free] = 0.0
                beta = np.linalg.lstsq(x + np.diag(pen), y, rcond=None)[0]
            out.append(pd.DataFrame({key: pdf[key].iloc[0], "alpha": a, "i": np.arange(d - 1), "beta": beta}))
        return pd.concat(out)

    return g.groupBy(key).applyInPandas(solve, f"{key} long, alpha double, i int, beta double")


def coefficients(path: DataFrame, key: str) -> DataFrame:
    """(key, alpha, beta): the coefficient vector as an ARRAY, at most d entries."""
    s = path.groupBy(key, "alpha").agg(F.sort_array(F.collect_list(F.struct("i", "beta"))).alias("_b"))
    return s.select(key, "alpha", F.col("_b.beta").alias("beta"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def inflation(g: DataFrame, key: str) -> DataFrame:
    """Variance inflation factors from the Gram of standardized features."""

    def factors(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        full = np.zeros((d, d))
        full[pdf["i"], pdf["j"]] = pdf["v"]
        x = full[:-1, :-1]
        scale = np.sqrt(np.maximum(np.diag(x), 1e-300))
        inv = np.linalg.pinv(x / np.outer(scale, scale))
        return pd.DataFrame({key: pdf[key].iloc[0], "i": np.arange(d - 1), "vif": np.diag(inv)})

    return g.groupBy(key).applyInPandas(factors, f"{key} long, i int, vif double")
