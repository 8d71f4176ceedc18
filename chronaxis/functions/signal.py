"""Per-window signal features on ARRAY samples: narrow expressions, no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
# Name, low and high edge of the six bands in Hz.
BANDS = [("delta", 1.0, 4.0), ("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta1", 13.0, 20.0), ("beta2", 20.0, 30.0), ("gamma", 30.0, 45.0)]


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it by name in ``body``."""
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def variance(a: Column) -> Column:
    return let(a, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: (x - m) * (x - m)))))


def diff(a: Column) -> Column:
    return let(a, lambda v: F.zip_with(F.slice(v, F.lit(2), F.size(v) - 1), F.slice(v, F.lit(1), F.size(v) - 1), lambda hi, lo: hi - lo))


def moment(a: Column, k: int) -> Column:
    return let(a, lambda v: let(mean(v), lambda m: mean(F.transform(v, lambda x: F.pow(x - m, F.lit(k))))))


def slope(a: Column) -> Column:
    """Least-squares slope per sample."""
    def over(v):
        mid = (F.size(v) - 1) / 2.0
        top = total(F.transform(v, lambda x, i: x * (i - mid)))
        return top / F.greatest(total(F.transform(v, lambda x, i: (i - mid) * (i - mid))), F.lit(EPS))
    return let(a, over)


def hjorth(a: Column) -> tuple[Column, Column, Column]:
    """Activity, mobility and complexity; the three variances are bound once."""
    s = let(diff(a), lambda d: F.struct(variance(a).alias("v0"), variance(d).alias("v1"), variance(diff(d)).alias("v2")))
    eps = F.lit(EPS)
    done = let(s, lambda v: let(F.sqrt(v["v1"] / F.greatest(v["v0"], eps)), lambda m: F.struct(
        v["v0"].alias("a"), m.alias("m"), (F.sqrt(v["v2"] / F.greatest(v["v1"], eps)) / F.greatest(m, eps)).alias("c"))))
    return done["a"], done["m"], done["c"]


def spectrum(a: Column, n: int, k: int, hann: bool) -> Column:
    """Power of frequency bin k of n centred samples."""
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / (n - 1)) if hann else 1.0 for i in range(n)]
    cos = F.array(*[F.lit(w[i] * math.cos(2 * math.pi * k * i / n)) for i in range(n)])
    sin = F.array(*[F.lit(w[i] * math.sin(2 * math.pi * k * i / n)) for i in range(n)])
    def power(v):
        return let(mean(v), lambda m: let(total(F.zip_with(v, cos, lambda x, c: (x - m) * c)), lambda re: let(
            total(F.zip_with(v, sin, lambda x, c: (x - m) * c)), lambda im: re * re + im * im)))
    return let(a, power)


def band_features(a: Column, n: int, rate: float) -> list[tuple[str, Column, Column]]:
    """(band, log power share, differential entropy) for the six bands.

    Band variance follows from the bin powers: 2|X|^2/n^2, once at the Nyquist bin.
    """
    bins = [k for k in range(n // 2 + 1)]
    freq = {k: k * rate / n for k in bins}
    inside = [k for k in bins if BANDS[0][1] <= freq[k] < BANDS[-1][2]]
    all_power = F.lit(EPS)
    for k in inside:
        all_power = all_power + spectrum(a, n, k, True)
    out = []
    for name, low, high in BANDS:
        mine = [k for k in bins if low <= freq[k] < high]
        if not mine:
            power, var = F.lit(0.0), F.lit(EPS)
        else:
            power, var = F.lit(0.0), F.lit(0.0)
            for k in mine:
                power = power + spectrum(a, n, k, True)
                var = var + spectrum(a, n, k, False) * ((1.0 if 2 * k == n else 2.0) / (n * n))
        share = F.log(F.greatest(power / all_power, F.lit(EPS)))
        entropy = 0.5 * F.log(2 * math.pi * math.e * F.greatest(var, F.lit(EPS)))
        out.append((name, share, entropy))
    return out
