"""Banded alignment of trials to references.

Everything around the dynamic programme is Column code: smoothing, gradient and
robust scaling before, lags and metrics after.  The programme itself runs in
vectorized Pandas UDFs that step over the band once for a whole Arrow batch of
trials of equal length, never trial by trial.

A trial longer than ``LONG`` seconds is never gathered.  Its chunks are solved
as small transfer matrices (cost from every entry offset to every exit offset),
the matrices are combined, and each chunk is then decoded from its own entry
costs and exit offset.  The band keeps such a summary at (2*band+1)^2 numbers.
Objectives with a ratio repeat this with another price per node or move until
the ratio is proven best.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import parked
from . import distributed as D
from . import priors as P
from . import windows as Wn

LONG = 65536
MIXED = 1024  # up to here the mixed objective keeps a cost per path length
RESULT = "struct<w:array<int>,local_cost:double,warp_cost:double,steps:int,path_length:int>"


@dataclass(frozen=True)
class WarpSettings:
    band: int = 10
    warp_penalty: float = 0.15
    step_penalty: float = 0.05
    radius: int = 2
    derivative: bool = True
    objective: str = "direct_step"


def forward(p, m, s: WarpSettings, step: float, offset, i0: int = 0, j0: int = 0, n: int | None = None, entry=None):
    """Fill the band for rows i0.. of a block [trial, rows, axes].

    ``m`` starts at reference second j0; ``entry`` holds the costs of the row
    before i0 by offset.  Ties prefer diagonal, then down, then right.  Returns
    the costs of the last row and the back pointers.
    """
    count, rows = p.shape[0], p.shape[1]
    n = p.shape[1] if n is None else n
    band, reach = max(s.band, 1), s.band
    width = 2 * reach + 1
    inf = np.full(count, np.inf)
    before = [inf] * width if entry is None else entry
    back = np.zeros((rows, width, count), dtype=np.int8)
    for r in range(rows):
        i = i0 + r
        now = [inf] * width
        for o in range(width):
            j = i + o - reach
            if j < 0 or j >= n:
                continue
            local = np.abs(p[:, r] - m[:, j - j0]).mean(axis=1) + s.warp_penalty * abs(i - j) / band - offset
            if i == 0 and j == 0:
                now[o] = local
                continue
            diagonal = before[o] if i > 0 else inf
            down = before[o + 1] + step if i > 0 and o + 1 < width else inf
            right = now[o - 1] + step if o > 0 else inf
            best, way = diagonal, np.zeros(count, dtype=np.int8)
            better = down < best
            best, way = np.where(better, down, best), np.where(better, 1, way)
            better = right < best
            best, way = np.where(better, right, best), np.where(better, 2, way)
            now[o] = local + best
            back[r, o] = way
        before = now
    return before, back


def backward(p, m, s: WarpSettings, back, exits, i0: int = 0, j0: int = 0):
    """Walk all trials of a block back from their exit offsets.

    Returns first and last matched second per row, the cost audit and the entry
    offset (offset in the row before i0; -1 where the path starts here).
    """
    count, rows = p.shape[0], p.shape[1]
    band, reach = max(s.band, 1), s.band
    i = np.full(count, rows - 1)
    j = np.asarray(exits) + i + i0 - reach
    low = np.full((count, rows), np.iinfo(np.int64).max, dtype=np.int64)
    high = np.full((count, rows), -1, dtype=np.int64)
    local_cost, warp_cost = np.zeros(count), np.zeros(count)
    steps, length = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    entry = np.full(count, -1, dtype=np.int64)
    alive = np.ones(count, dtype=bool)
    while alive.any():
        a = np.flatnonzero(alive)
        ia, ja = i[a], j[a]
        low[a, ia] = np.minimum(low[a, ia], ja)
        high[a, ia] = np.maximum(high[a, ia], ja)
        local_cost[a] += np.abs(p[a, ia] - m[a, ja - j0]).mean(axis=1)
        warp_cost[a] += s.warp_penalty * np.abs(ia + i0 - ja) / band
        length[a] += 1
        done = (ia + i0 == 0) & (ja == 0)
        alive[a[done]] = False
        go = a[~done]
        way = back[i[go], j[go] - i[go] - i0 + reach, go]
        steps[go] += way != 0
        j[go] -= way != 1
        i[go] -= way != 2
        left = go[i[go] < 0]
        entry[left] = j[left] - (i0 - 1) + reach
        alive[left] = False
    return low, high, local_cost, warp_cost, steps, length, entry


def _solve(p: np.ndarray, m: np.ndarray, s: WarpSettings, step: float, offset: np.ndarray):
    """Align a block of whole trials [trial, n, axes]."""
    n = p.shape[1]
    _last, back = forward(p, m, s, step, offset)
    low, high, local_cost, warp_cost, steps, length, _e = backward(p, m, s, back, np.full(p.shape[0], s.band))
    mapping = np.floor((low + high) / 2.0 + 0.5).astype(np.int64)
    mapping = np.maximum.accumulate(np.clip(mapping, 0, n - 1), axis=1)
    return mapping, local_cost, warp_cost, steps, length


def _solve_mixed(p: np.ndarray, m: np.ndarray, s: WarpSettings):
    """Minimize local and warp cost plus step_penalty * K / L over whole trials.

    K (sideways moves) and L (path nodes) follow from the number of diagonal
    moves d, so the best cost is kept per cell and d, and the ratio is only
    applied at the end.  Equal totals take the shorter path.
    """
    count, n, _axes = p.shape
    band, reach = max(s.band, 1), s.band
    width = 2 * reach + 1
    inf = np.full((count, n), np.inf)
    before = [inf] * width
    back = np.zeros((n, width, count, n), dtype=np.int8)
    for i in range(n):
        now = [inf] * width
        for o in range(width):
            j = i + o - reach
            if j < 0 or j >= n:
                continue
            local = np.abs(p[:, i] - m[:, j]).mean(axis=1) + s.warp_penalty * abs(i - j) / band
            if i == 0 and j == 0:
                best = inf.copy()
                best[:, 0] = local
                now[o] = best
                continue
            best = inf.copy()
            if i > 0:
                best[:, 1:] = before[o][:, :-1]
            way = np.zeros((count, n), dtype=np.int8)
            for code, side in ((1, before[o + 1] if i > 0 and o + 1 < width else inf), (2, now[o - 1] if o > 0 else inf)):
                better = side < best
                best, way = np.where(better, side, best), np.where(better, code, way)
            now[o] = best + local[:, None]
            back[i, o] = way
        before = now
    d = np.arange(n)
    nodes, sideways = 2 * n - 1 - d, 2 * (n - 1 - d)
    total = before[reach] + s.step_penalty * sideways / nodes
    pick = n - 1 - np.argmin(total[:, ::-1], axis=1)
    low, high = np.full((count, n), n, dtype=np.int64), np.full((count, n), -1, dtype=np.int64)
    local_cost, warp_cost = np.zeros(count), np.zeros(count)
    for k in range(count):
        i, j, left = n - 1, n - 1, pick[k]
        while True:
            low[k, i], high[k, i] = min(low[k, i], j), max(high[k, i], j)
            local_cost[k] += np.abs(p[k, i] - m[k, j]).mean()
            warp_cost[k] += s.warp_penalty * abs(i - j) / band
            if i == 0 and j == 0:
                break
            way = back[i, j - i + reach, k, left]
            i, j, left = i - (way != 2), j - (way != 1), left - (way == 0)
    mapping = np.maximum.accumulate(np.clip(np.floor((low + high) / 2.0 + 0.5).astype(np.int64), 0, n - 1), axis=1)
    return mapping, local_cost, warp_cost, sideways[pick], nodes[pick]


def align_block(p: np.ndarray, m: np.ndarray, s: WarpSettings):
    count, n, _axes = p.shape
    if n < 2:
        zero = np.zeros(count)
        return np.zeros((count, n), dtype=np.int64), zero, zero, zero.astype(np.int64), np.ones(count, dtype=np.int64)
    if s.objective == "mixed_step_mean":
        # the table grows with n^2 * band per trial: take as many trials at a time as fit in 64 MB
        take = max(1, (1 << 26) // (n * n * (2 * s.band + 1)))
        cuts = [_solve_mixed(p[a:a + take], m[a:a + take], s) for a in range(0, count, take)]
        return tuple(np.concatenate(c) for c in zip(*cuts))
    step = step_of(s)
    out = _solve(p, m, s, step, np.zeros(count))
    if s.objective != "path_mean":
        return out
    # minimize cost per path node: shift every node by the current ratio and repeat
    ratio = (out[1] + out[2] + step * out[3]) / np.maximum(out[4], 1)
    active = np.arange(count)
    result = [x.copy() for x in out]
    for _ in range(30):
        if not len(active):
            break
        got = _solve(p[active], m[active], s, step, ratio[active])
        for slot, part in zip(result, got):
            slot[active] = part
        new = (got[1] + got[2] + step * got[3]) / np.maximum(got[4], 1)
        moving = np.abs(new - ratio[active]) >= 1e-10
        ratio[active[moving]] = new[moving]
        active = active[moving]
    return tuple(result)


def step_of(s: WarpSettings) -> float:
    return 0.0 if s.objective == "step_zero" else s.step_penalty


def _equal(n: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of a batch's trials, by their number of seconds."""
    for size in np.unique(n):
        yield np.flatnonzero(n == size), int(size)


def mapping_udf(settings: WarpSettings):
    """(participant, reference, seconds): values second by second, axes side by side -> mapping and cost audit."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for p, m, n in batches:
            w: list = [None] * len(p)
            cols = np.zeros((len(p), 4))
            for at, size in _equal(n.to_numpy()):
                block = [np.stack(x.iloc[at]).astype(np.float64).reshape(len(at), size, -1) for x in (p, m)]
                got = align_block(*block, settings)
                for slot, k in enumerate(at):
                    w[k] = got[0][slot].astype(np.int32)
                cols[at] = np.stack(got[1:], axis=1)
            yield pd.DataFrame({"w": w, "local_cost": cols[:, 0], "warp_cost": cols[:, 1],
                                "steps": cols[:, 2].astype(np.int32), "path_length": cols[:, 3].astype(np.int32)})

    return F.pandas_udf(run, RESULT)


def signal(x: np.ndarray, s: WarpSettings) -> np.ndarray:
    """Smoothed, differentiated, robustly scaled trials [trial, second], as the Columns of :func:`signals` do it."""
    n = x.shape[1]
    if s.radius > 0:
        wide = np.pad(x, ((0, 0), (s.radius, s.radius)))
        i = np.arange(n)
        x = sum((wide[:, o:o + n] for o in range(2 * s.radius + 1)), np.zeros_like(x)) / (np.minimum(i + s.radius, n - 1) - np.maximum(i - s.radius, 0) + 1)
    if s.derivative:
        x = np.concatenate([x[:, 1:2] - x[:, :1], (x[:, 2:] - x[:, :-2]) / 2, x[:, -1:] - x[:, -2:-1]], axis=1) if n > 1 else np.zeros_like(x)

    def middle(v):
        v = np.sort(v, axis=1)
        low, high = v[:, (n - 1) // 2], v[:, n // 2]
        return (low if n % 2 else low * 0.5 + high * 0.5)[:, None]

    med = middle(x)
    mad, sd = 1.4826 * middle(np.abs(x - med)), x.std(axis=1, keepdims=True)
    scale = np.where(mad >= 1e-6, mad, np.where(sd >= 1e-6, sd, np.inf))
    return (x - med) / scale


def signal_udf(s: WarpSettings):
    """Arrays of target and reference values -> arrays of both signals."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for target, reference in batches:
            out = {"p": [None] * len(target), "m": [None] * len(target)}
            for at, _size in _equal(target.map(len).to_numpy()):
                for name, x in (("p", target), ("m", reference)):
                    for k, z in zip(at, signal(np.stack(x.iloc[at]).astype(np.float64), s)):
                        out[name][k] = z
            yield pd.DataFrame(out)

    return F.pandas_udf(run, "struct<p:array<double>,m:array<double>>")


def trial_blocks(rows: DataFrame, keys: Sequence[str], target: str = "value", reference: str = "prior", halo: int = 0) -> DataFrame:
    """(keys.., start, lead, whole, value, prior): blocks of LONG seconds, which most trials fit in whole.

    The reference has ``halo`` more seconds on both sides, ``lead`` of them
    before the block.  Blocks tell from their own length whether the trial is whole.
    """
    got = D.blocks(rows.select(*keys, "t", F.col(target).cast("double").alias("value"), F.col(reference).cast("double").alias("prior")), keys, "t", ["value", "prior"], halo, LONG)
    lead = F.least(F.lit(halo).cast("long"), F.col("c") * LONG).cast("int")
    got = got.withColumn("lead", lead).withColumn("whole", (F.col("c") == 0) & (F.size("prior") < LONG))
    return got.select(*keys, (F.col("c") * LONG).alias("start"), "lead", "whole", F.slice("value", F.col("lead") + 1, LONG).alias("value"), "prior").filter(F.size("value") > 0)


def signal_blocks(blocks: DataFrame, keys: Sequence[str], s: WarpSettings) -> DataFrame:
    """(keys.., start, whole, n, p, m): signals of blocks; n seconds per block.

    A whole trial of plain numbers is one row and needs no exchange; the others are scaled
    row by row, so that no task holds a long trial.
    """
    odd = lambda c: F.exists(c, lambda x: x.isNull() | ~(F.abs(x) < 1e300))
    blocks = blocks.withColumn("_easy", F.col("whole") & ~odd("value") & ~odd("prior"))
    easy = blocks.filter("_easy").withColumn("_r", signal_udf(s)("value", "prior")).select(*keys, "start", "whole", F.size("value").alias("n"), "_r.*")
    rest = blocks.filter("NOT _easy").select(*keys, "start", "lead", F.posexplode("value").alias("_i", "value"), "prior")
    rest = rest.select(*keys, (F.col("start") + F.col("_i")).alias("t"), "value", F.col("prior")[F.col("_i") + F.col("lead")].alias("prior"))
    return easy.unionByName(_packed(signals(rest, keys, s), keys))


def _packed(sig: DataFrame, keys: Sequence[str], size: int | None = None) -> DataFrame:
    """Rows of signals as blocks."""
    size = LONG if size is None else size
    got = D.blocks(sig, keys, "t", ["p", "m"], 0, size).withColumn("n", F.size("p"))
    return got.select(*keys, (F.col("c") * size).alias("start"), ((F.col("c") == 0) & (F.col("n") < size)).alias("whole"), "n", F.flatten("p").alias("p"), F.flatten("m").alias("m"))


def signal_seconds(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., t, p, m): blocks of signals second by second, axes as ARRAYs."""
    axes = (F.size("p") / F.col("n")).cast("int")
    rows = packed.select(*keys, "start", "p", "m", axes.alias("_a"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("_i"))
    part = lambda c: F.slice(c, F.col("_i") * F.col("_a") + 1, F.col("_a")).alias(c)
    return rows.select(*keys, (F.col("start") + F.col("_i")).alias("t"), part("p"), part("m"))


def signals(rows: DataFrame, keys: Sequence[str], s: WarpSettings, target: str = "value", reference: str = "prior") -> DataFrame:
    """(keys.., t, p, m): smoothed, differentiated, robustly scaled; one-element ARRAYs."""
    both = rows.select(*keys, "t", F.explode(F.array(
        F.struct(F.lit("p").alias("role"), F.col(target).cast("double").alias("x")),
        F.struct(F.lit("m").alias("role"), F.col(reference).cast("double").alias("x")))).alias("_s")).select(*keys, "t", "_s.role", "_s.x")
    k = [*keys, "role"]
    x = P.smooth(both, k, s.radius, {"x": "x"}) if s.radius > 0 else both
    if s.derivative:
        x = Wn.add_gradient(x, k, {"x": "x"})
    z = Wn.robust_z(x, k, "x", "z")
    return z.groupBy(*keys, "t").agg(F.array(F.max(F.when(F.col("role") == "p", F.col("z")))).alias("p"),
                                     F.array(F.max(F.when(F.col("role") == "m", F.col("z")))).alias("m"))


def join_axes(packed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of signals of both axes side by side, for one mapping from both together."""
    at = lambda c, a: F.max(F.when(F.col("axis") == a, F.col(c)))
    both = packed.groupBy(*keys, "start", "n").agg(F.min("whole").alias("whole"), *[at(c, a).alias(f"{c}{a}") for c in "pm" for a in (0, 1)])
    side = lambda c: F.flatten(F.zip_with(f"{c}0", f"{c}1", lambda x, y: F.array(x, y))).alias(c)
    return both.select(*keys, "start", "whole", "n", side("p"), side("m"))


def solve(sig: DataFrame, keys: Sequence[str], s: WarpSettings, long: int | None = None) -> DataFrame:
    """(keys.., start, whole, w, costs) from signals second by second."""
    return solve_blocks(_packed(sig, keys, long), keys, s, long)


def solve_blocks(packed: DataFrame, keys: Sequence[str], s: WarpSettings, long: int | None = None) -> DataFrame:
    """(keys.., start, whole, w, costs): mappings of whole short trials and of the chunks of long ones."""
    long = LONG if long is None else long
    if s.objective == "mixed_step_mean":
        long = min(long, MIXED)
    packed = packed.withColumn("_short", F.col("whole") & (F.col("n") <= long))
    got = packed.filter("_short").withColumn("_r", mapping_udf(s)("p", "m", "n")).select(*keys, "start", "whole", "_r.*")
    sig = signal_seconds(packed.filter("NOT _short"), keys)
    size = sig.groupBy(*keys).agg((F.max("t") + 1).alias("n"))
    parts = _chunks(D.attach(sig, size, keys, size=long), keys, s, long)
    search = {"path_mean": _path_mean, "mixed_step_mean": _mixed_step}.get(s.objective)
    if search is None:
        fixed = parts.withColumn("step", F.lit(step_of(s))).withColumn("offset", F.lit(0.0))
        return got.unionByName(_solve_chunks(fixed, keys, s, long))
    parts = parked(parts, "chunks")
    return got.unionByName(_solve_chunks(_with(parts, search(parts, keys, s, long), keys), keys, s, long))


def _with(parts: DataFrame, settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks with the step and offset of their trial (and further columns of the settings)."""
    return D._matched(parts, settings, keys)


def _priced(parts: DataFrame, settings: DataFrame, keys: Sequence[str], s: WarpSettings, size: int) -> DataFrame:
    """Settings with the cost, sideways moves and nodes of the path they lead to."""
    asked = settings.select(*keys, "step", "offset")
    whole = costs(_solve_chunks(_with(parts, asked, [k for k in keys if k in parts.columns]), keys, s, size), keys)
    return D._matched(settings, whole.select(*keys, (F.col("local_cost") + F.col("warp_cost")).alias("cost"), "steps", "path_length"), keys)


def _path_mean(parts: DataFrame, keys: Sequence[str], s: WarpSettings, size: int) -> DataFrame:
    """The offset per node at which a trial's cheapest path costs nothing: its least cost per node.

    Every round solves all trials that still move with their last ratio; the
    offset kept is the one whose path is returned.
    """
    step = step_of(s)
    now = parked(parts.select(*keys).distinct().select(*keys, F.lit(step).alias("step"), F.lit(0.0).alias("offset")), "ratios")
    ended = now.filter(F.lit(False))
    for turn in range(31):
        priced = _priced(parts, now, keys, s, size)
        ratio = (F.col("cost") + step * F.col("steps")) / F.greatest(F.col("path_length"), F.lit(1))
        moved = parked(priced.select(*keys, "step", "offset", ratio.alias("_new")), "ratios")
        moves = F.lit(True) if turn == 0 else F.abs(F.col("_new") - F.col("offset")) >= 1e-10
        ended = ended.unionByName(moved.filter(~moves).drop("_new"))
        now = moved.filter(moves).select(*keys, "step", F.col("_new").alias("offset"))
        if moved.agg(F.count_if(moves)).first()[0] == 0:
            return ended
    return ended.unionByName(now)


def _mixed_step(parts: DataFrame, keys: Sequence[str], s: WarpSettings, size: int) -> DataFrame:
    """The price per sideways move whose cheapest path also minimizes step_penalty * K / L.

    With d diagonal moves a trial of n seconds has K = 2(n-1-d) and
    L = 2n-1-d, so K / L is a concave falling function of d.  The best path is
    therefore a corner of the lower hull of (d, cost), and its price lies
    between the slopes of that function at its ends.  Corners are listed from
    both end prices inwards: a price between two neighbours either finds a
    corner below their line or proves that there is none.
    """
    n = F.col("n").cast("double")
    ends = parts.groupBy(*keys).agg(F.max("n").alias("n"))
    slopes = [s.step_penalty * 2 * n / ((2 * n - 1) * (2 * n - 1)), s.step_penalty * 2 / n]
    ask = ends.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("q"), (x / 2).alias("step")) for i, x in enumerate(slopes)])).alias("_a"))
    key = [*keys, "q"]

    def corners(asked: DataFrame) -> DataFrame:
        priced = _priced(parts, asked.withColumn("offset", F.lit(0.0)), key, s, size)
        return parked(priced.withColumn("d", 2 * F.col("n") - 1 - F.col("path_length")), "corners")

    def named(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in ("d", "cost")])

    found = corners(parked(ask.select(*keys, "n", "_a.*"), "prices"))
    every = found.select(*keys, "n", "step", "d", "cost")
    gaps = parked(D._matched(named(found.filter("q = 0"), "lo"), found.filter("q = 1").select(*keys, "n", F.col("d").alias("hi_d"), F.col("cost").alias("hi_cost")), keys).filter("lo_d < hi_d"), "gaps")
    while gaps.agg(F.count(F.lit(1))).first()[0]:
        price = (F.col("hi_cost") - F.col("lo_cost")) / (F.col("hi_d") - F.col("lo_d"))
        asked = parked(gaps.select("*", F.xxhash64("lo_d", "hi_d").alias("q"), (price / 2).alias("step")), "prices")
        got = corners(asked)
        below = (F.col("cost") - 2 * F.col("step") * F.col("d")) < (F.col("lo_cost") - 2 * F.col("step") * F.col("lo_d")) - 1e-9
        fresh = got.filter(below & (F.col("d") > F.col("lo_d")) & (F.col("d") < F.col("hi_d")))
        every = every.unionByName(fresh.select(*keys, "n", "step", "d", "cost"))
        halves = F.array(F.struct("lo_d", "lo_cost", F.col("d").alias("hi_d"), F.col("cost").alias("hi_cost")),
                         F.struct(F.col("d").alias("lo_d"), F.col("cost").alias("lo_cost"), "hi_d", "hi_cost"))
        gaps = parked(fresh.select(*keys, "n", F.explode(halves).alias("_h")).select(*keys, "n", "_h.*"), "gaps")
    total = F.col("cost") + s.step_penalty * 2 * (F.col("n") - 1 - F.col("d")) / (2 * F.col("n") - 1 - F.col("d"))
    best = every.groupBy(*keys).agg(F.min(F.struct(total.alias("x"), (-F.col("d")).alias("d"), "step")).alias("_b"))
    return parked(best.select(*keys, F.col("_b.step").alias("step"), F.lit(0.0).alias("offset")), "prices")


def _chunks(sig: DataFrame, keys: Sequence[str], s: WarpSettings, size: int) -> DataFrame:
    """One row per chunk of a trial: its own seconds, and the reference with the band on both sides."""
    at = F.col("t")
    first = F.greatest(F.lit(0).cast("long"), F.floor((at - s.band) / size))
    last = F.least(F.floor((F.col("n") - 1) / size), F.floor((at + s.band) / size))
    copies = sig.withColumn("c", F.explode(F.sequence(first, last)))
    own = F.floor(at / size) == F.col("c")
    return copies.groupBy(*keys, "c").agg(
        F.sort_array(F.collect_list(F.when(own, F.struct("t", "p")))).alias("_p"), F.sort_array(F.collect_list(F.struct("t", "m"))).alias("_m"),
        F.max("n").alias("n"), F.min("t").alias("j0")).select(*keys, "c", "n", "j0", F.col("_p.p").alias("p"), F.col("_m.m").alias("m"))


def _solve_chunks(parts: DataFrame, keys: Sequence[str], s: WarpSettings, size: int) -> DataFrame:
    """Mappings of all chunks; every trial has its own ``step`` (per sideways move) and ``offset`` (per node)."""
    width, reach = 2 * s.band + 1, s.band

    def block(p, m, k, copies_):
        a = np.broadcast_to(np.stack(p.iloc[k]).astype(np.float64), (copies_, len(p.iloc[k]), len(p.iloc[k][0])))
        b = np.broadcast_to(np.stack(m.iloc[k]).astype(np.float64), (copies_, len(m.iloc[k]), len(m.iloc[k][0])))
        return a, b

    def starts(c, entry, copies_):
        if c == 0:
            return None
        return [np.full(copies_, x) for x in entry]

    def transfer(p: pd.Series, m: pd.Series, c: pd.Series, n: pd.Series, j0: pd.Series, step: pd.Series, off: pd.Series) -> pd.Series:
        out = []
        for k in range(len(p)):
            a, b = block(p, m, k, width)
            e = None if c.iloc[k] == 0 else [np.where(np.arange(width) == o, 0.0, np.inf) for o in range(width)]
            end, _b = forward(a, b, s, step.iloc[k], np.full(width, off.iloc[k]), int(c.iloc[k]) * size, int(j0.iloc[k]), int(n.iloc[k]), e)
            out.append(np.stack(end, axis=1).ravel())
        return pd.Series(out, dtype=object)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry costs of every chunk from the transfer matrices before it."""
        pdf = pdf.sort_values("c")
        entry, out = np.full(width, np.inf), []
        for t in pdf["T"]:
            out.append(entry)
            t = np.asarray(t).reshape(width, width)
            entry = t[0] if len(out) == 1 else (entry[:, None] + t).min(axis=0)
        return pdf[[*keys, "c"]].assign(entry=out)

    def exits(p: pd.Series, m: pd.Series, c: pd.Series, n: pd.Series, j0: pd.Series, step: pd.Series, off: pd.Series, entry: pd.Series) -> pd.Series:
        """For each exit offset of the chunk, the offset its path came in with."""
        out = []
        for k in range(len(p)):
            a, b = block(p, m, k, width)
            i0, jj = int(c.iloc[k]) * size, int(j0.iloc[k])
            end, back = forward(a, b, s, step.iloc[k], np.full(width, off.iloc[k]), i0, jj, int(n.iloc[k]), starts(c.iloc[k], entry.iloc[k], width))
            sound = np.isfinite([end[o][0] for o in range(width)])
            came = np.full(width, -1)
            if sound.any():
                o = np.flatnonzero(sound)
                came[o] = backward(a[o], b[o], s, back[:, :, o], o, i0, jj)[-1]
            out.append(came.astype(np.int32))
        return pd.Series(out, dtype=object)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exit offset of every chunk, from the last one back."""
        pdf = pdf.sort_values("c", ascending=False)
        o, out = reach, []
        for came in pdf["came"]:
            out.append(o)
            o = came[o]
        return pdf[[*keys, "c"]].assign(leave=out)

    def decode(p: pd.Series, m: pd.Series, c: pd.Series, n: pd.Series, j0: pd.Series, step: pd.Series, off: pd.Series, entry: pd.Series, leave: pd.Series) -> pd.DataFrame:
        rows = []
        for k in range(len(p)):
            a, b = block(p, m, k, 1)
            i0, jj = int(c.iloc[k]) * size, int(j0.iloc[k])
            _e, back = forward(a, b, s, step.iloc[k], np.full(1, off.iloc[k]), i0, jj, int(n.iloc[k]), starts(c.iloc[k], entry.iloc[k], 1))
            low, high, lc, wc, st, ln, _x = backward(a, b, s, back, [leave.iloc[k]], i0, jj)
            rows.append((np.clip(np.floor((low[0] + high[0]) / 2.0 + 0.5), 0, n.iloc[k] - 1).astype(np.int32), lc[0], wc[0], int(st[0]), int(ln[0])))
        return pd.DataFrame(rows, columns=["w", "local_cost", "warp_cost", "steps", "path_length"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields if f.name in keys)
    args = [F.col(x) for x in ("p", "m", "c", "n", "j0", "step", "offset")]
    t = parts.select(*keys, "c", F.pandas_udf(transfer, "array<double>")(*args).alias("T"))
    entry = t.groupBy(*keys).applyInPandas(chain, f"{ddl}, c long, entry array<double>")
    ready = parts.join(entry, [*keys, "c"])
    came = ready.select(*keys, "c", F.pandas_udf(exits, "array<int>")(*args, F.col("entry")).alias("came"))
    leave = came.groupBy(*keys).applyInPandas(choose, f"{ddl}, c long, leave int")
    done = ready.join(leave, [*keys, "c"]).withColumn("_r", F.pandas_udf(decode, RESULT)(*args, F.col("entry"), F.col("leave")))
    return done.select(*keys, (F.col("c") * size).alias("start"), F.lit(False).alias("whole"), "_r.*")


def seconds(solved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., t, w): one row per second; chunks of a long trial are made monotone together."""
    flat = solved.select(*keys, "whole", "start", F.posexplode("w").alias("_i", "_w")).select(
        *keys, "whole", (F.col("start") + F.col("_i")).cast("long").alias("t"), F.col("_w").cast("long").alias("w"))
    cut = flat.filter(~F.col("whole")).drop("whole")
    return flat.filter("whole").drop("whole").unionByName(D.running(cut, keys, "t", F.col("w"), "w", "max"))


def mapped(solved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys.., start, w): mappings as one array per block of LONG seconds."""
    cut = D.blocks(seconds(solved.filter(~F.col("whole")), keys), keys, "t", ["w"], 0, LONG)
    whole = solved.filter("whole").select(*keys, "start", F.col("w").cast("array<bigint>").alias("w"))
    return whole.unionByName(cut.select(*keys, (F.col("c") * LONG).alias("start"), "w"))


def costs(solved: DataFrame, keys: Sequence[str]) -> DataFrame:
    return solved.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("local_cost", "warp_cost", "steps", "path_length")])


def align(rows: DataFrame, keys: Sequence[str], s: WarpSettings, target: str = "value", reference: str = "prior") -> DataFrame:
    """(keys.., t, w) straight from rows (t, target, reference).

    Blocks, signals and solved trials are read several times further on: each is
    written once, which also keeps the plans small.
    """
    blocks = parked(trial_blocks(rows, keys, target, reference), "blocks")
    return seconds(solved_once(parked(signal_blocks(blocks, keys, s), "signals"), keys, s), keys)


def solved_once(packed: DataFrame, keys: Sequence[str], s: WarpSettings) -> DataFrame:
    """Solved trials as a written table, so that no reader aligns them again."""
    return parked(solve_blocks(packed, keys, s), "solved")


def consensus(map_v: Column, map_a: Column) -> Column:
    return F.floor((map_v + map_a) / 2.0 + 0.5)
