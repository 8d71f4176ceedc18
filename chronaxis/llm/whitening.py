"""Whitened leading components of a vector table by FEAST contour integration.

Two passes sum the covariance: exact integer totals first, then products of
centred vectors, added up row by row of the matrix.  What is left has the size
of the vectors, not of the table.  Signs of the pivots of V - sI (inertia)
count the eigenvalues above a shift; bisection on such counts cuts the upper
end of the spectrum into intervals that hold a few eigenvalues each.  Every
interval is a task of its own: quadrature of the resolvent on a circle around
it, a sum of complex shifted solves, projects a block of vectors onto its
eigenspace; Rayleigh-Ritz extracts the components, and the step is repeated
until residuals are at rounding level.  An interval that gives another number
of components than its inertia counts is an error, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 1024.0, 100_000
NODES = 8  # quadrature nodes on the upper half circle
ROUNDS = 40
EPS = float(np.finfo(float).eps)
LONG = 2**63


def sound(vector: str) -> Column:
    """True where the vector and all its components are present and finite."""
    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(F.col(vector).isNotNull() & finite, F.lit(False))


def _steps(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> np.ndarray:
    """floor(1024 c) as rows of doubles; vectors shorter than the widest end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    width = int(sizes.max(initial=0)) if width is None else width
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _whole(values: np.ndarray) -> list[int]:
    """Exact column sums of whole numbers."""
    if values.size == 0 or np.abs(values).max() * len(values) < 2**53:
        return [int(v) for v in values.sum(axis=0)]
    return [sum(int(v) for v in column) for column in values.T]


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: number of rows (dim -1) and the sum of each dimension, as decimal text."""
    n, sums = 0, []
    for batch in batches:
        part = _whole(_steps(batch.column("v")))
        n += batch.num_rows
        sums += [0] * (len(part) - len(sums))
        for i, v in enumerate(part):
            sums[i] += v
    rows = {"dim": range(-1, len(sums)), "total": [str(v) for v in [n, *sums]]}
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("dim", pa.int32()), ("total", pa.string())]))


def _added(table: pa.Table) -> pa.Table:
    total = sum(int(v) for v in table.column("total").to_pylist())
    return pa.table({"dim": table.column("dim").slice(0, 1), "total": pa.array([str(total)])})


@dataclass(frozen=True)
class Sums:
    """Row count and exact totals of the whole-number vectors."""

    n: int
    totals: list[int]

    @property
    def mean(self) -> np.ndarray:
        """S/n without the shift: whole part and remainder are divided apart."""
        return np.array([s // self.n + (s % self.n) / self.n for s in self.totals])


def sums(rows: DataFrame) -> Sums:
    """Totals of floor(1024 c) per dimension; the shift is the same in every row and cancels."""
    found = rows.mapInArrow(_totals, "dim int, total string").groupBy("dim").applyInArrow(_added, "dim int, total string").collect()
    given = {r["dim"]: int(r["total"]) for r in found}
    return Sums(given.get(-1, 0), [given[i] for i in range(len(given) - 1)] if given else [])


def _products(mean: np.ndarray):
    """Per task: the rows of the sum of centred products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            x = _steps(batch.column("v"), len(mean)) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"dim": np.arange(len(mean), dtype=np.int32), "line": [r.tobytes() for r in total]},
                                         schema=pa.schema([("dim", pa.int32()), ("line", pa.binary())]))
    return run


def _lines(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(b) for b in table.column("line").to_pylist()], axis=0)
    return pa.table({"dim": table.column("dim").slice(0, 1), "line": pa.array([total.tobytes()], pa.binary())})


def covariance(rows: DataFrame, given: Sums) -> np.ndarray:
    """Covariance (divisor n), centred before multiplying."""
    if not given.totals or given.n == 0:
        return np.zeros((0, 0))
    parts = rows.mapInArrow(_products(given.mean), "dim int, line binary").groupBy("dim").applyInArrow(_lines, "dim int, line binary")
    lines = sorted(((r["dim"], r["line"]) for r in parts.collect()))
    v = np.array([np.frombuffer(b) for _, b in lines]) / given.n
    return (v + v.T) / 2


def above(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues above ``shift``: positive pivots of V - sI.

    Pivots are taken by size over the whole rest, single or in pairs; a pair
    whose determinant is negative has one eigenvalue of each sign.
    """
    a = v - shift * np.eye(len(v))
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        i = int(diagonal.argmax())
        rest = np.abs(a - np.diag(np.diag(a)))
        p, q = np.unravel_index(int(rest.argmax()), rest.shape)
        if diagonal[i] >= 0.6404 * rest[p, q]:
            pivot = [i]
            positive += a[i, i] > 0
        else:
            pivot = [p, q]
            positive += 1
        if not a[np.ix_(pivot, pivot)].any():
            break  # what is left is zero
        keep = np.setdiff1d(np.arange(len(a)), pivot)
        side = a[np.ix_(keep, pivot)]
        a = a[np.ix_(keep, keep)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
    return int(positive)


def intervals(v: np.ndarray, k: int, most: int = 4) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) from the top, at least the k largest that are not zero to rounding."""
    size = float(np.abs(v).sum(axis=1).max(initial=0.0))
    if size == 0:
        return []
    low, high = 8 * len(v) * EPS * size, size * (1 + 1e-3)
    have = above(v, low)
    k = min(k, have)
    if k == 0:
        return []
    top = high
    while have > k + 2 and top - low > 1e-10 * size:
        middle = low + 0.4871 * (top - low)
        count = above(v, middle)
        low, have, top = (middle, count, top) if count >= k else (low, have, middle)
    out, stack = [], [(low, high, have)]
    while stack:
        a, b, count = stack.pop()
        if count <= most or b - a < 1e-9 * size:
            if count:
                out.append((a, b, count))
            continue
        middle = a + 0.4871 * (b - a)
        upper = above(v, middle) - above(v, b)
        stack += [(a, middle, count - upper), (middle, b, upper)]
    return sorted(out, reverse=True)


def contour(v: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors in (low, high], as many as inertia counts."""
    d, size = len(v), np.abs(v).sum(axis=1).max()
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (x + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, min(d, max(2 * count, count + 8)))))[0]
    last = np.inf
    for _ in range(ROUNDS):
        projected = np.zeros_like(basis)
        for t, weight in zip(turn, w):
            projected += weight / 2 * (radius * t * np.linalg.solve((centre + radius * t) * np.eye(d) - v, basis.astype(complex))).real
        basis = np.linalg.qr(projected)[0]
        values, turned = np.linalg.eigh(basis.T @ v @ basis)
        basis = basis @ turned
        inside = (values > low) & (values <= high)
        worst = np.linalg.norm(v @ basis[:, inside] - basis[:, inside] * values[inside], axis=0).max(initial=0.0)
        if inside.sum() == count and worst <= 1e-12 * size and (worst <= 4 * EPS * size or worst >= last / 2):
            return values[inside], basis[:, inside]
        last = worst
    raise ArithmeticError(f"{int(inside.sum())} components between {low} and {high}, inertia counts {count}")


def _solve(v: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = contour(v, row["low"], row["high"], row["count"])
                yield pa.RecordBatch.from_pydict({"value": values, "vector": [c.tobytes() for c in vectors.T]},
                                                 schema=pa.schema([("value", pa.float64()), ("vector", pa.binary())]))
    return run


def components(spark: SparkSession, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors as columns.

    Eigenvalues that are zero to rounding have no component.  Of each vector
    the entry of largest size is positive.
    """
    pieces = intervals(v, k)
    if not pieces:
        return np.zeros(0), np.zeros((len(v), 0))
    work = spark.createDataFrame(pieces, "low double, high double, count int").repartition(len(pieces))
    found = work.mapInArrow(_solve(v), "value double, vector binary").collect()
    if len(found) != sum(p[2] for p in pieces):
        raise ArithmeticError(f"{len(found)} components, inertia counts {sum(p[2] for p in pieces)}")
    # One more Rayleigh-Ritz step makes vectors of neighbouring intervals orthogonal to rounding.
    basis = np.linalg.qr(np.array([np.frombuffer(r["vector"]) for r in sorted(found, key=lambda r: -r["value"])]).T)[0]
    values, turned = np.linalg.eigh(basis.T @ v @ basis)
    values, vectors = values[::-1][:k], (basis @ turned)[:, ::-1][:, :k]
    peak = np.abs(vectors).argmax(axis=0)
    return values, vectors * np.sign(vectors[peak, np.arange(len(values))])


def _deviations(x: np.ndarray, given: Sums) -> list[int | None]:
    """Exact sum of (n x - S)^2; null where it leaves the range of a long."""
    n, mean = given.n, given.mean
    rough = (((x - mean) * n) ** 2).sum(axis=1)
    reach = float(np.abs(x).max(initial=0.0)) * n + max((abs(s) for s in given.totals), default=0)
    if reach < 2**62 and rough.max(initial=0.0) < 2**62:
        diff = x.astype(np.int64) * n - np.array(given.totals, np.int64)
        return (diff * diff).sum(axis=1).tolist()
    out: list[int | None] = []
    for row, about in zip(x, rough):
        exact = sum((n * int(c) - s) ** 2 for c, s in zip(row, given.totals)) if about < 1.001 * LONG else LONG
        out.append(exact if exact < LONG else None)
    return out


def _moments(mean: np.ndarray, axes: np.ndarray):
    """Per task: count, means and centred products of the whitened values, merged batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                y = (_steps(batch.column("v"), len(mean)) - mean) @ axes
                centre = y.mean(axis=0)
                state = _merged(state, (len(y), centre, (y - centre).T @ (y - centre)))
        if state:
            yield pa.RecordBatch.from_pydict({"count": [state[0]], "mean": [state[1].tobytes()], "m2": [state[2].tobytes()]}, schema=MOMENTS_ARROW)
    return run


MOMENTS = "count long, mean binary, m2 binary"
MOMENTS_ARROW = pa.schema([("count", pa.int64()), ("mean", pa.binary()), ("m2", pa.binary())])


def _merged(a, b):
    if a is None:
        return b
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _states(rows: list[dict]):
    state = None
    for r in rows:
        mean = np.frombuffer(r["mean"])
        state = _merged(state, (r["count"], mean, np.frombuffer(r["m2"]).reshape(len(mean), len(mean))))
    return state


def _folded(table: pa.Table) -> pa.Table:
    count, mean, m2 = _states(table.to_pylist())
    return pa.Table.from_pydict({"count": [count], "mean": [mean.tobytes()], "m2": [m2.tobytes()]}, schema=MOMENTS_ARROW)


def identity_error(rows: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    parts = rows.mapInArrow(_moments(mean, axes), MOMENTS).withColumn("_g", F.spark_partition_id() % 64)
    folded = parts.groupBy("_g").applyInArrow(lambda t: _folded(t.drop_columns("_g")), MOMENTS).collect()
    count, _, m2 = _states([r.asDict() for r in sorted(folded, key=lambda r: (r["count"], bytes(r["mean"])))])
    return float(np.abs(m2 / count - np.eye(len(m2))).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"
OUT_ARROW = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])


def _whitened(given: Sums, axes: np.ndarray, shares: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, k = given.mean, axes.shape[1]
        for batch in batches:
            x, m = _steps(batch.column("v"), len(mean)), batch.num_rows
            pick = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pick), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, given.n)),
                 pa.array(_deviations(x, given), pa.int64()).take(pick), pa.array(((x - mean) @ axes).ravel()), pa.array(np.tile(shares, m))], schema=OUT_ARROW)
    return run


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8) -> DataFrame:
    """One row per sound vector and leading component: projection over its standard deviation.

    Vectors that are null or hold null or non-finite components take no part.
    Of vectors of different lengths the shorter end in zeros.  Repeated rows
    and null keys count and come back as they are.  Components whose variance
    is zero to rounding (equal vectors, a single row) are left out, so such a
    table, like an empty one, gives no rows.  ``deviation`` is null where the
    exact number does not fit a long.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(sound(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    given = sums(rows)
    v = covariance(rows, given)
    values, axes = components(spark, v, k)
    if not len(values):
        return spark.createDataFrame([], f"{OUT}, identity_error double")
    scaled = axes / np.sqrt(values)
    error = identity_error(rows, given.mean, scaled)
    return rows.mapInArrow(_whitened(given, scaled, values / np.trace(v)), OUT).withColumn("identity_error", F.lit(error))
