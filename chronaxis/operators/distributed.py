"""Order-based building blocks that never send one key to one task.

A key (a trial, an item, a subject) may own a large share of all rows.  The
helpers here give exact positions, row frames, running totals, order statistics
and quantiles by cutting such a key into chunks or value bins, so that the work
of a hot key is spread and only per-chunk summaries meet.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096

LAST_BIN = (1 << 63) - 1


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def _matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inner join on columns whose nulls and NaNs equal themselves; keeps the left copies."""
    other = right.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on]
    if not same:
        return left.crossJoin(other)  # keyless totals: one row
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return left.join(other, cond).drop(*[f"_j_{c}" for c in on])


def _bin(x: Column, width: float, descending: bool = False) -> Column:
    """Value bin that keeps the order of the values: nulls in the null bin, NaN with the largest.

    In descending order (values come negated) NaN is the first bin.
    """
    if descending:
        return F.when(F.isnan(x), F.lit(-LAST_BIN)).when(x.isNotNull(), F.greatest(F.floor(x / F.lit(width)), F.lit(1 - LAST_BIN)))
    return F.when(F.isnan(x), F.lit(LAST_BIN)).otherwise(F.floor(x / F.lit(width)))


def prefix_offsets(counts: DataFrame, keys: Sequence[str], bucket: str | Column, amount: str, out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` over the buckets of each key.

    The input is already one row per (key, bucket).
    """
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(amount).over(w), F.lit(0)))


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    out: str = "t",
) -> DataFrame:
    """Zero-based position of every row inside its key.

    ``bucket`` is any non-decreasing function of the first order column (a day,
    an id range).  Rows are ranked inside (key, bucket) and shifted by the size
    of the earlier buckets, which is the same number ``row_number`` gives.
    """
    rows = df.withColumn("_b", bucket)
    local = Window.partitionBy(*keys, "_b").orderBy(*order)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    shift = prefix_offsets(sizes, keys, "_b", "_n", "_off").drop("_n")
    return (
        _matched(rows.withColumn("_r", F.row_number().over(local)), shift, [*keys, "_b"])
        .withColumn(out, (F.col("_off") + F.col("_r") - 1).cast("long"))
        .drop("_b", "_r", "_off")
    )


def dense_index(ids: DataFrame, column: str, bucket: Column, out: str = "idx") -> DataFrame:
    """0..n-1 over distinct ids in sorted order, without one global sort task.

    Bucket sizes are summed in two levels so that the only single-task window
    sees one row per 4096 buckets.
    """
    unique = ids.select(column).distinct()
    rows = unique.withColumn("_b", bucket)
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    if dict(sizes.dtypes)["_b"] in ("bigint", "int"):
        sizes = sizes.withColumn("_s", F.floor(F.col("_b") / CHUNK))
        supers = sizes.groupBy("_s").agg(F.sum("_n").alias("_sn"))
        supers = prefix_offsets(supers, [], "_s", "_sn", "_soff").drop("_sn")
        inner = prefix_offsets(sizes, ["_s"], "_b", "_n", "_ioff")
        shift = _matched(inner, supers, ["_s"]).select("_b", (F.col("_ioff") + F.col("_soff")).alias("_off"))
    else:
        shift = prefix_offsets(sizes, [], "_b", "_n", "_off").select("_b", "_off")
    local = Window.partitionBy("_b").orderBy(column)
    return (
        _matched(rows.withColumn("_r", F.row_number().over(local)), shift, ["_b"])
        .select(column, (F.col("_off") + F.col("_r") - 1).cast("long").alias(out))
    )


def chunk_of(pos: str | Column, size: int = CHUNK) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / F.lit(size)).cast("long")


def framed(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    before: int,
    after: int,
    build: Callable[[DataFrame, object], DataFrame],
    size: int = CHUNK,
) -> DataFrame:
    """Evaluate row-frame expressions with reach (-before, +after).

    Rows near a chunk edge are copied into the neighbouring chunk, so a window
    over (key, chunk) sees every row its frame needs.  ``build(df, window)``
    adds the columns; copies are dropped afterwards.  Positions are contiguous.
    """
    c = F.col(pos)
    first = F.greatest(F.lit(0).cast("long"), chunk_of(c - after, size))
    last = chunk_of(c + before, size)
    copied = df.withColumn("_c", F.explode(F.sequence(first, last)))
    out = build(copied, Window.partitionBy(*keys, "_c").orderBy(pos))
    return out.filter(F.col("_c") == chunk_of(c, size)).drop("_c")


def blocks(df: DataFrame, keys: Sequence[str], pos: str, columns: Sequence[str], halo: int = 0, size: int = CHUNK) -> DataFrame:
    """(keys.., c, columns as arrays in order of ``pos``): one row per chunk of a key.

    A chunk's arrays start at ``greatest(c * size - halo, 0)`` and end ``halo``
    rows after the chunk, so frames of that reach need no other row.  A key that
    ends inside the halo before a chunk has a row of halo alone for it.
    Positions are contiguous.
    """
    c = F.col(pos)
    at = chunk_of(pos, size)
    if halo:
        at = F.explode(F.sequence(chunk_of(F.greatest(c - halo, F.lit(0)), size), chunk_of(c + halo, size)))
    rows = df.select(*keys, at.alias("c"), F.struct(c, *_cols(columns)).alias("_s"))
    packed = rows.groupBy(*keys, "c").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return packed.select(*keys, "c", *[F.col(f"_s.{name}").alias(name) for name in columns])


def attach(df: DataFrame, totals: DataFrame, keys: Sequence[str], pos: str = "t", length: str = "n",
           how: str = "inner", size: int = CHUNK) -> DataFrame:
    """Join per-key totals back to the rows of the key.

    The totals carry the key's row count, so each key gets exactly as many
    copies as it has chunks: one for an ordinary key, many for a hot one.
    """
    wide = totals.withColumn(
        "_c", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(F.greatest(F.col(length) - 1, F.lit(0)), size)))
    )
    return df.withColumn("_c", chunk_of(pos, size)).join(wide, [*keys, "_c"], how).drop("_c")


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: Column,
    out: str,
    how: str = "sum",
    inclusive: bool = True,
    size: int = CHUNK,
) -> DataFrame:
    """Running sum or maximum from the start of the key up to each row."""
    agg = F.sum if how == "sum" else F.max
    rows = df.withColumn("_x", value).withColumn("_c", chunk_of(pos, size))
    parts = rows.groupBy(*keys, "_c").agg(agg("_x").alias("_p"))
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*keys, "_c", agg("_p").over(earlier).alias("_carry"))
    local = Window.partitionBy(*keys, "_c").orderBy(pos).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    both = _matched(rows.withColumn("_l", agg("_x").over(local)), carry, [*keys, "_c"])
    if how == "sum":
        merged = F.coalesce(F.col("_l"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        merged = F.greatest("_l", "_carry")
    return both.withColumn(out, merged).drop("_x", "_c", "_l", "_carry")


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ranks: dict[str, Callable[[Column], Column]],
    width: float = 1.0,
    total: str = "n",
) -> DataFrame:
    """Exact order statistics of each key; ranks are 0-based functions of n.

    Copies are counted first, then counted per value bin of the given width.
    Only the bins that hold a wanted rank are opened, so a key is never
    gathered whole: a task sees one bin of distinct values.
    """
    counted = df.groupBy(*keys, value.cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_cnt"))
    counted = counted.filter(F.col("_x").isNotNull()).withColumn("_b", _bin(F.col("_x"), width))
    bins = counted.groupBy(*keys, "_b").agg(F.sum("_cnt").alias("_bn"))
    bins = prefix_offsets(bins, keys, "_b", "_bn", "_before")
    bins = bins.withColumn(total, F.sum("_bn").over(Window.partitionBy(*keys)))
    n = F.col(total)
    for name, rank in ranks.items():
        bins = bins.withColumn(f"_k_{name}", F.greatest(F.lit(0), F.least(rank(n), n - 1)).cast("long"))
    wanted = F.lit(False)
    for name in ranks:
        k = F.col(f"_k_{name}")
        wanted = wanted | ((F.col("_before") <= k) & (F.col("_before") + F.col("_bn") > k))
    open_bins = bins.filter(wanted).drop("_bn")
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    opened = _matched(counted, open_bins, [*keys, "_b"]).withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_cnt").over(inside), F.lit(0))
    )
    picks = [F.max(total).alias(total)]
    for name in ranks:
        k = F.col(f"_k_{name}")
        hit = (F.col("_from") <= k) & (F.col("_from") + F.col("_cnt") > k)
        picks.append(F.max(F.when(hit, F.col("_x"))).alias(name))
    if keys:
        return opened.groupBy(*keys).agg(*picks)
    return opened.agg(*picks)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probs: dict[str, float],
    width: float = 1.0,
    total: str = "n",
) -> DataFrame:
    """Exact linearly interpolated quantiles of each key (skew-safe)."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor(F.lit(p) * (n - 1))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil(F.lit(p) * (n - 1))
    stats = order_statistics(df, keys, value, ranks, width, total)
    out = [*_cols(keys), F.col(total)]
    for name, p in probs.items():
        pos = F.lit(p) * (F.col(total) - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        share = pos - F.floor(pos)
        # weighted ends round once at a median, so equal medians are equal doubles and stay ties
        out.append(F.when(share == 0, lo).otherwise(lo * (1 - share) + hi * share).alias(name))
    return stats.select(*out)


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column], width: float = 1.0) -> DataFrame:
    """Exact medians of several value columns per key, in one pass.

    The columns are stacked into long form so that one set of exchanges serves
    all of them.
    """
    stacked = df.select(
        *keys,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("k"), col.cast("double").alias("x")) for name, col in values.items()
        ])).alias("_s"),
    ).select(*keys, F.col("_s.k").alias("_k"), F.col("_s.x").alias("_v"))
    q = quantiles(stacked, [*keys, "_k"], F.col("_v"), {"_m": 0.5}, width, total="_t")
    picks = [F.max(F.when(F.col("_k") == name, F.col("_m"))).alias(name) for name in values]
    return q.groupBy(*keys).agg(*picks, F.max("_t").alias("n")) if keys else q.agg(*picks, F.max("_t").alias("n"))


def medians_without(df: DataFrame, keys: Sequence[str], value: Column, fold: str, n: int, sets: dict[str, Sequence[int]],
                    width: float = 1.0) -> DataFrame:
    """Exact medians of each key without the rows of some folds, for every named set of folds at once.

    Values are counted once per (key, value) with one count per fold; what a
    set leaves out is subtracted from running counts, so no row is copied to
    the sides it trains.  Rows are (keys.., set, med, n); a set that leaves no
    row of a key has none.  Null values do not count.
    """
    folds = range(n)
    x = value.cast("double")
    counted = df.filter(x.isNotNull()).groupBy(*keys, x.alias("_x")).agg(*[F.count_if(F.col(fold) == f).alias(f"_c{f}") for f in folds])
    counted = counted.withColumn("_kb", F.struct(*keys, _bin(F.col("_x"), width).alias("_b")))
    bins = counted.groupBy("_kb").agg(*[F.sum(f"_c{f}").alias(f"_n{f}") for f in folds])
    bins = bins.select("_kb", *[F.col(f"_kb.{k}").alias(k) for k in keys], F.col("_kb._b").alias("_b"), *[f"_n{f}" for f in folds])
    key = Window.partitionBy(*keys)
    earlier = key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("_kb", *[f"_n{f}" for f in folds], *[F.coalesce(F.sum(f"_n{f}").over(earlier), F.lit(0)).alias(f"_p{f}") for f in folds],
                       *[F.sum(f"_n{f}").over(key).alias(f"_t{f}") for f in folds])

    def rest(prefix: str, left_out: Sequence[int]) -> Column:
        return sum((F.col(f"{prefix}{f}") for f in folds if f not in left_out), F.lit(0))

    wanted = {}
    for name, left_out in sets.items():
        total = rest("_t", left_out)
        wanted[name] = (F.floor((total - 1) / 2), F.floor(total / 2), total)

    def holds(name: str, start: Column, size: Column) -> Column:
        low, high, total = wanted[name]
        return (total > 0) & (start <= high) & (start + size > low)

    is_open = F.lit(False)
    for name, left_out in sets.items():
        is_open = is_open | holds(name, rest("_p", left_out), rest("_n", left_out))
    opened = counted.join(bins.filter(is_open).drop(*[f"_n{f}" for f in folds]).withColumnRenamed("_kb", "_ob"), F.col("_kb") == F.col("_ob"))
    inside = Window.partitionBy("_ob").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select(*keys, "_x", *[f"_c{f}" for f in folds], *[f"_t{f}" for f in folds],
                           *[(F.col(f"_p{f}") + F.coalesce(F.sum(f"_c{f}").over(inside), F.lit(0))).alias(f"_f{f}") for f in folds])
    picks = []
    for name, left_out in sets.items():
        low, high, total = wanted[name]
        start, size = rest("_f", left_out), rest("_c", left_out)
        at = lambda rank, start=start, size=size: F.max(F.when((start <= rank) & (start + size > rank), F.col("_x")))
        picks.append(F.struct(F.lit(name).alias("set"), ((at(low) + at(high)) / 2).alias("med"), F.max(total).alias("n")))
    found = opened.groupBy(*keys).agg(F.array(*picks).alias("_sets"))
    return found.select(*keys, F.explode("_sets").alias("_s")).select(*keys, "_s.*").filter("n > 0")


def medians_of_sets(df: DataFrame, keys: Sequence[str], value: Column, member: str, sets: Sequence[Sequence[int]], width: float = 1.0) -> DataFrame:
    """Exact medians of each key over overlapping sets of rows; a set takes the rows whose ``member`` it lists.

    Every set is one count of the value bins, so no row is copied to the sets it
    belongs to, and only rows of bins that hold a median are counted by value.  Rows are (keys.., set, rows, med): ``set`` numbers the sets, ``rows``
    counts null values too, which have no part in the median; a set without a row
    of a key has none.
    """
    counts = F.array(*[F.count_if(F.col(member).isin(list(s))) for s in sets])
    rows = df.select(*keys, member, value.cast("double").alias("_x")).withColumn("_b", _bin(F.col("_x"), width))
    # bins and the values of open bins are few, so they are opened to one row a set
    bins = rows.groupBy(*keys, "_b").agg(counts.alias("_a")).select(*keys, "_b", F.posexplode("_a").alias("set", "_n")).filter("_n > 0")
    known, key = F.when(F.col("_b").isNotNull(), F.col("_n")).otherwise(0), Window.partitionBy(*keys, "set")
    earlier = key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*keys, "_b", "set", known.alias("_n"), F.coalesce(F.sum(known).over(earlier), F.lit(0)).alias("_p"), F.sum(known).over(key).alias("_t"), F.sum("_n").over(key).alias("rows"))
    low, high = F.floor((F.col("_t") - 1) / 2), F.floor(F.col("_t") / 2)
    # the null bin stays for sets without a value
    bins = bins.filter(F.col("_b").isNull() | ((F.col("_p") <= high) & (F.col("_p") + F.col("_n") > low))).drop("_n")
    opened = _matched(rows, bins.select(*keys, "_b").distinct(), [*keys, "_b"])
    counted = opened.groupBy(*keys, "_b", "_x").agg(counts.alias("_a")).select(*keys, "_b", "_x", F.posexplode("_a").alias("set", "_c")).filter("_c > 0")
    inside = Window.partitionBy(*keys, "set", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    placed = _matched(counted, bins, [*keys, "set", "_b"]).withColumn("_from", F.col("_p") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("_from") <= rank) & (F.col("_from") + F.col("_c") > rank), F.col("_x")))
    return placed.groupBy(*keys, "set").agg(F.max("rows").alias("rows"), ((at(low) + at(high)) / 2).alias("med"))


def leave_one_out_medians(df: DataFrame, keys: Sequence[str], value: str, out: str, width: float = 1.0) -> DataFrame:
    """Median of the other rows of the key, for every row (null when alone).

    The median of n-1 values differs from the sorted full list only next to the
    middle, so four middle order statistics and the row's own value decide it.
    """
    ranks = {
        "_a0": lambda n: F.floor((n - 2) / 2), "_a1": lambda n: F.floor((n - 2) / 2) + 1,
        "_b0": lambda n: F.ceil((n - 2) / 2), "_b1": lambda n: F.ceil((n - 2) / 2) + 1,
    }
    mid = order_statistics(df, keys, F.col(value), ranks, width, total="_n")
    x = F.col(value)
    low = F.when(x > F.col("_a0"), F.col("_a0")).otherwise(F.col("_a1"))
    high = F.when(x > F.col("_b0"), F.col("_b0")).otherwise(F.col("_b1"))
    return (
        _matched(df, mid, list(keys))
        .withColumn(out, F.when(F.col("_n") > 1, (low + high) / 2))
        .drop("_a0", "_a1", "_b0", "_b1", "_n")
    )


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    ties: Sequence[str | Column],
    width: float = 1.0,
    descending: bool = False,
    ordinal: str = "rank",
    average: str | None = None,
    nulls_last: bool = False,
) -> DataFrame:
    """1-based ordinal rank and, on request, the average rank of tied values; nulls are tied and come first unless ``nulls_last``.

    Value bins give the offset; ranks are local to (key, bin).  Average ranks
    come from counts per distinct value, so one heavily tied value only meets
    its own bin when an ordinal rank is asked for.
    """
    sign = -1 if descending else 1
    by = F.col("_b").asc_nulls_last() if nulls_last else F.col("_b").asc()
    rows = df.withColumn("_x", value.cast("double") * sign).withColumn("_b", _bin(F.col("_x"), width, descending))
    out = rows
    if average:
        counted = rows.groupBy(*keys, "_b", "_x").agg(F.count(F.lit(1)).alias("_n"))
        bins = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
        bins = prefix_offsets(bins, keys, by, "_bn", "_before").drop("_bn")
        inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
        avg = (
            _matched(counted, bins, [*keys, "_b"])
            .withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .select(*keys, "_x", (F.col("_from") + (F.col("_n") + 1) / 2).alias(average))
        )
        out = _matched(out, avg, [*keys, "_x"])
    if ordinal:
        sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_bn"))
        shift = prefix_offsets(sizes, keys, by, "_bn", "_before").drop("_bn")
        local = Window.partitionBy(*keys, "_b").orderBy("_x", *ties)
        out = (
            _matched(out.withColumn("_r", F.row_number().over(local)), shift, [*keys, "_b"])
            .withColumn(ordinal, (F.col("_before") + F.col("_r")).cast("long"))
            .drop("_r", "_before")
        )
    return out.drop("_x", "_b")
