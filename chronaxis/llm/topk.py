"""Exact top-k search with a three-phase uniform threshold.

A score is the sum of partial scores, one per list; a list holds one slice of
the vectors' components.  Lists are cut into row chunks, so that a task works
on (query block, row chunk, list).

1. Every list gives the best entries of each query; their exact scores make
   the k-th best a safe cutoff.
2. The cutoff, split evenly over the lists, is sent to all lists.  A row that
   reaches the cutoff must reach this share in at least one list, so each list
   returns all entries above its share.
3. Rows whose upper bound (what was seen, and less than the share elsewhere)
   still reaches the cutoff are scored exactly, and the best k remain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

EXACT = 2**52
NO_CUTOFF = -(2**63)  # fewer than k candidates: every entry counts
PACK = "chunk long, list int, ids binary, extra binary, mat binary, width int"
PACK_ARROW = pa.schema([("chunk", pa.int64()), ("list", pa.int32()), ("ids", pa.binary()), ("extra", pa.binary()), ("mat", pa.binary()), ("width", pa.int32())])
SUB = 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """id, v: components as floor(scale * x); vectors with a null or non-finite part, and null ids, are left out.

    Rows with one id count once (the smallest vector stands for them).
    """
    x = F.col(vector)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def _pack(dims: int, lists: int):
    """One row per list with the ids and the slice of the vectors (shorter vectors end in zeros)."""
    cuts = np.linspace(0, dims, lists + 1).astype(int)

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        extra = table.column("extra").to_numpy()
        mat = np.zeros((len(ids), dims), np.int64)
        for i, v in enumerate(table.column("v").to_pylist()):
            mat[i, :len(v)] = v
        chunk = table.column("chunk")[0].as_py()
        rows = []
        for b in range(lists):
            part = np.ascontiguousarray(mat[:, cuts[b]:cuts[b + 1]])
            rows.append({"chunk": chunk, "list": b, "ids": ids.astype("<i8").tobytes(), "extra": extra.astype("<i8").tobytes(),
                         "mat": part.astype("<i8").tobytes(), "width": part.shape[1]})
        return pa.Table.from_pylist(rows, schema=PACK_ARROW)
    return run


def _load(row: dict, side: str, small: bool):
    ids = np.frombuffer(row[f"{side}_ids"], "<i8")
    mat = np.frombuffer(row[f"{side}_mat"], "<i8").reshape(len(ids), row["width"])
    return ids, np.frombuffer(row[f"{side}_extra"], "<i8"), mat.astype(np.float64) if small else mat


def _scores(row: dict, small: bool):
    """Partial scores in blocks of queries: (query ids, cutoffs, row ids, scores); a query's own row is masked."""
    q_ids, cut, q = _load(row, "q", small)
    c_ids, _, c = _load(row, "c", small)
    for at in range(0, len(q_ids), SUB):
        s = (q[at:at + SUB] @ c.T).astype(np.int64)
        yield q_ids[at:at + SUB], cut[at:at + SUB], c_ids, s, q_ids[at:at + SUB, None] == c_ids[None, :]


ENTRY = "query_id long, id long, list int, part long, qchunk long, chunk long"
ENTRY_ARROW = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("list", pa.int32()), ("part", pa.int64()), ("qchunk", pa.int64()), ("chunk", pa.int64())])


def _entries(small: bool, depth: int | None, lists: int):
    """The best ``depth`` entries of each query, or with None all at or above its share of the cutoff."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for q_ids, cut, c_ids, s, own in _scores(row, small):
                    if depth is None:
                        share = np.where(cut == NO_CUTOFF, cut, -(-cut // lists))  # rounded up: scores are whole numbers
                        qi, ci = np.nonzero((s >= share[:, None]) & ~own)
                    else:
                        low = np.where(own, np.iinfo(np.int64).min, s)
                        n = min(depth, low.shape[1])
                        best = np.argpartition(low, low.shape[1] - n, axis=1)[:, low.shape[1] - n:]
                        qi, ci = np.repeat(np.arange(len(q_ids)), n), best.ravel()
                        keep = ~own[qi, ci]
                        qi, ci = qi[keep], ci[keep]
                    k = len(qi)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[qi]), pa.array(c_ids[ci]), pa.array(np.full(k, row["list"], np.int32)), pa.array(s[qi, ci]),
                         pa.array(np.full(k, row["qchunk"], np.int64)), pa.array(np.full(k, row["chunk"], np.int64))], schema=ENTRY_ARROW)
    return run


def _resolve(small: bool, k: int):
    """Exact scores of the surviving pairs of one (query block, chunk), best k of each query."""
    def run(key, pairs: pa.Table, packs: pa.Table) -> pa.Table:
        total = np.zeros(len(pairs), np.int64)
        queries, ids = pairs.column("query_id").to_numpy(), pairs.column("id").to_numpy()
        for row in packs.to_pylist():
            q_ids, _, q = _load(row, "q", small)
            c_ids, _, c = _load(row, "c", small)
            qo, co = np.argsort(q_ids), np.argsort(c_ids)
            qi, ci = qo[np.searchsorted(q_ids, queries, sorter=qo)], co[np.searchsorted(c_ids, ids, sorter=co)]
            for at in range(0, len(total), 8192):
                total[at:at + 8192] += (q[qi[at:at + 8192]] * c[ci[at:at + 8192]]).sum(axis=1).astype(np.int64)
        order = np.lexsort((ids, -total, queries))
        qs = queries[order]
        first = np.r_[True, qs[1:] != qs[:-1]] if len(qs) else np.zeros(0, bool)
        starts = np.maximum.accumulate(np.where(first, np.arange(len(qs)), 0))
        order = order[np.arange(len(qs)) - starts < k]
        return pa.table({"query_id": pa.array(queries[order], pa.int64()), "id": pa.array(ids[order], pa.int64()), "score": pa.array(total[order], pa.int64())})
    return run


def top_k(vectors: DataFrame, query_filter, key: str = "vec_id", vector: str = "embedding", k: int = 10, lists: int = 2,
          scale: int = 1024, chunk_rows: int = 4096, query_rows: int = 1024) -> DataFrame:
    """The k best rows of each query by integer inner product: query_id, rank, id, score.

    ``query_filter`` is a Column over ``id``.  A query's own id never answers
    it; ties go to the smaller id; fewer rows than k give fewer answers; an
    empty table gives none.  Vectors of different lengths are compared as if
    the shorter ended in zeros.  Of equal vectors only the k + 1 smallest ids
    can ever answer, so later copies leave the lists before the search.
    Scores are exact: beyond 2^52 the lists use 64-bit integers.  Where the
    largest component leaves room for a score beyond a long, the call raises
    before any search; a smaller ``scale`` helps.
    """
    rows = persisted(quantised(vectors, key, vector, scale), "topk-rows")
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))),
                    F.sum(query_filter.cast("int"))).first()
    n, dims, peak, asked = size[0], max(size[1] or 0, 1), size[2] or 0, size[3] or 0
    if peak * peak * dims >= 2**63:
        raise ArithmeticError(f"components up to {peak:.0f} in {dims} dimensions: scores may not fit a long")
    small = peak * peak * dims < EXACT
    lists = min(lists, dims)
    chunks, blocks = max(1, -(-n // chunk_rows)), max(1, -(-asked // query_rows))

    copies = Window.partitionBy("v").orderBy("id")
    answers = rows.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).drop("_n")
    answers = answers.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn("extra", F.lit(0).cast("long"))
    packed = persisted(answers.groupBy("chunk").applyInArrow(_pack(dims, lists), PACK), "topk-lists")
    queries = rows.filter(query_filter).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)))

    def nodes(cutoffs: DataFrame | None) -> DataFrame:
        if cutoffs is None:
            asked_for = queries.withColumn("extra", F.lit(0).cast("long"))
        else:
            asked_for = queries.join(cutoffs, queries["id"] == cutoffs["query_id"], "left").select(
                "id", "v", "chunk", F.coalesce("cutoff", F.lit(NO_CUTOFF)).alias("extra"))
        q = asked_for.groupBy("chunk").applyInArrow(_pack(dims, lists), PACK)
        q = q.select(F.col("chunk").alias("qchunk"), "list", F.col("ids").alias("q_ids"), F.col("extra").alias("q_extra"), F.col("mat").alias("q_mat"))
        q = q.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
        c = packed.select("chunk", "list", F.col("ids").alias("c_ids"), F.col("extra").alias("c_extra"), F.col("mat").alias("c_mat"), "width")
        c = c.withColumn("qchunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        # Sizes measured before the copies are made would have the driver broadcast all of them.
        return c.join(q.hint("merge"), ["qchunk", "chunk", "list"])

    # Phase 1: best entries of every list, exact scores, cutoff.
    depth = 4 * k
    gathered = nodes(None).mapInArrow(_entries(small, depth, lists), ENTRY)
    per_list = Window.partitionBy("query_id", "list").orderBy(F.desc("part"), "id")
    heads = gathered.withColumn("_n", F.row_number().over(per_list)).filter(F.col("_n") <= depth).select("query_id", "id").distinct()
    left = rows.select(F.col("id").alias("query_id"), F.col("v").alias("_q"))
    dot = F.aggregate(F.zip_with("_q", "v", lambda a, b: F.coalesce(a * b, F.lit(0))), F.lit(0).cast("long"), lambda a, b: a + b)
    scored = heads.join(rows, "id").join(left, "query_id").select("query_id", "id", dot.alias("score"))
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    cutoffs = scored.withColumn("_n", F.row_number().over(nth)).filter(F.col("_n") == k).select("query_id", F.col("score").alias("cutoff"))
    cutoffs = persisted(cutoffs, "topk-cutoffs")

    # Phase 2: every entry that reaches its share of the cutoff, bounded from above.
    entries = nodes(cutoffs).mapInArrow(_entries(small, None, lists), ENTRY)
    seen = entries.groupBy("query_id", "id", "qchunk", "chunk").agg(F.sum("part").alias("_sum"), F.count(F.lit(1)).alias("_lists"))
    seen = seen.join(cutoffs, "query_id", "left")
    share = F.ceil(F.col("cutoff") / lists)
    alive = F.col("cutoff").isNull() | (F.col("_sum") + (lists - F.col("_lists")) * (share - 1) >= F.col("cutoff"))
    pairs = seen.filter(alive).select("query_id", "id", "qchunk", "chunk")

    # Phase 3: exact scores where the vectors are.
    best = pairs.groupBy("qchunk", "chunk").cogroup(nodes(None).groupBy("qchunk", "chunk")).applyInArrow(
        _resolve(small, k), "query_id long, id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(nth)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")
