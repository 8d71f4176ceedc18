"""Suffix-array dedup: bytes covered by 50-byte strings of earlier documents.

1. Texts are packed into chunks and written once, bucketed by chunk, so later
   passes join per-chunk answers without moving text again.
2. Every 50-byte window is keyed by the smallest hash among its 24-byte grams.
   Each chunk sends each of its keys once; keys seen in one document only are
   finished, since equal windows have equal keys.
3. For the other keys each chunk sends the strings behind its windows.  Strings
   of one key meet in one task, where equal strings collapse and the rest form
   shards whose Burrows-Wheeler transforms are merged; intervals of rows with a
   common prefix of 50 bytes name the smallest document of every window.
4. Chunks get these documents back and cut the covered bytes out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .bwt import common_prefix_intervals, merge, transform
from .common import partitions
from .shingles import mix, powers

LENGTH = 50
GRAM = 24
SPAN = LENGTH - GRAM + 1       # grams of a window
WIDTH = 80                     # a run's string has at most LENGTH + SPAN - 1 = 76 bytes
CHUNK_BYTES = 2 << 20
BLOCK = 1 << 16
HOT = 4096                     # documents of a key beyond which its windows are dealt one by one
BATCH = 2048                   # strings of one merge
SHARDS = 8
LAST_ID = np.iinfo(np.int64).max  # stands for a null id: smaller than none

CHUNK = pa.schema([("chunk", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()),
                   ("carry", pa.list_(pa.string()))])
CHUNK_DDL = "chunk long, ids binary, sizes binary, text binary, carry array<string>"


def _pack(chunk_bytes: int):
    """Rows of about ``chunk_bytes`` of text with the ids and sizes of their documents."""
    return lambda batches: _packed(batches, chunk_bytes)


def _packed(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    base, made = TaskContext.get().partitionId() << 32, 0
    ids, texts, carry, size = [], [], [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([base + made], pa.int64()), pa.array([np.array(ids, "<i8").tobytes()]),
            pa.array([np.array([len(t) for t in texts], "<i8").tobytes()]), pa.array([b"".join(texts)], pa.binary()), pa.array([carry], pa.list_(pa.string()))], schema=CHUNK)

    for batch in batches:
        for doc_id, text, rest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "carry"))):
            carry.append(rest)
            ids.append(LAST_ID if doc_id is None else doc_id)
            texts.append((text or "").encode("utf-8", "surrogatepass"))
            size += len(texts[-1])
            if size >= chunk_bytes:
                yield flush()
                made, ids, texts, carry, size = made + 1, [], [], [], 0
    if ids:
        yield flush()


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


class Chunk:
    """Documents of one chunk and the runs of windows that share a key."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes):
        self.ids, self.sizes = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8")
        self.text = np.frombuffer(text, np.uint8)
        self.ends = np.cumsum(self.sizes)
        found = [self._runs(at) for at in range(0, max(len(self.text) - LENGTH + 1, 0), BLOCK)]
        self.start = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        self.count = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        self.key = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.uint64)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.unique, self.inverse = np.unique(self.key, return_inverse=True)

    def _runs(self, at: int):
        """Runs of windows that start in one block: first window, number of windows, 48-bit key."""
        data = self.text[at:at + BLOCK + LENGTH - 1]
        n = len(data)
        up, down = powers(BLOCK * 2)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        least = _least(mix((total[GRAM:] - total[:-GRAM]) * down[:n - GRAM + 1]), SPAN)
        first = np.arange(at, at + len(least))
        doc = np.searchsorted(self.ends, first, side="right")
        inside = first + LENGTH <= self.ends[doc]
        cut = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])]
        starts = np.flatnonzero(cut)
        counts = np.diff(np.append(starts, len(least)))
        # A key can stay for longer than one gram's reach in periodic text; strings are cut to fit.
        extra = (counts - 1) // SPAN
        if extra.any():
            more = np.repeat(starts, extra + 1) + SPAN * (np.arange((extra + 1).sum()) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1))
            counts = np.minimum(np.repeat(starts + counts, extra + 1) - more, SPAN)
            starts = more
        keep = inside[starts]
        starts, counts = starts[keep], counts[keep]
        return starts + at, counts, least[starts] >> np.uint64(16)

    def strings(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Padded rows of the bytes behind runs."""
        out = np.zeros((len(start), WIDTH), np.uint8)
        inside = np.arange(WIDTH)[None, :] < size[:, None]
        at = (start[:, None] + np.arange(WIDTH)[None, :])[inside]
        out[inside] = self.text[at]
        return out


KEYS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])


def _by_bucket(chunk: Chunk, buckets: int):
    """Unique keys dealt to buckets: order, and the bounds of each bucket."""
    home = (chunk.unique % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(buckets + 1))


def _keys(buckets: int):
    """Each key of a chunk once, with the number of its documents there (255: that many or more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["ids"], row["sizes"], row["text"])
                order, ends = _by_bucket(chunk, buckets)
                pair = np.unique(chunk.inverse.astype(np.int64) * len(chunk.ids) + chunk.doc) // max(len(chunk.ids), 1)
                docs = np.minimum(np.bincount(pair, minlength=len(chunk.unique)), 255).astype(np.uint8)
                keys, docs = chunk.unique[order], docs[order]
                six = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                rows = {"bucket": [], "chunk": [], "keys": [], "docs": []}
                for b in range(buckets):
                    if ends[b] < ends[b + 1]:
                        rows["bucket"].append(b)
                        rows["chunk"].append(row["chunk"])
                        rows["keys"].append(six[ends[b]:ends[b + 1]].tobytes())
                        rows["docs"].append(docs[ends[b]:ends[b + 1]].tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=KEYS)
    return run


MASKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("answer", pa.binary())])
MASKS_DDL = "chunk long, bucket int, answer binary"


def _repeated(hot: int):
    """For each key of each chunk: 0 known in one document only, 1 in several, 2 in more than ``hot``."""
    return lambda table: _states(table, hot)


def _states(table: pa.Table, hot: int) -> pa.Table:
    sent = [np.frombuffer(k, np.uint8).reshape(-1, 6) for k in table.column("keys").to_pylist()]
    sizes = [len(s) for s in sent]
    keys = np.zeros((sum(sizes), 8), np.uint8)
    keys[:, :6] = np.concatenate(sent)
    keys = keys.view("<u8").ravel()
    docs = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.uint8)
    unique, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, docs, len(unique))
    state = ((total > 1).astype(np.uint8) + (total > hot))[inverse].astype(np.uint8)
    ends = np.cumsum([0] + sizes)
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "answer": pa.array([state[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())}, schema=MASKS)


def _digest(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of padded strings; the size tells padding from zero bytes."""
    words = rows.view("<u8")
    out = size.astype(np.uint64)
    for k in range(words.shape[1]):
        out = mix(out + words[:, k] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return out


class Wanted:
    """The strings a chunk asks about, each once, in an order that any pass over the chunk finds again."""

    def __init__(self, chunk: Chunk, answers: list[dict], buckets: int):
        order, ends = _by_bucket(chunk, buckets)
        state = np.zeros(len(chunk.unique), np.uint8)
        for a in answers:
            state[order[ends[a["bucket"]]:ends[a["bucket"] + 1]]] = np.frombuffer(a["answer"], np.uint8)
        state = state[chunk.inverse]
        run = np.flatnonzero(state == 1)
        # A hot key's windows go one by one, dealt by their own bytes.
        hot = np.flatnonzero(state == 2)
        windows = chunk.count[hot]
        each = np.repeat(chunk.start[hot] - np.cumsum(windows) + windows, windows) + np.arange(windows.sum())
        self.start = np.concatenate((chunk.start[run], each))
        self.count = np.concatenate((chunk.count[run], np.ones(len(each), np.int64)))
        self.doc = np.concatenate((chunk.doc[run], np.repeat(chunk.doc[hot], windows)))
        size = self.count + LENGTH - 1
        rows = chunk.strings(self.start, size)
        digest = _digest(rows, size)
        key = np.concatenate((chunk.key[run], digest[len(run):] >> np.uint64(16)))
        sort = np.lexsort((digest, key, key % np.uint64(buckets)))
        rows, digest, key, size = rows[sort], digest[sort], key[sort], size[sort]
        fresh = np.ones(len(sort), bool)
        if len(sort):
            fresh[1:] = (digest[1:] != digest[:-1]) | (key[1:] != key[:-1]) | (size[1:] != size[:-1]) | (rows[1:] != rows[:-1]).any(axis=1)
        self.which = np.empty(len(sort), np.int64)  # string of each occurrence
        self.which[sort] = np.cumsum(fresh) - 1
        self.rows, self.key = rows[fresh], key[fresh]
        self.size = size[fresh].astype(np.uint8)
        self.least = np.full(len(self.rows), LAST_ID)
        np.minimum.at(self.least, self.which, chunk.ids[self.doc])
        self.ends = np.searchsorted((self.key % np.uint64(buckets)).astype(np.int64), np.arange(buckets + 1))


STRINGS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64())] + [(c, pa.binary()) for c in ("keys", "sizes", "bytes", "least")])
STRINGS_DDL = "bucket int, chunk long, keys binary, sizes binary, bytes binary, least binary"


def _strings(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = Wanted(Chunk(row["ids"], row["sizes"], row["text"]), row["answers"] or [], buckets)
                rows = {c: [] for c in STRINGS.names}
                for b in range(buckets):
                    at = slice(asked.ends[b], asked.ends[b + 1])
                    if at.start < at.stop:
                        size = asked.size[at]
                        rows["bucket"].append(b)
                        rows["chunk"].append(row["chunk"])
                        rows["keys"].append((asked.key[at] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
                        rows["sizes"].append(size.tobytes())
                        rows["bytes"].append(asked.rows[at][np.arange(WIDTH)[None, :] < size[:, None]].tobytes())
                        rows["least"].append(asked.least[at].astype("<i8").tobytes())
                yield pa.RecordBatch.from_pydict(rows, schema=STRINGS)
    return run


def smallest_documents(rows: np.ndarray, size: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of the strings: its string, its start, and the smallest document of all equal windows.

    The strings are dealt to shards; each shard's transform is built on its
    own and the shards are merged by interleave refinement.
    """
    deal = np.arange(len(rows)) % SHARDS
    order = np.argsort(deal, kind="stable")
    rows, size, least = rows[order], size[order], least[order]
    parts = [transform(rows[deal[order] == s], size[deal[order] == s]) for s in range(SHARDS) if np.any(deal == s)]
    string, start = merge(parts, LENGTH)
    string, start, interval = common_prefix_intervals(rows, string, start, size, LENGTH)
    best = np.minimum.reduceat(least[string], np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]]))[interval]
    return order[string], start, best


def _answers(table: pa.Table) -> pa.Table:
    """Per string of each chunk the runs of windows with one smallest document."""
    size = np.frombuffer(b"".join(table.column("sizes").to_pylist()), np.uint8).astype(np.int64)
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), "<u4")
    least = np.frombuffer(b"".join(table.column("least").to_pylist()), "<i8")
    rows = np.zeros((len(size), WIDTH), np.uint8)
    rows[np.arange(WIDTH)[None, :] < size[:, None]] = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
    counts = [len(s) for s in table.column("sizes").to_pylist()]
    digest = _digest(rows, size)
    order = np.lexsort((digest, key))
    k, d = key[order], digest[order]
    fresh = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (size[order[1:]] != size[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(fresh) - 1
    head = order[fresh]
    s_rows, s_size, s_key = rows[head], size[head], key[head]
    s_least = np.minimum.reduceat(least[order], np.flatnonzero(fresh))
    del rows, digest
    windows = s_size - LENGTH + 1
    at = np.cumsum(windows) - windows
    best = np.repeat(s_least, windows)
    # Keys with one string are settled; the strings of the others are compared.
    group = np.cumsum(np.r_[True, s_key[1:] != s_key[:-1]]) - 1
    mixed = np.flatnonzero(np.bincount(group)[group] > 1)
    begin = 0
    while begin < len(mixed):
        end = min(begin + BATCH, len(mixed))
        while end < len(mixed) and group[mixed[end]] == group[mixed[end - 1]]:
            end += 1
        part = mixed[begin:end]
        string, start, smallest = smallest_documents(s_rows[part], s_size[part], s_least[part])
        best[at[part[string]] + start] = smallest
        begin = end
    # Runs of equal answers, string by string.
    edge = np.ones(len(best), bool)
    edge[1:] = best[1:] != best[:-1]
    edge[at] = True
    runs = np.flatnonzero(edge)
    length = np.diff(np.append(runs, len(best))).astype(np.uint8)
    per = np.add.reduceat(edge.astype(np.int64), at)
    first = np.cumsum(per) - per
    value = best[runs]
    out = []
    ends = np.cumsum([0] + counts)
    for a, b in zip(ends, ends[1:]):
        mine = which[a:b]
        n = per[mine]
        pick = np.repeat(first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out.append(np.array([len(n)], "<i8").tobytes() + n.astype(np.uint8).tobytes() + length[pick].tobytes() + value[pick].astype("<i8").tobytes())
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "answer": pa.array(out, pa.binary())}, schema=MASKS)


def removed_bytes(chunk: Chunk, asked: Wanted, answers: list[dict]) -> np.ndarray:
    """Mask of the bytes that a window of an earlier document covers."""
    windows = asked.size.astype(np.int64) - LENGTH + 1
    at = np.cumsum(windows) - windows
    best = np.repeat(asked.least, windows)
    for a in answers:
        strings = slice(asked.ends[a["bucket"]], asked.ends[a["bucket"] + 1])
        raw = a["answer"]
        n = int.from_bytes(raw[:8], "little")
        runs = np.frombuffer(raw, np.uint8, n, 8)
        total = int(runs.sum())
        length = np.frombuffer(raw, np.uint8, total, 8 + n)
        value = np.frombuffer(raw[8 + n + total:], "<i8")
        best[at[strings.start]:at[strings.start] + int(windows[strings].sum())] = np.repeat(value, length)
    # Windows of every occurrence, and whether a smaller document holds them.
    step = np.zeros(len(chunk.text) + LENGTH + 1, np.int64)
    for begin in range(0, len(asked.start), 1 << 16):
        part = slice(begin, begin + (1 << 16))
        n = asked.count[part]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        smallest = best[np.repeat(at[asked.which[part]], n) + offset]
        taken = smallest < np.repeat(chunk.ids[asked.doc[part]], n)
        first = (np.repeat(asked.start[part], n) + offset)[taken]
        if len(first):
            low = first.min()
            ends = np.bincount(first - low)
            step[low:low + len(ends)] += ends
            step[low + LENGTH:low + LENGTH + len(ends)] -= ends
    return np.cumsum(step)[:len(chunk.text)] > 0


KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.string()), ("carry", pa.string())])
KEPT_DDL = "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept string, carry string"
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
DIGESTS_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(buckets: int, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row["ids"], row["sizes"], row["text"])
                asked = Wanted(chunk, row["answers"] or [], buckets)
                gone = removed_bytes(chunk, asked, row["found"] or [])
                out = []
                for i, end in enumerate(chunk.ends.tolist()):
                    size = int(chunk.sizes[i])
                    mask, text = gone[end - size:end], chunk.text[end - size:end]
                    kept = text[~mask].tobytes()
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    doc = None if chunk.ids[i] == LAST_ID else int(chunk.ids[i])
                    line = {"doc_id": doc, "n_bytes": size, "n_removed": int(mask.sum())}
                    if digests:
                        line |= {"n_spans": len(edges) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                    else:
                        line |= {"spans": edges.reshape(-1, 2).tolist(), "kept": kept.decode("utf-8", "ignore"), "carry": row["carry"][i]}
                    out.append(line)
                yield pa.RecordBatch.from_pylist(out, schema=DIGESTS if digests else KEPT)
    return run


def without_repeats(documents: DataFrame, digests: bool = False, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans, kept, carry.

    A byte goes if a 50-byte string that covers it also starts in a document
    with a smaller doc_id, judged on the input.  ``spans`` lists the maximal
    removed runs as [start, end) bytes and ``kept`` is the text of the other
    bytes, without parts of characters that a cut left behind; with ``digests``
    the number of runs and the SHA-256 of the kept bytes are returned instead.  Null text is empty; texts
    under 50 bytes keep everything.  Rows with one doc_id do not shorten each
    other, and a null id counts as larger than all others.  Matches never cross
    documents.  Other columns are not carried.
    """
    spark = documents.sparkSession
    name = f"llm_chunks_{uuid.uuid4().hex}"
    width = partitions(spark)
    carry = F.col("carry").cast("string").alias("carry") if "carry" in documents.columns and not digests else F.lit(None).cast("string").alias("carry")
    packed = documents.select("doc_id", "text", carry).mapInArrow(_pack(chunk_bytes), CHUNK_DDL)
    packed.write.format("parquet").option("compression", "zstd").option("path", f"{shared_folder(spark)}/llm/{name}").bucketBy(width, "chunk").saveAsTable(name)
    chunks = spark.table(name)
    buckets = 4 * width

    masks = chunks.mapInArrow(_keys(buckets), "bucket int, chunk long, keys binary, docs binary").groupBy("bucket").applyInArrow(_repeated(hot), MASKS_DDL)

    def per_chunk(answers: DataFrame, column: str) -> DataFrame:
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))

    asked = chunks.join(per_chunk(masks, "answers").hint("shuffle_hash"), "chunk", "left")
    found = asked.mapInArrow(_strings(buckets), STRINGS_DDL).groupBy("bucket").applyInArrow(_answers, MASKS_DDL)
    answered = asked.join(per_chunk(found, "found").hint("shuffle_hash"), "chunk", "left")
    return answered.mapInArrow(_cut(buckets, digests), DIGESTS_DDL if digests else KEPT_DDL)
