"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Paragraphs are lines, cut further at content-defined points.  Every paragraph is hashed to a wide vector and a document's fingerprint is the
sum of its paragraphs' vectors, lane by lane modulo a power of two.  Order does
not matter, and a paragraph is inserted or deleted by adding or subtracting its
vector.  Three groups of lanes:

* 8 lanes mod 2^64, uniform: equal sums mean equal multisets;
* 2 lanes mod 2^64: number of paragraphs, and their weight in code points;
* 128 lanes mod 2^16 holding + or - the root of the paragraph's weight: the
  squared length of the difference of two fingerprints estimates the weight of
  the paragraphs that only one of them has, which gives a likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

STRONG, SIGNS = 8, 128
WINDOW, CUT_BITS = 8, 6  # code points that decide on a cut; one place in 2^CUT_BITS is one
BLOCK = 1 << 20  # code points hashed at a time
_BITS = SIGNS // 8


class Sums:
    """Running sums of paragraph vectors."""

    __slots__ = ("count", "signs", "strong", "weight")

    def __init__(self):
        self.strong = np.zeros(STRONG, np.uint64)
        self.count = 0
        self.weight = 0
        self.signs = np.zeros(SIGNS, np.int64)

    def copy(self) -> Sums:
        out = Sums()
        out.strong, out.count, out.weight, out.signs = self.strong.copy(), self.count, self.weight, self.signs.copy()
        return out

    def add(self, paragraphs: Iterable[str], sign: int = 1) -> Sums:
        """Insert paragraphs, or delete them with ``sign=-1``."""
        paragraphs = list(paragraphs)
        for at in range(0, len(paragraphs), 4096):
            self._add(paragraphs[at:at + 4096], sign)
        return self

    def _add(self, paragraphs: list[str], sign: int) -> None:
        digests, marks, sizes = [], [], []
        for p in paragraphs:
            raw = p.encode("utf-8", "surrogatepass")
            digests.append(hashlib.blake2b(raw, digest_size=8 * STRONG).digest())
            marks.append(hashlib.blake2b(raw, digest_size=_BITS, person=b"signs").digest())
            sizes.append(len(p))
        strong = np.frombuffer(b"".join(digests), "<u8").reshape(-1, STRONG).sum(axis=0, dtype=np.uint64)
        roots = np.array([isqrt(n) for n in sizes], np.float64)
        bits = np.unpackbits(np.frombuffer(b"".join(marks), np.uint8).reshape(-1, _BITS), axis=1)
        signs = (2 * (roots @ bits) - roots.sum()).astype(np.int64)  # whole numbers far below 2^53
        if sign > 0:
            self.strong += strong
        else:
            self.strong -= strong
        self.count += sign * len(paragraphs)
        self.weight += sign * sum(isqrt(n) ** 2 for n in sizes)
        self.signs += sign * signs

    def text(self) -> str:
        """The fingerprint as base64 of all lanes."""
        lanes = self.strong.astype("<u8").tobytes() + np.array([self.count % 2**64, self.weight % 2**64], "<u8").tobytes()
        return base64.b64encode(lanes + self.signs.astype("<u2").tobytes()).decode()


def parse(fingerprint: str) -> tuple[bytes, int, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    weight = int.from_bytes(raw[8 * STRONG + 8:8 * STRONG + 16], "little")
    return raw, weight, np.frombuffer(raw[8 * STRONG + 16:], "<u2")


def likeness(a: str, b: str) -> float:
    """Share of the two documents' weight in common paragraphs, estimated from fingerprints alone (0 to 1)."""
    if a == b:
        return 1.0
    (_, wa, sa), (_, wb, sb) = parse(a), parse(b)
    apart = (sa - sb).view(np.int16).astype(np.float64)
    return float(min(1.0, max(0.0, 1.0 - (apart @ apart / SIGNS) / max(wa + wb, 1))))


def _cuts(text: str) -> list[int]:
    """Where lines are cut by content: where a hash of the last ``WINDOW`` code points of the line says so."""
    out = []
    for base in range(0, len(text) - WINDOW + 1, BLOCK):
        code = np.frombuffer(text[base:base + BLOCK + WINDOW - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(code) - WINDOW + 1, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(0x01000193)
            h += code[k:k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        ends = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + (base + WINDOW)
        out += [i for i in ends.tolist() if "\n" not in text[i - WINDOW:i]]
    return out


def _pieces(text: str) -> list[str]:
    """Lines, long ones in pieces; a piece that its line continues ends in a newline, which no line holds."""
    out, start = [], 0
    for cut in _cuts(text):
        lines = text[start:cut].split("\n")
        lines[-1] += "\n"
        out += lines
        start = cut
    return out + text[start:].split("\n")


def paragraphs(text: str) -> list[str]:
    """Paragraphs of the text: its lines, cut further at content-defined points; an empty text has none.

    A cut follows from the code points just before it in its line (one place in
    2^CUT_BITS on average), so an edit changes the paragraphs it touches only,
    also in a text without any newline.
    """
    return _pieces(text) if text else []


def fingerprint(text: str) -> str:
    return Sums().add(paragraphs(text)).text()


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                 ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
OUT_DDL = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _edit(text: str, following: str, own: Sums) -> tuple[str, Sums]:
    """Replace the last third by the head of the next text; only changed paragraphs are hashed again."""
    m = len(text) // 3
    kept = text[:len(text) - m]
    edited = kept + following[:m]
    if m == 0:
        return edited, own
    whole = kept.rfind("\n") + 1  # paragraphs that end before here stay
    sums = own.copy().add(_pieces(text[whole:]), -1)
    return edited, sums.add(_pieces(edited[whole:]))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by range and position; a row is answered when its successor is known."""
    last = None
    for batch in batches:
        rows = []
        for bucket, copy, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "copy", "doc_id", "text"))):
            sums = Sums().add(paragraphs(text))
            mark = sums.text()
            if last is not None and last[0] == bucket:
                rows.append(_answer(last, text, mark))
            last = None if copy else (bucket, doc_id, text, sums, mark)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=OUT)


def _answer(row, following: str, next_mark: str) -> dict:
    _, doc_id, text, sums, mark = row
    edited, edited_sums = _edit(text, following, sums)
    edited_mark = edited_sums.text()
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
            "fingerprint": mark, "edited_fingerprint": edited_mark, "near_edited": likeness(mark, edited_mark), "near_next": likeness(mark, next_mark)}


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one before it in ascending doc_id, and the first
    one follows the last, so a single document follows itself.  Null text is
    empty; null ids come last; rows with one id are ordered by text.  The rows
    are dealt into id ranges, so text moves once; only the first row of each
    range is copied, to the range before it.  Other columns are not carried.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * partitions(spark)
    known = documents.select("doc_id").dropna()
    # At most one bound per range, whatever the size of the table.
    bounds = sorted(set(known.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) or [0.0]
    # Ranges are numbered by descending id; null ids get the last number.
    splits = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_id", outputCol="_range", handleInvalid="keep")

    def ranged(df: DataFrame) -> DataFrame:
        out = splits.transform(df.withColumn("_id", F.col("doc_id").cast("double")))
        return out.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(bounds) + 1).otherwise(F.lit(len(bounds)) - F.col("_range")).cast("int")).drop("_id", "_range")

    # The largest id of each range: one row per range, so its size is bounded by the partitions.
    heads = [tuple(r) for r in ranged(documents.select("doc_id")).groupBy("bucket").agg(F.max("doc_id")).orderBy("bucket").collect()]
    donors = spark.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "_head long, _to int")
    dealt = ranged(docs).join(F.broadcast(donors), F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    there = F.struct(F.col("_to").alias("bucket"), F.lit(True).alias("copy"))
    dealt = dealt.withColumn("_at", F.explode(F.when(F.col("_to").isNull(), F.array(here)).otherwise(F.array(here, there))))
    dealt = dealt.select("_at.bucket", "_at.copy", "doc_id", "text")
    ordered = dealt.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), "text")
    return ordered.mapInArrow(_walk, OUT_DDL)
