"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, all with the same slots and hash functions, is
stored slot by slot as a bitmask of languages.  Looking up an n-gram ANDs the
masks of its slots and gives at once every language whose filter holds it.
The popcount of each language over a text, corrected for the filter's rate of
false positives, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (2, 3, 4)
SLOT_BITS = 20
HASHES = 3
WORD = 62  # languages per mask word
PIECE = 1 << 20
UNDECIDED = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _runs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the padded texts, other characters than letters as one blank, and the text each belongs to.

    Pieces of a long text overlap by the longest n-gram less one; a piece's
    own part is marked by non-negative owners.
    """
    parts, owners, size = [], [], 0
    table = letters()
    for i, text in enumerate(texts):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.concatenate((np.array([32], np.uint32), np.where(table[points], points, np.uint32(32)), np.array([32], np.uint32)))
        for at in range(0, len(points), PIECE):
            piece = points[at:at + PIECE + max(ORDERS) - 1]
            parts.append(piece)
            owners.append(np.full(len(piece), i, np.int64))
            if len(piece) > PIECE:
                owners[-1][PIECE:] = -1 - i
            size += len(piece)
            if size >= PIECE:
                yield np.concatenate(parts), np.concatenate(owners)
                parts, owners, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.concatenate(owners)


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """64-bit hashes of all character n-grams, and the text each stands in."""
    for points, owner in _runs(texts):
        whose = np.where(owner < 0, -1 - owner, owner)
        blank = points == 32
        for n in ORDERS:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ points[k:k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ok = (owner[:m] >= 0) & (whose[:m] == whose[n - 1:]) & ~(blank[:m] & blank[1:m + 1])
            h = h[ok] * np.uint64(0xBF58476D1CE4E5B9)
            yield h ^ (h >> np.uint64(32)), whose[:m][ok]


COUNTS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("c", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, index = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
        for h, whose in grams(batch.column("text").to_pylist()):
            lang = index[whose]
            for k, name in enumerate(langs):
                g, c = np.unique(h[lang == k], return_counts=True)
                if len(g):
                    yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(g)), pa.array(g.view(np.int64)), pa.array(c.astype(np.int64))], schema=COUNTS)


def held_out(doc_id: Column) -> Column:
    """True for ids whose crc32, as text, leaves 1 modulo 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


class Filters:
    """The learned languages and their bit-sliced filters; the size depends on neither rows nor texts."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        self.chance = np.array([((masks[i // WORD] >> np.int64(i % WORD)) & 1).mean() ** HASHES for i in range(len(languages))])

    def hits(self, h: np.ndarray) -> list[np.ndarray]:
        """Bitmask words of the languages that hold each n-gram."""
        slots = [((h >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(HASHES)]
        out = []
        for word in self.masks:
            mask = word[slots[0]]
            for s in slots[1:]:
                mask &= word[s]
            out.append(mask)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Corrected popcount of each language over each text."""
        total = np.zeros(len(texts))
        found = np.zeros((len(self.languages), len(texts)))
        for h, whose in grams(texts):
            total += np.bincount(whose, minlength=len(texts))
            words = self.hits(h)
            for i in range(len(self.languages)):
                bit = (words[i // WORD] >> np.int64(i % WORD)) & 1
                found[i] += np.bincount(whose, weights=bit, minlength=len(texts))
        chance = self.chance[:, None]
        return np.maximum(0, (found - chance * total) / np.maximum(1 - chance, 1e-9))


def fit(documents: DataFrame, fit_rows: int = 4000, floor: float = 2e-5, share: float = 0.2) -> Filters:
    """Learn filters from labelled rows outside the held-out third.

    About ``fit_rows`` rows of each language are used, chosen by a hash of the
    id (all rows where there are fewer).  An n-gram enters a language's filter
    if its rate there is at least ``floor`` and at least ``share`` of its
    highest rate in any language.
    """
    spark = documents.sparkSession
    rows = documents.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = sorted(sizes, key=lambda name: (-sizes[name], name))
    if not languages:
        return Filters([], np.zeros((1, 1 << SLOT_BITS), np.int64))
    odds = F.create_map(*[F.lit(x) for name in languages for x in (name, int(min(1.0, fit_rows / sizes[name]) * (1 << 30)))])
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(17)), F.lit(1 << 30))
    sample = rows.filter(draw < F.try_element_at(odds, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(_count, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    totals = {r["lang"]: r["c"] for r in sample.mapInArrow(_sizes, "lang string, c long").groupBy("lang").agg(F.sum("c").alias("c")).collect()}
    whole = F.create_map(*[F.lit(x) for name in languages for x in (name, float(max(totals.get(name, 0), 1)))])
    index = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    rates = counts.withColumn("r", F.col("c") / F.try_element_at(whole, F.col("lang"))).filter(F.col("r") >= floor)
    rates = rates.groupBy("g").agg(F.collect_list(F.struct("lang", "r")).alias("_l"), F.max("r").alias("_m"))
    kept = rates.select("g", F.explode("_l").alias("_l"), "_m").filter(F.col("_l.r") >= share * F.col("_m"))
    kept = kept.select("g", F.try_element_at(index, F.col("_l.lang")).alias("i"))
    slots = kept.select("i", F.explode(F.array(*[
        F.shiftrightunsigned("g", k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") for k in range(HASHES)])).alias("slot"))
    words = slots.groupBy((F.col("i") / WORD).cast("int").alias("w"), "slot").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % WORD)).alias("mask"))
    got = words.toArrow()  # at most one row per slot
    masks = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), np.int64)
    masks[got.column("w").to_numpy(), got.column("slot").to_numpy()] = got.column("mask").to_numpy()
    return Filters(languages, masks)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(t) * len(ORDERS) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(n, pa.int64())], ["lang", "c"])


def predict(documents: DataFrame, filters: Filters, carry: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score; with ``carry`` also ``lettered``,
    whether the text has a letter, and the input row as struct ``row``.

    The score is the winner's share of all corrected popcounts.  Null text and
    text without a letter give ``und`` and 0; so does everything if nothing
    was learned.  Where no n-gram is known, or at a tie, the language with more
    training rows wins (score 0 if nothing is known).  Repeated rows and null
    ids are rows of their own; other columns are not carried.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast((filters.languages, filters.masks))  # fixed size, see Filters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Filters(*sent.value)
        table = letters()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            known = [bool(table[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")].any()) for t in texts]
            names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
            if model.languages and texts:
                points = model.scores(texts)
                best, total = points.argmax(axis=0), points.sum(axis=0)
                for i in range(len(texts)):
                    if known[i]:
                        names[i] = model.languages[best[i]]
                        scores[i] = float(points[best[i], i] / total[i]) if total[i] > 0 else 0.0
            rest = [("lettered", pa.array(known, pa.bool_())), ("row", batch.column("row"))] if carry else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *(v for _, v in rest)],
                ["doc_id", "held_out", "lang_pred", "score", *(c for c, _ in rest)])

    rows = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", *([F.struct("*").alias("row")] if carry else []))
    shape = T.StructType.fromDDL("doc_id long, held_out boolean, lang_pred string, score double")
    return rows.mapInArrow(run, T.StructType(shape.fields + ([T.StructField("lettered", T.BooleanType()), rows.schema["row"]] if carry else [])))
