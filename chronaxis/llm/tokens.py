"""Token counts of whole texts by overlap resynchronisation.

Ordinary texts are encoded in one call.  A huge text is cut into overlapping
chunks that are encoded on their own, with offsets, in different tasks.  Two
neighbours are spliced at a token boundary that both of them found inside
their overlap and that is proven stable: no piece of the vocabulary holds the
two characters around it next to each other, so no merge can ever cross it and
the tokens on either side do not depend on the other side.  Where neighbours
share no such boundary the text is encoded again with a wider overlap, at the
end as one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import persisted

SPACE = "▁"
_LOADED: dict[str, tuple] = {}


def _model(path: str):
    """The processor and the character pairs that stand inside some piece; loaded once per worker."""
    if path not in _LOADED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inside = set()
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                inside.update(zip(piece, piece[1:]))
        _LOADED[path] = sp, inside
    return _LOADED[path]


def model_is_local(path: str) -> bool:
    """True if the model leaves characters as they are, so that pairs of raw characters decide."""
    sp, _ = _model(path)
    probes = ["a  b", "ＡéΩ", "x\ty\n", "é"]
    return all(sp.normalize(p).removeprefix(SPACE) == p.replace(" ", SPACE) for p in probes)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, _ = _model(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [len(ids) for ids in sp.encode(texts, num_threads=1)] if texts else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    return run


def _chunks(size: int, overlap: int):
    """Cut texts into windows of ``size`` characters plus the overlap on either side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "k", "last", "start", "text"]
        for batch in batches:
            for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist()):
                n = 1 if 2 * overlap >= len(text) else -(-len(text) // size)
                step = len(text) if n == 1 else size
                for k in range(n):
                    start = max(0, k * step - overlap)
                    piece = text[start:(k + 1) * step + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([h]), pa.array([k], pa.int64()), pa.array([k == n - 1]), pa.array([start], pa.int64()), pa.array([piece])], names)
    return run


def _encode(path: str, size: int, overlap: int):
    """Stable token boundaries in both overlaps of a window, each with the tokens before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, inside = _model(path)
        for batch in batches:
            out = {"h": [], "k": [], "last": [], "total": [], "left": [], "left_n": [], "right": [], "right_n": []}
            for row in batch.to_pylist():
                text, start = row["text"], row["start"]
                tokens = sp.encode(text, return_type="offset_mapping")["offsets"]
                mid = row["k"] * size
                zones = {"left": (mid - overlap, mid + overlap), "right": (mid + size - overlap, mid + size + overlap)}
                found = {"left": ([], []), "right": ([], [])}
                shown = text.replace(" ", SPACE)
                for n, (at, _) in enumerate(tokens):
                    where = start + at
                    for zone, (lo, hi) in zones.items():
                        if lo <= where <= hi and 0 < at < len(text) and (shown[at - 1], shown[at]) not in inside:
                            spots, counts = found[zone]
                            if not spots or spots[-1] != where:
                                spots.append(where)
                                counts.append(n)
                out["h"].append(row["h"])
                out["k"].append(row["k"])
                out["last"].append(row["last"])
                out["total"].append(len(tokens))
                for zone in zones:
                    out[zone].append(found[zone][0])
                    out[f"{zone}_n"].append(found[zone][1])
            yield pa.RecordBatch.from_pydict(out, schema=ENCODED_ARROW)
    return run


ENCODED = "h string, k long, last boolean, total long, left array<long>, left_n array<long>, right array<long>, right_n array<long>"
ENCODED_ARROW = pa.schema([("h", pa.string()), ("k", pa.int64()), ("last", pa.bool_()), ("total", pa.int64())]
                          + [(c, pa.list_(pa.int64())) for c in ("left", "left_n", "right", "right_n")])


def spliced(long_texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """One row per text: h, n_tokens; n_tokens is null where two neighbours share no stable boundary."""
    cut = long_texts.select("h", "text").mapInArrow(_chunks(size, overlap), "h string, k long, last boolean, start long, text string")
    coded = cut.repartition(F.col("h"), F.col("k")).mapInArrow(_encode(path, size, overlap), ENCODED)
    w = Window.partitionBy("h").orderBy("k")
    common = F.array_intersect("right", F.lead("left").over(w))
    cuts = coded.withColumn("_end", F.when(~F.col("last"), F.try_element_at(common, F.lit(1))))
    cuts = cuts.withColumn("_begin", F.lag("_end").over(w))
    upto = F.when(F.col("last"), F.col("total")).otherwise(F.try_element_at("right_n", F.array_position("right", F.col("_end")).cast("int")))
    before = F.when(F.col("k") == 0, F.lit(0)).otherwise(F.try_element_at("left_n", F.array_position("left", F.col("_begin")).cast("int")))
    own = cuts.select("h", (upto - before).alias("_own"))
    return own.groupBy("h").agg(F.when(F.count("_own") == F.count(F.lit(1)), F.sum("_own")).alias("n_tokens"))


def token_counts(documents: DataFrame, model_path: str, size: int = 16384, overlap: int = 128, limit: int = 4096) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty (0 bytes, 0 tokens).  Repeated rows and null ids
    are rows of their own; equal huge texts are encoded once.  Other columns
    are not carried.  Texts of up to two chunks are encoded in one call.  A
    model that rewrites characters has no provable boundaries in the raw text,
    so its texts are encoded whole.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = "doc_id long, n_bytes long, n_tokens long"
    huge = F.length("text") > 2 * size
    if not model_is_local(model_path):
        out = docs.mapInArrow(_count(model_path), counted)
        return out.withColumn("over_limit", F.col("n_tokens") > limit)
    short = docs.filter(~huge).mapInArrow(_count(model_path), counted)
    keyed = docs.filter(huge).withColumn("h", F.sha2("text", 256))
    pending = keyed.select("h", "text").dropDuplicates(["h"])
    done, width = None, overlap
    while True:
        result = persisted(spliced(pending, model_path, size, width), "token-counts")
        good = result.filter(F.col("n_tokens").isNotNull())
        done = good if done is None else done.unionByName(good)
        failed = result.filter(F.col("n_tokens").isNull()).select("h")
        if failed.isEmpty():
            break
        width *= 8
        pending = keyed.select("h", "text").join(failed, "h", "left_semi").dropDuplicates(["h"])
    long = keyed.select("doc_id", "n_bytes", "h").join(done, "h").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)
