"""SentencePiece encoding and decoding with an Aho-Corasick automaton.

The automaton holds all pieces.  One pass over the text yields, at each
position, every piece that ends there (the node's own and those behind its
output links), and each of them relaxes the best score of that position.  The
path of best total score is the encoding.  Characters outside the vocabulary
become byte pieces, so decoding gives back every text exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

SPACE = "▁"
CACHE = 1 << 18
NEVER = -1e300
_LOADED: dict[str, "Codec"] = {}


class Codec:
    """Pieces, scores and automaton of one model file; built once per worker."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int]):
        """``pieces`` lists (text, score) by id, text empty where the id is not a plain piece."""
        self.pieces, self.byte_ids = pieces, byte_ids
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.automaton = ahocorasick.Automaton()
        plain = [(text, i, score) for i, (text, score) in enumerate(pieces) if text]
        for text, i, score in plain:
            self.automaton.add_word(text, (len(text), i, score))
        self.automaton.make_automaton()
        self.single = {text for text, _, _ in plain if len(text) == 1}
        self.unknown = min((s for _, _, s in plain), default=0.0) - 10.0
        # A word mark inside a piece would tie neighbouring words together.
        self.apart = not any(SPACE in text.lstrip(SPACE) for text, _, _ in plain)
        self.words = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.known: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> Codec:
        if path not in _LOADED:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces, byte_ids = [], []
            for i in range(sp.get_piece_size()):
                special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)
                pieces.append(("" if special else sp.id_to_piece(i), sp.get_score(i)))
                if sp.is_byte(i):
                    byte_ids.append(i)
            if len(byte_ids) != 256:
                raise ValueError("the model needs a byte piece for every byte")
            _LOADED[path] = cls(pieces, byte_ids)
        return _LOADED[path]

    def best_path(self, text: str) -> list[int]:
        """Ids of the best-scoring segmentation; of equal scores the one with the longer last piece."""
        n = len(text)
        best, back = [NEVER] * (n + 1), [None] * (n + 1)
        best[0] = 0.0
        strange = [i for i, c in enumerate(text) if c not in self.single] if not self.single.issuperset(text) else []
        at = 0
        for end, (size, piece, score) in self.automaton.iter(text):
            while at < len(strange) and strange[at] <= end:
                self._unknown(best, back, strange[at])
                at += 1
            reached = best[end + 1 - size] + score
            if reached > best[end + 1]:
                best[end + 1], back[end + 1] = reached, (size, piece)
        for i in strange[at:]:
            self._unknown(best, back, i)
        out = []
        while n:
            size, piece = back[n]
            if piece < 0:
                out.extend(self.byte_ids[b] for b in reversed(text[n - 1].encode("utf-8", "surrogatepass")))
            else:
                out.append(piece)
            n -= size
        out.reverse()
        return out

    def _unknown(self, best: list, back: list, i: int) -> None:
        if best[i] + self.unknown > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + self.unknown, (1, -1)

    def _segment(self, text: str) -> list[int]:
        if not self.apart:
            return self.best_path(text)
        known, out = self.known, []
        for word in self.words.findall(text):
            ids = known.get(word)
            if ids is None:
                ids = self.best_path(word)
                if len(word) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a text; a literal word mark is kept apart from a blank by its bytes."""
        if not text:
            return []
        shown = SPACE + text.replace(" ", SPACE)
        if SPACE not in text:
            return self._segment(shown)
        out: list[int] = []
        mark = [self.byte_ids[b] for b in SPACE.encode()]
        for k, part in enumerate(text.split(SPACE)):
            part = part.replace(" ", SPACE)
            out += mark * (k > 0) + self._segment(SPACE + part if k == 0 else part)
        return out

    def decode(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw = bytearray()
            out.append(self.pieces[i][0].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "surrogatepass"))
        return "".join(out)[1:]


def encode_texts(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per input row: doc_id, ids.

    Null text gives a null array, empty text an empty one.  Repeated rows and
    null ids are rows of their own; other columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in batches:
            ids = [None if t is None else codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, model_path: str) -> DataFrame:
    """The texts of encoded rows: doc_id, text (null where ids are null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


CODED = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32())),
                   ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def coded_documents(documents: DataFrame, model_path: str) -> DataFrame:
    """One row per input row: doc_id, n_chars, n_pieces, ids, ids_sha256, decoded_sha256.

    ``ids_sha256`` digests the ids as 32-bit little-endian numbers and
    ``decoded_sha256`` the decoded text as UTF-8, which equals the digest of
    the text itself.  Null text counts as empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [np.array(codec.encode(t), np.int32) for t in texts]
            back = [hashlib.sha256(codec.decode(i.tolist()).encode("utf-8", "surrogatepass")).hexdigest() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array([hashlib.sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids]), pa.array(back)], schema=CODED)

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_chars long, n_pieces long, ids array<int>, ids_sha256 string, decoded_sha256 string")
