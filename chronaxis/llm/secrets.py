"""Secret scan: fixed patterns, extended by a linear-chain conditional random field.

Patterns give the base spans.  They also label a bounded sample of windows, on
which the field is trained by likelihood: tags begin, inside and outside over
tokens, with features of the token's shape, of its neighbours and of the file
it stands in.  In the training windows values are also exchanged for random
ones of other alphabets, and set into other places, so that the field learns
contexts and shapes that the patterns do not name.  Viterbi decodes every whole
text; what it finds beside the base spans is added as kind ``crf``.

Most text is plainly outside.  A run of secret tokens can only be part of the
best path if the sum of its tokens' gains over outside is positive; positions
that no such run covers are left out, which changes no tag, and the recursion
runs over the islands that remain.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persisted

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
STEMS = ("passw", "secret", "token", "api")
TOKEN = re.compile(r"[\w+/.-]+|[^\s\w+/.-]+")
OUT, BEGIN, IN = 0, 1, 2
BITS = 16
REACH = 12  # tokens on either side of a training window
NEVER = -1e4
VOCABULARY = 1 << 17  # tokens whose scores a worker keeps


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, in order of start, then kind."""
    out = []
    low = text.lower()
    if any(stem in low for stem in STEMS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs are maximal, so a run of 24 or more begins where the pattern first fits.
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _slot(kind: np.ndarray | int, value: np.ndarray | int) -> np.ndarray:
    """Feature slot of a value of one kind."""
    h = (np.asarray(value).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(kind).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def _level(x: np.ndarray | float) -> np.ndarray:
    return np.floor(1 + np.log2(1 + np.maximum(x, 0))).astype(np.int64) * (np.asarray(x) > 0)


FILE_SIGNS = '=:"{;'
OWN = ("word", "classes", "size", "turns", "classes and size", "entropy", "classes and entropy", "digits", "capitals", "hexadecimal", "head")
NEAR = 3  # of these a neighbour knows the first ones
PREVIOUS, BEFORE, NEXT, FILE = 100, 200, 300, 400
EDGE = ""


def file_slots(text: str) -> np.ndarray:
    """Slots of signs per thousand characters, line length and accents of the text around."""
    n = max(len(text), 1)
    values = [*(_level(1000 * text.count(c) / n) for c in FILE_SIGNS), _level(n / (1 + text.count("\n"))), text.isascii()]
    return _slot(np.arange(FILE, FILE + len(values)), np.array(values))


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point (small, capital, digit, other), and whether it is a hexadecimal digit."""
    chars = [chr(c) for c in range(0x110000)]
    kinds = np.fromiter((0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 for c in chars), np.uint8, len(chars))
    return kinds, np.fromiter((c in "0123456789abcdefABCDEF" for c in chars), bool, len(chars))


def token_slots(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots of tokens as themselves (n x 11), and values by which neighbours know them (n x 3).

    Shapes are those of a token's first 64 characters.
    """
    heads = [t[:64] or " " for t in tokens]
    sizes, count = np.fromiter(map(len, tokens), np.int64, len(tokens)), np.fromiter(map(len, heads), np.int64, len(tokens))
    starts = np.cumsum(count) - count
    points = np.frombuffer("".join(heads).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(tokens)), count)
    kinds, hexes = _classes()
    kind = kinds[points]
    per = [np.add.reduceat((kind == k).astype(np.int64), starts) for k in range(4)]
    mask = sum((c > 0).astype(np.int64) << k for k, c in enumerate(per))
    turn = np.concatenate(([0], (kind[1:] != kind[:-1]) & (owner[1:] == owner[:-1]))).astype(np.int64)
    turns = np.minimum(np.add.reduceat(turn, starts), 12)
    keys = np.sort(owner << 21 | points)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    runs = np.diff(np.append(first, len(keys)))
    entropy = np.log2(count) - np.bincount(keys[first] >> 21, runs * np.log2(runs), len(tokens)) / count
    size = np.where(sizes < 6, _level(sizes), 3 + np.minimum(sizes // 6, 8))
    letters, digits = (mask & 3) > 0, (mask & 4) > 0
    word = np.fromiter((crc32(t.strip("._-").lower()[:16].encode("utf-8", "surrogatepass")) if a and not d else crc32(t.encode("utf-8", "surrogatepass")) if m == 8 and len(t) < 4 else 0
                        for t, a, d, m in zip(tokens, letters.tolist(), digits.tolist(), mask.tolist())), np.int64, len(tokens))
    hexed = (np.add.reduceat(hexes[points].astype(np.int64), starts) == count) & (sizes >= 8)
    head = np.fromiter((crc32(t[:4].encode("utf-8", "surrogatepass")) if d and len(t) >= 12 else 0 for t, d in zip(tokens, digits.tolist())), np.int64, len(tokens))
    values = np.stack([word, mask, size, turns, mask * 16 + size, (4 * entropy).astype(np.int64), mask * 32 + (2 * entropy).astype(np.int64),
                       8 * per[2] // count, 8 * per[1] // count, hexed.astype(np.int64), head], axis=1)
    values[sizes == 0] = 1 << 40  # the edge of a text
    return _slot(np.arange(len(OWN)), values), values[:, :NEAR]


def _near(role: int, values: np.ndarray) -> np.ndarray:
    return _slot(np.arange(role, role + NEAR), values)


def window_slots(tokens: list[str]) -> np.ndarray:
    """Feature slots of every token of a sequence; beyond its ends stands an edge."""
    own, values = token_slots([EDGE, EDGE, *tokens, EDGE])
    return np.concatenate((own[2:-1], _near(PREVIOUS, values[1:-2]), _near(BEFORE, values[:-3]), _near(NEXT, values[3:])), axis=1)


@dataclass
class Model:
    """Weights by feature slot and tag, and transition scores (outside to outside is zero)."""

    weights: np.ndarray
    moves: np.ndarray
    learned: bool = True
    _known: dict = field(default_factory=dict, repr=False)
    _rows: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "learned": self.learned, "_known": {}, "_rows": []}

    def _scores(self, tokens: list[str]) -> list[np.ndarray]:
        """Scores of tokens for themselves, the next, the one after that and the one before."""
        own, values = token_slots(tokens)
        return [sum(self.weights[s] for s in slots.T) for slots in (own, _near(PREVIOUS, values), _near(BEFORE, values), _near(NEXT, values))]

    def _ids(self, tokens: list[str]) -> np.ndarray:
        known = self._known
        if len(known) > VOCABULARY:
            known.clear()
        fresh = list(set(tokens).difference(known))
        if fresh:
            rows = self._scores(fresh)
            self._rows = [np.concatenate((old[:len(known)], new)) for old, new in zip(self._rows, rows)] if known else rows
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def emissions(self, texts: list[list[str]], files: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tag scores of the tokens of some texts in a row, two edges before each text and after the last; first token of each."""
        row = [EDGE, EDGE]
        first = []
        for tokens in texts:
            first.append(len(row))
            row += tokens
            row += [EDGE, EDGE]
        ids = self._ids(row)
        own, previous, before, after = self._rows
        out = own[ids]
        out[1:] += previous[ids[:-1]]
        out[2:] += before[ids[:-2]]
        out[:-1] += after[ids[1:]]
        of = np.array([self.weights[f].sum(axis=0) for f in files])
        sizes = [len(t) + 2 for t in texts]
        out[2:] += np.repeat(of, sizes, axis=0)
        out[ids == self._known[EDGE]] = [0.0, NEVER, NEVER]
        return out, np.array(first, np.int64)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """Best tags of a sequence with outside on both ends; ties go to outside."""
    best, back = [0.0, NEVER * 10, NEVER * 10], []
    m = moves.tolist()
    for row in scores.tolist():
        step = [max((best[a] + m[a][b], -a) for a in range(3)) for b in range(3)]
        back.append([-a for _, a in step])
        best = [s + row[b] for b, (s, _) in enumerate(step)]
    tag = -max((best[a] + m[a][OUT], -a) for a in range(3))[1]
    tags = []
    for before in reversed(back):
        tags.append(tag)
        tag = before[tag]
    return tags[::-1]


def covered(gains: np.ndarray) -> np.ndarray:
    """True where some run of tokens with a positive sum of gains covers the position."""
    total = np.concatenate(([0.0], np.cumsum(gains)))
    ending = total[1:] - np.minimum.accumulate(total)[:-1]
    starting = np.maximum.accumulate(total[::-1])[::-1][1:] - total[:-1]
    return ending + starting - gains > -1e-9


def decode(scores: np.ndarray, moves: np.ndarray) -> list[tuple[int, int]]:
    """Runs (first, end) of secret tokens on the best path."""
    other = scores[:, BEGIN:].max(axis=1) - scores[:, OUT]
    # What a run's transitions can add at most: one move per token, and the way in and out.
    ways = max(0.0, float(moves[OUT, BEGIN] + moves[BEGIN:, OUT].max()))
    inside = max(0.0, float(moves[BEGIN:, BEGIN:].max()))
    hot = covered(other + inside + (ways if ways > 0 else 0.0))
    edges = np.flatnonzero(np.diff(np.concatenate(([0], hot.view(np.int8), [0]))))
    out = []
    for a, b in edges.reshape(-1, 2):
        tags = viterbi(scores[a:b], moves)
        start = None
        for i, tag in enumerate([*tags, OUT]):
            if start is not None and tag != IN:
                out.append((int(a) + start, int(a) + i))
                start = None
            if tag == BEGIN:
                start = i
    return out


# --- training -------------------------------------------------------------------------------------

BASE62 = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
WINDOW = "positive boolean, rank long, tokens array<string>, tags array<int>, files array<long>"
WINDOW_ARROW = pa.schema([("positive", pa.bool_()), ("rank", pa.int64()), ("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("files", pa.list_(pa.int64()))])


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


SPAN = 400  # characters on either side in which a window's tokens are looked for


def _window(text: str, at: int, values: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens around a place and their tags, begin and inside for those that hold a value."""
    low = max(0, at - SPAN)
    found = [m for m in TOKEN.finditer(text, low, at + SPAN)]
    if low:
        found = found[1:]  # may be cut
    if not found:
        return [], []
    starts, ends = np.array([m.start() for m in found]), np.array([m.end() for m in found])
    tags = np.zeros(len(found), np.int64)
    for v, e in values:
        a, b = int(np.searchsorted(ends, v, "right")), int(np.searchsorted(starts, e, "left"))
        if a < b:
            begin = tags[a] == OUT
            tags[a:b] = np.where(tags[a:b] == OUT, IN, tags[a:b])
            tags[a] = BEGIN if begin else tags[a]
    c = int(np.searchsorted(ends, at, "right"))
    a, b = max(0, c - REACH), min(len(found), c + REACH + 1)
    near = tags[a:b].tolist()
    if near and near[0] == IN:
        near[0] = BEGIN
    return [m.group()[:128] for m in found[a:b]], near


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A window around every base span, and one at a place of its own choosing for every text without."""
    for batch in batches:
        rows = []
        for text in _texts(batch):
            values = sorted({(v, e) for _, _, e, v in base_spans(text)})
            places = [v for v, _ in values] or [crc32(text.encode("utf-8", "surrogatepass")) % max(len(text), 1)]
            files = file_slots(text).tolist()
            for at in places:
                near = [x for x in values if abs(x[0] - at) <= 2 * SPAN]
                tokens, tags = _window(text, at, near)
                if tokens:
                    rank = crc32("\x1f".join(tokens).encode("utf-8", "surrogatepass"))
                    rows.append({"positive": bool(values), "rank": rank, "tokens": tokens, "tags": tags, "files": files})
        yield pa.RecordBatch.from_pylist(rows, schema=WINDOW_ARROW)


def _value(rng: np.random.Generator) -> str:
    """A random value: long over a large alphabet, or short of letters and digits."""
    kind, draw = rng.integers(4), lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=n))
    if kind == 0:
        return draw(BASE62, int(rng.integers(16, 48)))
    if kind == 1:
        return draw(BASE62[:26], int(rng.integers(2, 5))) + "_-"[rng.integers(2)] + draw(BASE62, int(rng.integers(16, 40)))
    if kind == 2:
        return draw(BASE62 + "-_+/", int(rng.integers(20, 64)))
    return draw(BASE62[:26], int(rng.integers(4, 8))) + draw(BASE62[52:], int(rng.integers(1, 5))) + draw(BASE62[:26], int(rng.integers(0, 3)))


def varied(windows: list[dict], rng: np.random.Generator) -> list[dict]:
    """The windows, each positive one also with another value, and long values set into windows without."""
    out = list(windows)
    plain = [w for w in windows if not w["positive"]]
    for w in windows:
        if not w["positive"]:
            continue
        begins = [i for i, t in enumerate(w["tags"]) if t == BEGIN]
        swapped = {**w, "tokens": [_value(rng) if i in begins else t for i, t in enumerate(w["tokens"])]}
        out.append(swapped)
        if plain:
            other = plain[int(rng.integers(len(plain)))]
            at = int(rng.integers(len(other["tokens"]) + 1))
            value = _value(rng)
            if len(value) >= 16:
                out.append({**other, "tokens": [*other["tokens"][:at], value, *other["tokens"][at:]], "tags": [*other["tags"][:at], BEGIN, *other["tags"][at:]]})
    return out


def _forward_backward(em: np.ndarray, moves: np.ndarray):
    """Log partition and marginals of tags and of moves for sequences of one length (N, T, 3)."""
    n, steps, _ = em.shape
    lse = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
    alpha, beta = np.empty((steps, n, 3)), np.empty((steps, n, 3))
    alpha[0] = moves[OUT] + em[:, 0]
    for t in range(1, steps):
        alpha[t] = lse(alpha[t - 1][:, :, None] + moves[None], 1) + em[:, t]
    beta[-1] = moves[:, OUT]
    for t in range(steps - 2, -1, -1):
        beta[t] = lse(moves[None] + (em[:, t + 1] + beta[t + 1])[:, None, :], 2)
    z = lse(alpha[-1] + beta[-1], 1)
    tags = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
    pairs = np.zeros((3, 3))
    for t in range(1, steps):
        pairs += np.exp(alpha[t - 1][:, :, None] + moves[None] + (em[:, t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
    pairs[OUT] += tags[:, 0].sum(axis=0)
    pairs[:, OUT] += tags[:, -1].sum(axis=0)
    return z, tags, pairs


def train(windows: list[dict], steps: int = 80, rate: float = 0.15, decay: float = 2e-6) -> Model:
    """Penalised maximum likelihood by Adam over all windows.

    Windows are padded to one length by tokens that are outside for certain;
    their moves cost nothing.
    """
    size = 1 << BITS
    moves = np.zeros((3, 3))
    moves[OUT, IN] = NEVER
    length = max(len(w["tokens"]) for w in windows)
    rows, gold = [], np.zeros((len(windows), length), np.int64)
    real = np.zeros((len(windows), length), bool)
    for i, w in enumerate(windows):
        rows += [[*s, *w["files"]] for s in window_slots(w["tokens"]).tolist()] + [[]] * (length - len(w["tokens"]))
        gold[i, :len(w["tags"])] = w["tags"]
        real[i, :len(w["tags"])] = True
    wide = max(len(r) for r in rows)
    index = np.full((len(rows), wide), size, np.int64)
    for i, r in enumerate(rows):
        index[i, :len(r)] = r
    weights = np.zeros((size + 1, 3))
    truth = np.eye(3)[gold]
    taken = np.zeros((3, 3))
    path = np.concatenate((np.zeros((len(windows), 1), np.int64), gold, np.zeros((len(windows), 1), np.int64)), axis=1)
    np.add.at(taken, (path[:, :-1].ravel(), path[:, 1:].ravel()), 1)
    m_w, v_w, m_t, v_t = np.zeros_like(weights), np.zeros_like(weights), np.zeros((3, 3)), np.zeros((3, 3))
    for step in range(1, steps + 1):
        em = np.zeros((len(rows), 3))
        for f in range(wide):
            em += weights[index[:, f]]
        em = em.reshape(len(windows), length, 3)
        em[~real] = [0.0, NEVER, NEVER]
        _, tags, pairs = _forward_backward(em, moves)
        g = ((tags - truth) * real[:, :, None]).reshape(-1, 3) / len(windows)
        grad = np.stack([np.bincount(index.ravel(), np.repeat(g[:, k], wide), size + 1) for k in range(3)], axis=1) + decay * weights
        grad_t = (pairs - taken) / len(windows) + decay * moves
        grad_t[OUT, OUT] = grad_t[OUT, IN] = 0.0
        for value, d, m, v in ((weights, grad, m_w, v_w), (moves, grad_t, m_t, v_t)):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights[size] = 0.0
        moves[OUT, OUT], moves[OUT, IN] = 0.0, NEVER
    return Model(weights[:size], moves)


def _fitted(table: pa.Table) -> pa.Table:
    windows = sorted(table.to_pylist(), key=lambda w: (w["rank"], w["tokens"]))
    model = train(varied(windows, np.random.default_rng(0)))
    return pa.table({"weights": pa.array([model.weights.astype("<f4").tobytes()], pa.binary()), "moves": pa.array([model.moves.tobytes()], pa.binary())})


def fit(docs: DataFrame, fit_rows: int = 4000) -> Model:
    """Train on at most ``fit_rows`` windows: half around base spans, half elsewhere.

    Equal windows count once, and those with the smallest hashes are taken
    from all of the corpus.  Without a base span nothing is learned.
    """
    found = docs.select("text").mapInArrow(_windows, WINDOW)
    found = found.groupBy("positive", "rank").agg(F.min(F.struct("tokens", "tags", "files")).alias("w"))
    found = persisted(found, "secrets-windows")
    # Hashes are even, so a bound on them leaves little more than is taken; the order decides among those.
    sizes = {r["positive"]: r["count"] for r in found.groupBy("positive").count().collect()}
    bounds = {side: (1 << 32) * 2 * fit_rows // n for side, n in sizes.items()}
    parts = [found.filter((F.col("positive") == side) & (F.col("rank") < bounds.get(side, 1 << 32))).orderBy("rank").limit(fit_rows // 2) for side in (True, False)]
    sample = parts[0].unionByName(parts[1]).select("positive", "rank", "w.*")
    # One bounded table of windows, one group; an empty side is found out by the trainer.
    got = sample.groupBy(F.lit(0).alias("_g")).applyInArrow(_guarded, "weights binary, moves binary").collect()
    if not got or got[0]["weights"] is None:
        return Model(np.zeros((1 << BITS, 3)), np.zeros((3, 3)), learned=False)
    return Model(np.frombuffer(got[0]["weights"], "<f4").astype(float).reshape(-1, 3), np.frombuffer(got[0]["moves"]).reshape(3, 3))


def _guarded(table: pa.Table) -> pa.Table:
    if not any(table.column("positive").to_pylist()):
        return pa.table({"weights": pa.array([None], pa.binary()), "moves": pa.array([None], pa.binary())})
    return _fitted(table)


# --- scan -----------------------------------------------------------------------------------------

def field_spans(texts: list[str], model: Model, taken: list[list[tuple[int, int]]], caution: float = 1.0, shortest: int = 6) -> list[list[tuple[int, int]]]:
    """Spans of each text on the field's best path that touch no span in ``taken``.

    ``caution`` is added to the score of outside; spans of fewer characters
    than ``shortest`` are no secrets.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not model.learned or not texts:
        return out
    scores, first = model.emissions([TOKEN.findall(t) for t in texts], [file_slots(t) for t in texts])
    scores[:, OUT] += caution
    for a, b in decode(scores, model.moves):
        i = int(np.searchsorted(first, a, "right")) - 1
        places = [(m.start(), m.end()) for m in TOKEN.finditer(texts[i])]
        s, e = places[a - first[i]][0], places[b - 1 - first[i]][1]
        if e - s >= shortest and not any(x < e and s < y for x, y in taken[i]):
            out[i].append((s, e))
    return out


def _groups(texts: list[str], size: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, about ``size`` characters at a time."""
    group, have = [], 0
    for text in texts:
        group.append(text)
        have += len(text)
        if have >= size:
            yield group
            group, have = [], 0
    if group:
        yield group


SCAN = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for texts in _groups(_texts(batch)):
                given = [base_spans(t) for t in texts]
                more = field_spans(texts, model, [[(s, e) for s, _, e, _ in g] for g in given])
                base += [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e, _ in g] for g in given]
                added += [[{"kind": KINDS[3], "start": s, "end": e} for s, e in m] for m in more]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, _SPANS), pa.array(added, _SPANS)], ["doc_id", "base", "added"])
    return run


def secret_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base, added: spans of every whole text in code points, end exclusive, by start, then kind.

    Null text counts as empty and has no spans; null and repeated ids come
    back as they are; other columns take no part.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(model), SCAN)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def scanned(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""
    found = secret_spans(docs, fit(docs) if model is None else model)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    both = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(
        s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("n"), s["kind"].alias("kind"), s["end"].alias("end"))))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(both).alias("spans"),
                        F.size("added").cast("long").alias("n_crf"))
