"""Top-k search, fingerprints, token counts, piece coding: against plain forms."""

import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from chronaxis.llm import fingerprints, pieces, tokens, topk

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXT = "doc_id long, text string, n_chars string, score string, row string, k string"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], TEXT)


def test_topk_equals_plain_search(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "c") for i in range(400)]
    rows += [(1000 + i, rows[7][1], "c") for i in range(40)]             # a group of copies, tied
    rows += [(200, rows[200][1], "again")]                                # a repeated row
    rows += [(3000, None, "c"), (3100, [1.0, None], "c"), (3200, [math.nan] * 6, "c"), (3300, [math.inf] * 6, "c"), (None, [1.0] * 6, "c")]
    rows += [(3400, [2.0, 1.0], "c"), (3500, [], "c")]                    # shorter vectors end in zeros
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), F.col("id") % 100 == 0,
                     k=10, chunk_rows=100, query_rows=3).collect()
    sound = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(1024 * x) for x in v]
            sound[i] = q + [0] * (6 - len(q))
    want = {}
    for q in (i for i in sound if i % 100 == 0):
        scored = sorted(((-sum(a * b for a, b in zip(sound[q], v)), i) for i, v in sound.items() if i != q))[:10]
        want[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    have = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        have.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    assert have == want


def test_topk_of_few_and_none(spark):
    shape = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (100, [3.0])], shape)
    assert sorted((r["query_id"], r["rank"], r["id"]) for r in topk.top_k(few, F.col("id") % 100 == 0).collect()) == [(0, 1, 100), (0, 2, 1), (100, 1, 1), (100, 2, 0)]
    assert topk.top_k(spark.createDataFrame([], shape), F.col("id") % 100 == 0).count() == 0


def test_fingerprint_is_a_multiset_hash():
    a, b, c = "one line", "another", "third"
    sums = fingerprints.Sums().add([a, b, c])
    assert sums.text() == fingerprints.Sums().add([c, a, b]).text() == fingerprints.fingerprint("\n".join([b, c, a]))
    assert sums.copy().add([b], -1).text() == fingerprints.Sums().add([a, c]).text()
    assert fingerprints.Sums().add([a, a]).text() != fingerprints.Sums().add([a]).text()
    long = ["paragraph %d with some words" % i for i in range(300)]
    near = fingerprints.likeness(fingerprints.fingerprint("\n".join(long)), fingerprints.fingerprint("\n".join(long[:200] + ["x%d" % i * 9 for i in range(100)])))
    assert 0.4 < near < 0.9
    assert fingerprints.likeness(fingerprints.fingerprint("\n".join(long)), fingerprints.fingerprint("\n".join("other %d words here and there" % i for i in range(300)))) < 0.35


def test_paragraphs_without_newlines(monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(600))
    other = " ".join("".join(rng.choice("klmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(600))
    mark = fingerprints.fingerprint(text)
    edited = text[:len(text) - len(text) // 3] + other[:len(text) // 3]
    assert 0.4 < fingerprints.likeness(mark, fingerprints.fingerprint(edited)) < 0.95
    assert fingerprints.likeness(mark, fingerprints.fingerprint("inserted " + text)) > 0.6
    assert fingerprints.likeness(mark, fingerprints.fingerprint(other)) < 0.35
    cut = fingerprints.paragraphs(text)
    assert len(cut) > 20 and "".join(p.removesuffix("\n") for p in cut) == text
    # cuts depend on their own line only, and a cut is not a newline
    assert fingerprints.paragraphs(text + "\n" + other) == cut + fingerprints.paragraphs(other)
    assert fingerprints.fingerprint("\n".join(p.removesuffix("\n") for p in cut)) != mark
    monkeypatch.setattr(fingerprints, "BLOCK", 97)
    assert fingerprints.paragraphs(text) == cut
    assert fingerprints.paragraphs("") == [] and fingerprints.paragraphs("\n") == ["", ""] and fingerprints.paragraphs("short") == ["short"]


@pytest.mark.parametrize("rows", [
    [(5, "a\nb\nccc"), (9, "x\ny"), (2, None), (7, ""), (1, "é\n日本 text " * 50), (9, "x\ny")],
    [(4, "alone\nhere")],
    [(None, "no id\nat all"), (3, "abc\ndef\nghi")],
    [],
])
def test_edited_fingerprints(spark, rows):
    got = fingerprints.edited_fingerprints(frame(spark, rows).repartition(3)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[:len(text) - m] + following[:m]
        a, b = fingerprints.fingerprint(text), fingerprints.fingerprint(edited)
        want.append((doc_id or -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, fingerprints.likeness(a, b), fingerprints.likeness(a, fingerprints.fingerprint(following))))
    assert sorted((r.doc_id or -1, *r[1:]) for r in got) == sorted(want)


def test_token_counts_with_and_without_boundaries(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    words = ["the", "naïve", "日本語", "  ", "x" * 30, "𝄞", "hello,", "\n", "▁"]
    texts = [None, "", " ", "a", "<s> </s> <0x0A>", "a" * 5000, "ab" * 3000, " ".join(rng.choice(words) for _ in range(4000)), "one " * 3000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(8, texts[8]), (None, "some text")]
    got = tokens.token_counts(frame(spark, rows), MODEL, size=400, overlap=4, limit=1000).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), len(sp.encode(t or ""))) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1000) for r in got)
    assert tokens.token_counts(frame(spark, []), MODEL).count() == 0


def test_best_path_equals_all_segmentations():
    plain = [("a", -3.0), ("b", -3.5), ("ab", -4.0), ("aba", -6.1), ("bab", -5.0), ("▁", -1.0), ("▁a", -2.0)]
    codec = pieces.Codec(plain + [("", 0.0)] * 256, list(range(len(plain), len(plain) + 256)))
    scores = dict(plain)

    def best(text):
        top = None
        for cut in itertools.product((0, 1), repeat=max(len(text) - 1, 0)):
            parts, part = [], text[:1]
            for c, flag in zip(text[1:], cut):
                if flag:
                    parts.append(part)
                    part = ""
                part += c
            parts.append(part)
            if all(p in scores or len(p) == 1 for p in parts):
                total = sum(scores.get(p, codec.unknown) for p in parts)
                top = total if top is None else max(top, total)
        return top

    def score(ids):
        total, raw = 0.0, 0
        for i in ids:
            if i in codec.byte_of:
                raw += 1
            else:
                total += plain[i][1]
        return total + raw / 1 * codec.unknown  # one byte per unknown character below

    for text in ("a", "ab", "abab", "▁abba", "xab", "bxb", "▁▁a", "ababab▁"):
        assert score(codec.best_path(text)) == pytest.approx(best(text))


def test_piece_coding_round_trip(spark):
    texts = [None, "", " ", "  a  b", "▁", "a▁b ▁", "日本\U0001F600 é\n\t", "word " * 2000, "q" * 3000, "\x00\x01"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    docs = frame(spark, rows)
    coded = pieces.encode_texts(docs, MODEL)
    back = {(r.doc_id, r.text) for r in pieces.decode_ids(coded, MODEL).collect()}
    assert back == {(i, t) for i, t in rows}
    full = pieces.coded_documents(docs, MODEL).collect()
    assert sorted(r.decoded_sha256 for r in full) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows)
    assert all(r.n_pieces == len(r.ids) for r in full)
    assert pieces.coded_documents(frame(spark, []), MODEL).count() == 0


def test_topk_keeps_large_negative_scores_and_refuses_overflow(spark):
    shape = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1e6]), (1, [-1e6]), (2, [5.0])], shape)
    got = topk.top_k(few, F.col("id") % 100 == 0).collect()
    assert sorted((r["rank"], r["id"], r["score"]) for r in got) == [(1, 2, 1_024_000_000 * 5120), (2, 1, -1_024_000_000**2)]
    with pytest.raises(ArithmeticError):
        topk.top_k(spark.createDataFrame([(0, [1e8]), (1, [1e30])], shape), F.col("id") % 100 == 0)


def test_copied_query_blocks_are_not_broadcast(spark):
    """A query block is copied to every chunk of rows; the copies do not pass through the driver."""
    rows = spark.createDataFrame([(i, [float(i % 7) / 8, float(i % 11) / 8]) for i in range(400)], "vec_id long, embedding array<double>")
    found = topk.top_k(rows, F.col("id") % 10 == 0, chunk_rows=20, query_rows=10)
    assert found.count() == 400
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joins = [line for line in lines if "Join" in line and "qchunk" in line and "chunk" in line and "list" in line]
    assert joins and all("strategy=merge" in line for line in joins)
