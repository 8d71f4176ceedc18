"""The secret scan against plain patterns, enumerated tag paths and planted secrets."""

import hashlib
import itertools
import random
import re

import numpy as np

from chronaxis.llm import secrets

SCHEMA = "doc_id long, text string, source string, start long, spans string"


def plain_base(text):
    out = []
    for m in re.finditer(r"(?a:(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", text):
        out += [(m.start(), 0, m.end())] if len(m.group(2)) >= 6 else []
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        out += [(m.start(), 1, m.end())] if len(m.group()) >= 20 else []
    for m in re.finditer("[0-9a-f]+", text):
        out += [(m.start(), 2, m.end())] if len(m.group()) >= 24 else []
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(2)
    parts = ["password", "PassWD", "secret", "toKen", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "é", "\n", "AKIA", "AKIAAKIA", "ABCDEFGH0123456789",
             "0123456789abcdef", "deadbeef", "x", "-._", "ſecret", "\t", "secret=tok", "en: abcdefg"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [(s, k, e) for s, k, e, _ in secrets.base_spans(text)] == plain_base(text), text


def test_decoding_equals_the_best_of_all_paths():
    rng = np.random.default_rng(4)
    for trial in range(150):
        moves = rng.normal(size=(3, 3)) * 2
        moves[secrets.OUT, secrets.OUT], moves[secrets.OUT, secrets.IN] = 0.0, secrets.NEVER
        scores = rng.normal(size=(6, 3)) * 2 + [trial % 3, 0, 0]

        def value(path):
            full = (0, *path, 0)
            return sum(scores[i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(full, full[1:]))

        best = max(itertools.product(range(3), repeat=6), key=value)
        tags = [0] * 6
        for a, b in secrets.decode(scores, moves):
            tags[a:b] = [secrets.BEGIN] + [secrets.IN] * (b - a - 1)
        assert tuple(tags) == best == tuple(secrets.viterbi(scores, moves))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    em, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    z, tags, pairs = secrets._forward_backward(em, moves)
    all_pairs = np.zeros((3, 3))
    for n in range(2):
        weights = {}
        for path in itertools.product(range(3), repeat=4):
            full = (0, *path, 0)
            weights[path] = np.exp(sum(em[n, i, t] for i, t in enumerate(path)) + sum(moves[a, b] for a, b in zip(full, full[1:])))
        total = sum(weights.values())
        assert np.isclose(np.log(total), z[n])
        for i, t in itertools.product(range(4), range(3)):
            assert np.isclose(tags[n, i, t], sum(w for p, w in weights.items() if p[i] == t) / total)
        for p, w in weights.items():
            for a, b in zip((0, *p), (*p, 0)):
                all_pairs[a, b] += w / total
    assert np.allclose(pairs, all_pairs)


def test_scores_are_those_of_training():
    rng = np.random.default_rng(6)
    model = secrets.Model(rng.normal(size=(1 << secrets.BITS, 3)), np.zeros((3, 3)))
    texts = [["token", "=", '"', "aB3xYz91kkQ", '"'], ["é"], [], ["one", "two"] * 20, ["x" * 200, "-" * 3]]
    files = [secrets.file_slots(" ".join(t)) for t in texts]
    scores, first = model.emissions(texts, files)
    for tokens, f, at in zip(texts, files, first):
        for i, row in enumerate(secrets.window_slots(tokens) if tokens else []):
            assert np.allclose(scores[at + i], model.weights[[*row, *f]].sum(axis=0))


SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 5))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def corpus(seed, n, plant):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = prose(rng, rng.randint(5, 60)), prose(rng, rng.randint(5, 60))
        extra = rng.choice(["", "call 0151 2345678 now", "mail pala.deno77@example.com", "see https://example.org/en/page-12", "on 2024-05-17 at 10:15", 'it said: "no" = maybe'])
        rows.append((i, f"{a} {plant(rng, i)} {extra} {b}"))
    return rows


def hidden(rng):
    return "".join(rng.choice(secrets.BASE62) for _ in range(rng.randint(22, 40)))


def fixture(rng, i):
    if i % 3:
        return ""
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    return rng.choice([f'token = "{value}"', f"api_key: {value}", f"password='{value[:12]}'", value])


def test_field_adds_secrets_and_leaves_clean_text(spark):
    docs = spark.createDataFrame([(*r, "s", 1, "x") for r in corpus(1, 900, fixture)], SCHEMA)
    model = secrets.fit(docs)
    assert model.learned
    held = corpus(2, 300, lambda rng, i: f'{rng.choice(["auth", "pwd", "bearer"])} = "{hidden(rng)}"' if i < 100 else "")
    got = {r["doc_id"]: r for r in secrets.secret_spans(spark.createDataFrame([(*r, "s", 1, "x") for r in held], SCHEMA), model).collect()}
    caught = 0
    for i, text in held[:100]:
        value = re.search(r'= "(\w{22,})"', text)
        caught += any(s["start"] <= value.start(1) and s["end"] >= value.end(1) for s in got[i]["added"])
    assert caught >= 90
    assert sum(bool(got[i]["added"]) for i, _ in held[100:]) <= 2


def test_scan_rows(spark):
    value = "0123456789abcdef01234567"
    rows = corpus(3, 60, fixture) + [(None, None), (100, ""), (101, None), (None, f"token={value}"), (102, "é" * 200_000 + f" secret: {value}"), (102, f"AKIA{'A' * 16} {value}"),
                                     (103, "x" * 300_000)]
    docs = spark.createDataFrame([(*r, "s", 1, "x") for r in rows], SCHEMA)
    got = secrets.scanned(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["base_sha256"]), []).append(r)
    for i, text in rows:
        base = plain_base(text or "")
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = by[i, hashlib.sha256(joined.encode()).hexdigest()].pop()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] != "crf"] == [[secrets.KINDS[k], str(s), str(e)] for s, k, e in base]
        assert [(int(x[1]), secrets.KINDS.index(x[0])) for x in spans] == sorted((int(x[1]), secrets.KINDS.index(x[0])) for x in spans)
        assert r["n_crf"] == sum(x[0] == "crf" for x in spans)
    assert secrets.scanned(docs.filter("false")).count() == 0
    clean = secrets.scanned(docs.filter("doc_id = 100")).collect()  # nothing to learn from
    assert [(r["spans"], r["n_crf"]) for r in clean] == [("", 0)]
