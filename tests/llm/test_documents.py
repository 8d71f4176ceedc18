"""Repeat removal, language, mixing, shingle join, URL rules, chat formatting: plain forms and edge cases."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronaxis.llm import bwt, chat, langid, mixing, repeats, shingles, urls
from chronaxis.llm.components import components

TEXT = "doc_id long, text string, lang string, source string, n_chars long, n string, sid string, rate string"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, "n", "sid", "r") for r in rows], TEXT)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# --- op4 ---------------------------------------------------------------

def test_merged_transforms_sort_all_suffixes():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["abab" * 7] * 3
    size = np.array([len(t) for t in texts])
    rows = np.zeros((len(texts), 40), np.uint8)
    for i, t in enumerate(texts):
        rows[i, :len(t)] = np.frombuffer(t.encode(), np.uint8)
    parts = [bwt.transform(rows[a:b], size[a:b]) for a, b in ((0, 20), (20, 21), (21, 63))]
    string, start = bwt.merge(parts, 41)
    merged = [texts[s][a:] for s, a in zip(string, start)]
    assert merged == sorted(t[a:] for t in texts for a in range(len(t) + 1))
    string, start, interval = bwt.common_prefix_intervals(rows, string, start, size, 5)
    found = {}
    for s, a, i in zip(string, start, interval):
        found.setdefault(i, set()).add(texts[s][a:a + 5])
    assert all(len(x) == 1 for x in found.values()) and len({min(x) for x in found.values()}) == len(found)


def plain_removed(rows):
    first = {}
    for i, t in rows:
        t, d = (t or "").encode(), np.inf if i is None else i
        for a in range(len(t) - 49):
            first[t[a:a + 50]] = min(d, first.get(t[a:a + 50], np.inf))
    out = []
    for i, t in rows:
        t, d = (t or "").encode(), np.inf if i is None else i
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a:a + 50]] < d:
                gone[a:a + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2)
        out.append((-1 if i is None else i, len(t), int(gone.sum()), edges.tolist(), bytes(np.frombuffer(t, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 3])
def test_repeats_equal_plain_form(spark, hot):
    rng = random.Random(5)
    passage = "a passage that many documents share, é and 日本 included, longer than fifty bytes by far"
    rows = []
    for i in range(60):
        text = " ".join(words(rng, rng.randrange(0, 80)))
        if i % 3 == 0:
            text += passage + " ".join(words(rng, 5))
        rows.append((i * 7 % 61, text))
    rows += [(i, rows[4][1]) for i in (100, 101, 102)] + [(rows[0][0], rows[0][1])]
    rows += [(200, None), (201, ""), (202, "x" * 49), (203, "Heat " * 400), (204, "Heat " * 300), (None, passage * 2), (205, passage * 2), (206, "\x00" * 120), (207, "\x00" * 60)]
    got = repeats.without_repeats(frame(spark, rows).repartition(4), chunk_bytes=3000, hot=hot).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, [list(x) for x in r.spans], r.kept) for r in got) == plain_removed([r[:2] for r in rows])


def test_repeats_of_nothing(spark):
    assert repeats.without_repeats(frame(spark, []), digests=True).count() == 0


# --- op10 --------------------------------------------------------------

def plain_components(rows):
    import re
    sets = []
    for i, t in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall("[^\x20\x09-\x0d]+", lower)
        sets.append({tuple(w[a:a + 5]) for a in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[top(a)] = top(b)
    best = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            best[top(a)] = min(i, best.get(top(a), i))
    return sorted((-1 if i is None else i, len(sets[a]), best.get(top(a), -1)) for a, (i, _) in enumerate(rows))


def test_jaccard_components_equal_plain_form(spark):
    rng = random.Random(7)
    rows, base = [], words(rng, 120)
    for i in range(150):
        kind = i % 5
        if kind == 0:
            text = words(rng, rng.randrange(1, 200))
        elif kind == 1:                        # near copies of one text
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(len(text))] = f"new{i}"
        elif kind == 2:                        # a chain: each text close to the next only
            text = [f"c{j}" for j in range(3 * i // 5, 3 * i // 5 + 60)]
        elif kind == 3:                        # a shared passage, not enough for a link
            text = words(rng, 60) + base[:40]
        else:
            text = ["Same", "short", "TEXT"][:1 + i % 3]
        rows.append((i, " ".join(text)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "É é É"), (304, "é é é"), (5, rows[5][1]), (None, rows[1][1]), (None, "nothing like it at all here"), (400, "word " * 3000)]
    got = shingles.jaccard_components(frame(spark, rows).repartition(5), block_rows=8).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == plain_components(rows)


def test_jaccard_of_nothing(spark):
    assert shingles.jaccard_components(frame(spark, [])).count() == 0
    assert [tuple(r) for r in shingles.jaccard_components(frame(spark, [(4, None)])).collect()] == [(4, 0, 4)]


def test_words_across_block_ends():
    texts = ["alpha beta gamma delta epsilon zeta " * 40000, "one two three", "x" * (3 << 20)]
    for text, got in zip(texts, shingles.shingle_sets(texts)):
        w = text.split()
        assert len(got) == len({tuple(w[a:a + 5]) for a in range(max(len(w) - 4, 1))})
    single = next(shingles.shingle_sets(["alpha beta gamma delta epsilon zeta"]))
    assert set(single) <= set(next(shingles.shingle_sets(texts[:1])))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(2000, 2000), (5000, 4000)]
    got = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(50)}, 4000: 4000, 5000: 4000}


# --- op5 ---------------------------------------------------------------

def test_url_rules(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("Org", "/fr", "block"), ("a.org", "/fr", "allow"),
                                   ("org", "/fr/x", "block"), ("tie.com", "/ab", "block"), ("x.tie.com", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    urls_in = ["https://X.example.NET/en/1?q#f", "http://net/", "http://net", "http://xnet/", "ftp://b.org/fresh", "http://a.org/fr/x/y", "no scheme", None, "",
               "http://x.tie.com/ab", "http://q.net?x/", "a://b://net/", "http://user@example.net/en/\n/", "http://deep.a.b.c.d.net/" + "s/" * 500]
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(urls_in)] + [(3, urls_in[3], "h", "r", "v"), (None, urls_in[1], "h", "r", "v")],
                                  "page_id long, url string, host string, rule string, verdict string")
    got = {r.page_id: (r.host, r.path[:20], r.rule, r.verdict) for r in urls.url_verdicts(pages, rules).collect()}
    assert got[0] == ("x.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1] == got[None] == ("net", "/", "net/", "block")
    assert got[2] == ("net", "", None, "allow") and got[3] == ("xnet", "/", None, "allow")
    assert got[4] == ("b.org", "/fresh", "org/fr", "block")
    assert got[5] == ("a.org", "/fr/x/y", "a.org/fr", "allow") if len("a.org/fr") > len("org/fr/x") else got[5][2] in ("a.org/fr", "org/fr/x")
    assert got[6] == got[7] == got[8] == ("", "", None, "allow")
    assert got[9][2:] == ("tie.com/ab", "block") if len("tie.com/ab") > len("x.tie.com/") else got[9][3] == "block"
    assert got[10] == ("q.net", "", None, "allow") and got[11] == ("b:", "//net/", None, "allow")
    assert got[12][2] == "net/" or got[12][0] == "user@example.net"
    assert got[13][2] == "net/"
    assert urls.url_verdicts(pages, rules).count() == len(urls_in) + 2
    assert urls.url_verdicts(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.url_verdicts(pages, rules.limit(0)).collect()} == {"allow"}


# --- op6 ---------------------------------------------------------------

def test_chat_read_back(spark):
    turns = [(1, 0, "system", "be <|im_end|>\n<|im_start|>assistant kind"), (1, 1, "user", "&lt;| &amp; <| &"), (1, 2, "assistant", "a &lt;|b<|im_end|>"),
             (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "user", "no reply"), (3, None, "assistant", "first"), (3, 1, "assistant", "second"), (3, 1, "assistant", "second"),
             (4, 0, "odd\nrole<|", "x"), (4, 1, None, "y"), (None, 0, "assistant", "no id"), (5, 0, "assistant", "long " * 5000)]
    df = spark.createDataFrame([(*t, "s", "e") for t in turns], "conv_id long, turn long, role string, text string, stream string, example string")
    streams = chat.conversation_streams(df)
    back = {r.conv_id: [tuple(t) for t in r.t] for r in streams.select("conv_id", chat.read_turns(F.col("stream")).alias("t")).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert back[conv] == [(t[2] or "", t[3] or "") for t in mine]
    examples = chat.prefix_examples(streams)
    replies = {}
    for r in sorted(examples.select("conv_id", "example", chat.unescape(F.col("reply")).alias("t")).collect(), key=lambda r: r.example):
        replies.setdefault(r.conv_id, []).append(r.t)
    assert replies == {1: ["a &lt;|b<|im_end|>", ""], 3: ["first", "second", "second"], None: ["no id"], 5: ["long " * 5000]}
    for r in chat.example_texts(streams, examples).filter("conv_id = 1").collect():
        assert r.text[r.loss_start:r.loss_end] == r.reply and r.text.endswith("<|im_end|>\n") and len(r.text) == r.chars
        assert r.text.count("<|im_start|>") == (3 if r.example == 0 else 5)
    assert chat.conversation_streams(df.limit(0)).count() == 0


def test_chat_long_conversation(spark):
    rng = random.Random(6)
    turns = [(7, t, "assistant" if t % 2 else "user", rng.choice(["<|x", "&", "", "some words"]) * (t % 5)) for t in range(3001)]
    streams = chat.conversation_streams(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    stream = streams.select("stream").first().stream
    rows = chat.prefix_examples(streams).orderBy("example").collect()
    assert [r.example for r in rows] == list(range(1500))
    at, want = 0, []
    for _c, _t, role, text in turns:
        head, body = f"<|im_start|>{role}\n", text.replace("&", "&amp;").replace("<|", "&lt;|")
        if role == "assistant":
            want.append((at, at + len(head), at + len(head) + len(body), at + len(head) + len(body) + 11, body))
        at += len(head) + len(body) + 11
    assert [(r.context_end, r.loss_start, r.loss_end, r.chars, r.reply) for r in rows] == want and len(stream) == at


# --- op7 ---------------------------------------------------------------

def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert found.filter(F.col("lang") == F.col("lang_pred")).count() >= 0.95 * found.count() > 0


def test_language_edge_cases(spark):
    rows = [(i, f"{w} " * 20, lang) for i, (w, lang) in enumerate([("alpha beta", "aa"), ("xylo zuzu", "bb")] * 20)]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "bb"), (903, "日本語", None), (904, "alpha", None), (None, "xylo zuzu", "aa"), (904, "alpha", None), (905, "beta alpha " * 120000, None)]
    docs = frame(spark, rows + odd)
    filters = langid.fit(docs)
    got = langid.predict(docs, filters).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred in ("aa", "bb") and by[903].score == 0
    assert by[904].lang_pred == by[905].lang_pred == "aa" and by[None].lang_pred == "bb" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_language_equals_exact_sets(spark, sf):
    """Bloom filters against exact n-gram sets per language: same language, nearly the same share."""
    def cut(text):
        padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        for n in langid.ORDERS:
            for k in range(len(padded) - n + 1):
                if padded[k:k + 2] != "  ":
                    yield padded[k:k + n]

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    outside = {r.doc_id for r in docs.filter(~langid.held_out(F.col("doc_id"))).collect()}
    counts, sizes, many = {}, {}, {}
    for r in rows:
        if r.doc_id in outside and r.text is not None and r.lang is not None:
            sizes[r.lang] = sizes.get(r.lang, 0) + len(r.text) * len(langid.ORDERS)
            many[r.lang] = many.get(r.lang, 0) + 1
            for g in cut(r.text):
                at = counts.setdefault(g, {})
                at[r.lang] = at.get(r.lang, 0) + 1
    languages = sorted(many, key=lambda name: (-many[name], name))
    known = {}
    for g, at in counts.items():
        rates = {name: c / max(sizes[name], 1) for name, c in at.items() if c / max(sizes[name], 1) >= 2e-5}
        known[g] = [name for name, x in rates.items() if x >= 0.2 * max(rates.values())]
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    apart = []
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        hits = dict.fromkeys(languages, 0)
        for g in cut(r.text):
            for name in known.get(g, ()):
                hits[name] += 1
        first, second = sorted(hits.values(), reverse=True)[:2]
        if first > 1.05 * second + 5:  # closer ones may turn on a false positive
            assert got[r.doc_id].lang_pred == max(languages, key=hits.get), r.doc_id
        apart.append(abs(got[r.doc_id].score - first / max(sum(hits.values()), 1)))
    assert len(apart) > 150 and max(apart) < 0.01


def test_filter_lookup_returns_every_language():
    masks = np.zeros((2, 1 << langid.SLOT_BITS), np.int64)
    masks[0], masks[1] = 0b101, 0b1
    model = langid.Filters([f"l{i}" for i in range(63)], masks)
    words = model.hits(np.array([5], np.uint64))
    assert words[0][0] == 0b101 and words[1][0] == 1
    assert model.chance[0] == 1 and model.chance[1] == 0 and model.chance[62] == 1


# --- op9 ---------------------------------------------------------------

def labelled(spark, rng, n=400):
    docs, labels = [], []
    for i in range(n):
        kind = ("good", "good", "low", "toxic")[i % 4]
        text = f"{i} " + " ".join(words(rng, 40, 2000))
        text += {"good": "", "low": " %%% $$$ ### &&& " * 10, "toxic": " vile nasty"}[kind]
        docs.append((i, text))
        labels.append((i, 0 if kind == "low" else 1, int(kind == "toxic")))
    return docs, spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_mixture_meets_targets(spark):
    docs, labels = labelled(spark, random.Random(4))
    odd = [(None, "null id"), (900, None), (901, ""), (902, "a " * 50000), (3, docs[3][1])]
    got = mixing.mixed(frame(spark, docs + odd), labels, {"good": 0.7, "low": 0.3, "toxic": 0.0})
    assert got.count() == len(docs) + len(odd)
    total = got.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS]).first()
    assert total["good"] / total["n"] == pytest.approx(0.7, abs=0.03) and total["low"] / total["n"] == pytest.approx(0.3, abs=0.03)
    assert total["toxic"] / total["n"] < 0.05
    assert got.filter("rate < 0 or copies < 0 or abs(p_good + p_low + p_toxic - 1) > 1e-9").count() == 0


def test_mixture_drops_only_what_the_mix_does_not_want(spark):
    docs, labels = labelled(spark, random.Random(6))
    kept = {r.doc_id for r in mixing.mixture(frame(spark, docs), labels, None).collect()}
    assert kept == {i for i, _ in docs if i % 4 != 3}


INSULTS = ["vile", "nasty", "rotten", "lousy", "awful", "filthy", "wicked", "crude", "mean", "foul"]


def insulting(rng, n, labelled_below):
    """One text in nine is toxic and holds three of ten insults; labels below an id."""
    docs, labels = [], []
    for i in range(n):
        toxic = i % 9 == 4
        docs.append((i, f"{i} " + " ".join(words(rng, 60, 3000) + (rng.sample(INSULTS, 3) if toxic else []))))
        if i < labelled_below:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_mixture_learns_from_ten_toxic_labels(spark):
    docs, labels = insulting(random.Random(12), 200, 93)
    assert sum(t for *_, t in labels) == 10
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in mixing.mixture(frame(spark, docs), labels, None).collect()}
    toxic = {i for i, _ in docs if i % 9 == 4}
    clean = {i for i, _ in docs} - toxic
    assert len(kept & toxic) <= 0.1 * len(toxic) and len(clean - kept) <= 0.05 * len(clean)


def test_mixture_families_are_told_by_whole_texts(spark):
    rng = random.Random(13)
    banner = "This file is part of a collection and may be copied under the terms of its licence. "
    docs, labels = insulting(rng, 180, 180)
    docs = [(i, banner + t) for i, t in docs]
    body = words(rng, 60, 3000)
    docs += [(500 + k, " ".join([f"edited{k}"] + body + ["copied"])) for k in range(30)]  # near copies with other openings
    labels += [(500 + k, 1, 1) for k in range(30)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = mixing.fit(frame(spark, docs), labels)
    assert set(INSULTS) <= set(model.toxic.words) and not {"copied"} & set(model.toxic.words)
    assert mixing.fit(frame(spark, docs[::-1]).repartition(7), labels) == model


def test_mixture_keeps_very_long_clean_texts(spark):
    rng = random.Random(14)
    docs, labels = insulting(rng, 300, 200)
    docs += [(600 + k, " ".join(words(rng, 2000, 3000))) for k in range(12)] + [(900 + k, " ".join(words(rng, 30000, 3000))) for k in range(3)]
    labels += [(600 + k, 1, 0) for k in range(12)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in mixing.mixture(frame(spark, docs), labels, None).collect()}
    toxic = {i for i, _ in docs if i < 600 and i % 9 == 4}
    assert {900, 901, 902} <= kept and len(kept & toxic) <= 0.1 * len(toxic)


def test_mixture_without_labels_or_rows(spark):
    docs, labels = labelled(spark, random.Random(8), 20)
    got = mixing.mixed(frame(spark, docs), labels.limit(0), {"good": 0.5, "low": 0.25, "toxic": 0.25}).collect()
    assert len({round(r.rate, 9) for r in got}) == 1
    assert mixing.mixed(frame(spark, []), labels, {"good": 1.0, "low": 0.0, "toxic": 0.0}).count() == 0


def test_rates_equal_plain_nonnegative_least_squares(spark):
    rng = np.random.default_rng(7)
    bare = mixing.Contrast([], [], [0.0] * mixing.LENGTHS, [1.0] * mixing.LENGTHS, [])
    rising = lambda: sorted(float(x) for x in rng.random(mixing.LEVELS))
    model = mixing.Classifier(dataclasses.replace(bare, posterior=rising()), dataclasses.replace(bare, posterior=rising()))
    members = [(int(c), int(n)) for c, n in zip(rng.integers(mixing.LEVELS**2, size=60), rng.integers(0, 500, size=60))]
    frame_ = spark.createDataFrame(members, "class int, n_tokens long")
    tokens = {}
    for c, n in members:
        tokens[c] = tokens.get(c, 0) + n
    toxic, low = (np.array(x.posterior) for x in (model.toxic, model.low))
    index = np.array(sorted(c for c, n in tokens.items() if n))
    t, q = toxic[index // mixing.LEVELS], low[index % mixing.LEVELS]
    parts = np.stack([(1 - t) * (1 - q), (1 - t) * q, t])
    n = np.array([tokens[c] for c in index])
    present = (parts * n).sum(axis=1)
    for targets in ({"good": 0.5, "low": 0.3, "toxic": 0.2}, {"good": 0.99, "low": 0.01, "toxic": 0.0}):
        wanted = np.array(list(targets.values())) * n.sum()
        rate = np.ones(len(n))
        for _ in range(200_000):  # plain projected gradient of the same squares, far past convergence
            rate = np.maximum(0, rate - parts.T @ (((parts * n * rate).sum(axis=1) - wanted) / present))
        got = mixing.fitted_rates(frame_, model, targets)
        squares = lambda r: ((((parts * n * r).sum(axis=1) - wanted) / present) ** 2).sum()
        assert squares(np.array([got.rates[c] for c in index])) == pytest.approx(squares(rate), rel=1e-3, abs=1e-9)
        assert [got.reached[d] for d in mixing.DOMAINS] == pytest.approx(list((parts * n * rate).sum(axis=1) / n.sum()), abs=1e-4)
        assert got.gap < 1e-6


def test_chat_replies_come_from_the_masked_stream(spark):
    """A reply is what the stream holds between loss_start and loss_end, not the turn that the example was made from."""
    said = [("user", "hi <|im_end|>\n & co"), ("assistant", "aé<|im_end|>\n\U0001f600"), ("assistant", ""), ("user", ""), ("assistant", "last")]
    rows = [(c, i, r, t) for c in (1, None) for i, (r, t) in enumerate(said)]
    streams = chat.conversation_streams(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    examples = chat.prefix_examples(streams)
    stream = {r["conv_id"]: r["stream"] for r in streams.collect()}
    spans = {}
    for r in examples.orderBy("example").collect():
        spans.setdefault(r["conv_id"], []).append((r["loss_start"], r["loss_end"], r["reply"]))
    got = {r["conv_id"]: r["replies"] for r in chat.masked_replies(streams, examples.drop("reply")).collect()}
    assert got == {c: [stream[c][a:z] for a, z, _ in s] for c, s in spans.items()} == {c: [t for _, _, t in s] for c, s in spans.items()}
    moved = examples.drop("reply").withColumn("loss_start", F.col("loss_start") - 1)
    got = {r["conv_id"]: r["replies"] for r in chat.masked_replies(streams, moved).collect()}
    assert got == {c: [stream[c][a - 1:z] for a, z, _ in s] for c, s in spans.items()}
