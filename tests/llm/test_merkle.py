"""The postorder manifest against plain trees built level by level."""

import hashlib
import zlib
from itertools import groupby

import pytest

from chronaxis.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([sha(*at[i:i + 2]) for i in range(0, len(at), 2)])
    return levels


def proof(levels, i):
    return [level[(i >> k) ^ 1] for k, level in enumerate(levels[:-1]) if (i >> k) ^ 1 < len(level)]


def climb(node, levels, i):
    for k, level in enumerate(levels[:-1]):
        other = (i >> k) ^ 1
        pair = [node, *level[other:other + 1]]
        node = sha(*(pair if other > i >> k else pair[::-1]))
    return node


def plain(rows):
    order = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    rows = sorted(rows, key=lambda r: (order(r[2]), order(r[0]), leaf(r[0], r[3], r[2], r[4], r[1])))
    trees = [(lang, list(g)) for lang, g in groupby(rows, key=lambda r: r[2])]
    built = [tree([leaf(r[0], r[3], r[2], r[4], r[1]) for r in g]) for _, g in trees]
    top = tree([t[-1][0] for t in built])
    out = []
    for at, ((_, g), t) in enumerate(zip(trees, built)):
        for i, r in enumerate(g):
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            mine = leaf(r[0], r[3], r[2], r[4] + 1 if hit else r[4], r[1])
            folded = climb(climb(mine, t, i), top, at)
            out.append((r[0], t[0][i], t[-1][0], top[-1][0], sha(*proof(t, i), *proof(top, at)), folded, folded == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def rows(sizes):
    out, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            out.append((n * 37 % 1009, f"text é {n}", lang, "s" if n % 3 else None, n if n % 5 else None))
            n += 1
    return out


@pytest.mark.parametrize("bits", [1, 3])
def test_proofs_equal_plain_trees(spark, bits):
    data = rows({None: 3, "a": 1, "b": 21, "ß": 8, "z": 2})
    data += [(None, None, "b", None, None), (None, "", "b", None, None), (5, "twice", "z", "s", 5), (5, "twice", "z", "s", 5), (6, "é" * 100_000, "z", "s", 1)]
    docs = spark.createDataFrame([(*r, 1, "other") for r in data], SCHEMA)
    got = [tuple(r) for r in merkle.document_proofs(docs, bits).select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(plain(data), key=str)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_one_row_and_no_rows(spark):
    one = [(0, "x", "en", None, 1)]
    docs = spark.createDataFrame([(*r, 1, "other") for r in one], SCHEMA)
    assert [tuple(r) for r in merkle.document_proofs(docs).select(*COLUMNS).collect()] == plain(one)
    assert merkle.document_proofs(docs.filter("doc_id < 0")).count() == 0


def test_log_is_in_postorder(spark):
    data = rows({"a": 13, "b": 1, "c": 9})
    docs = spark.createDataFrame([(*r, 1, "other") for r in data], SCHEMA)
    log = merkle.manifest(docs, merkle.DOCUMENT, "lang", "doc_id", bits=2).trees.log().collect()
    for lang, n in (("a", 13), ("b", 1), ("c", 9)):
        mine = sorted((r for r in log if r["tree"] == lang), key=lambda r: r["position"])
        levels = tree([leaf(r[0], r[3], r[2], r[4], r[1]) for r in sorted(d for d in data if d[2] == lang)])

        def after(level, i):
            below = [2 * i, 2 * i + 1] if level else []
            return [x for c in below if c < len(levels[level - 1]) for x in after(level - 1, c)] + [(level, i)]

        expected = after(len(levels) - 1, 0)
        assert [r["position"] for r in mine] == list(range(len(expected)))
        assert [(r["level"], r["index"]) for r in mine] == expected
        assert [r["digest"] for r in mine] == [levels[k][i] for k, i in expected]


def test_large_positions():
    for leaves in (1, 2, 3, 1000, 2**40 + 17):
        assert merkle.place(merkle.height(leaves), 0, leaves) == merkle.subtree(merkle.height(leaves), leaves) - 1
