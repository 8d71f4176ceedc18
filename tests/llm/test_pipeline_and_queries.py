"""The pipeline against plain forms of its stages, and registered queries against DuckDB."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from chronaxis.llm import queries as llm
from chronaxis.llm.pieces import Codec
from tests.llm.test_documents import plain_components, plain_removed
from tests.llm.test_vectors_and_text import MODEL
from tools.check import TABLES, norm

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def fixture(tmp_path_factory, spark):
    """Clean, toxic, repeated, empty and letterless documents in two languages, with labels for most."""
    rng = random.Random(9)
    words = {"aa": [f"{a}{b}lor" for a in "bdfg" for b in "aeiou"], "bb": [f"{a}{b}szk" for a in "mnpr" for b in "aeiou"]}
    shared = "this passage is longer than fifty bytes and stands in many documents é"
    docs, labels = [], []
    for i in range(240):
        lang = "aa" if i % 3 else "bb"
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(900)) for _ in range(60))
        if i % 8 == 5:
            text += " vile nasty"
        if i % 6 == 0:
            text += "\n" + shared
        docs.append((i, text, lang, f"s{i % 4}", len(text)))
        if i % 5:
            labels.append((i, 1, int(i % 8 == 5)))
    docs += [(300 + k, docs[k][1] + f" end{k}", docs[k][2], "s9", 0) for k in range(0, 20)]          # near copies
    docs += [(400, None, "aa", "s0", 0), (401, "", "aa", None, 0), (402, "12 ?! 34", None, "s0", 8), (403, docs[2][1], "aa", "s1", 0), (403, docs[2][1], "aa", "s1", 0)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def test_pipeline_equals_plain_stages(spark, fixture):
    folder, docs = fixture
    kept = [(d, t) for d, t, *_ in docs if any(c.isalpha() for c in t or "")]
    first = {d for d, _, c in plain_components(kept) if d == c}
    kept = sorted({(d, t) for d, t in kept if d in first})
    kept = [(d, text) for d, n, gone, _, text in plain_removed(kept) if n > gone]
    kept = [(d, t) for d, t in kept if "vile" not in t]
    codec = Codec.load(MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {d: codec.encode(t) for d, t in kept}
    assert len(kept) > 150


def test_stages_return_document_columns_and_take_empty_tables(spark, fixture):
    folder, _ = fixture
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0
        assert name == "encoding" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_texts_where_no_language_is_known(spark, fixture):
    folder, docs = fixture
    bare = spark.createDataFrame([(d, t, None, s, n) for d, t, _, s, n in docs], DOCS)
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.language(spark, bare, folder).collect())
    assert kept == sorted((d, t) for d, t, *_ in docs if any(c.isalpha() for c in t or ""))


def test_cut_texts_keep_whole_characters(spark, fixture):
    folder, _ = fixture
    docs = spark.createDataFrame([(1, "é" * 40, "aa", "s", 40), (2, "xé" + "é" * 40, "aa", None, 42)], DOCS)
    out = {r.doc_id: r for r in corpus_pipeline.repeated_passages(spark, docs, folder).collect()}
    assert out[1].text == "é" * 40 and "�" not in out[2].text and out[2].n_chars == len(out[2].text) and out[2].source is None


@pytest.mark.parametrize("name", ["op1_topk_search", "op4_repeat_removal", "op5_url_filters", "op6_chat_formatting", "op10_jaccard_join"])
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(llm.ORACLE[name])
    cols = [d[0] for d in cur.description]
    df = llm.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    assert names == sorted(cols)
    want = sorted(tuple(norm(dict(zip(cols, r))[c]) for c in names) for r in cur.fetchall())
    assert sorted(tuple(norm(r.asDict(True)[c]) for c in names) for r in df.collect()) == want


def test_every_dealt_query_is_registered():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
    assert "pipeline" in entry.queries()


def test_mixing_query_covers_all_rows(spark, sf):
    got = llm.QUERIES["op9_source_mixing"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert got.filter(F.col("rate") < 0).count() == 0 and np.isfinite(got.agg(F.sum("rate")).first()[0])


def test_language_stage_names_unnamed_documents(spark, fixture):
    folder, docs = fixture
    unnamed = {d for d, *_ in docs[:240:7]}
    some = spark.createDataFrame([(d, t, None if d in unnamed else lang, s, n) for d, t, lang, s, n in docs[:240]], DOCS)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, some, folder).collect()}
    assert got == {d: lang for d, _, lang, *_ in docs[:240]}
