"""A corpus pipeline: language, near copies, repeated passages, mixture, pieces.

Each stage takes (spark, docs, sf_dir) and returns what it kept; all but the
last return the columns of ``documents``.  :func:`run` writes every stage's
rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronaxis.llm import langid, mixing, pieces, repeats, shingles
from chronaxis.llm.common import persisted, prepared
from chronaxis.session import tune
from chronaxis.sources.tables import read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language (null text, text without a letter) and name the language of those that do not say it.

    A document's own ``lang`` stays; a null one becomes the predicted language.
    Where no language can be learned, every text with a letter stays, unnamed.
    """
    prepared(tune(spark))
    found = langid.predict(docs.select(COLUMNS), langid.fit(docs), carry=True).filter("lettered")
    named = F.coalesce("row.lang", F.when(F.col("lang_pred") != langid.UNDECIDED, F.col("lang_pred"))).alias("lang")
    return found.select("row.doc_id", "row.text", named, "row.source", "row.n_chars")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies keep the document with the smallest id.

    Rows that repeat in every column count once; rows without an id cannot be
    told apart and stay.
    """
    prepared(tune(spark))
    groups = shingles.jaccard_components(docs)
    first = groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.select(COLUMNS).join(first, "doc_id", "left_semi").dropDuplicates()
    return named.unionByName(docs.select(COLUMNS).filter(F.col("doc_id").isNull()))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out bytes covered by 50-byte strings of earlier documents.

    Parts of a character that a cut leaves behind go too, ``n_chars`` counts
    the text that is left, and a document of which nothing is left goes.
    """
    prepared(tune(spark))
    rest = F.to_json(F.struct("lang", "source"))
    kept = repeats.without_repeats(docs.select("doc_id", "text", rest.alias("carry")))
    given = F.from_json("carry", "lang string, source string")
    out = kept.filter("n_bytes > n_removed").select("doc_id", F.col("kept").alias("text"), given.alias("g"))
    return out.select("doc_id", "text", "g.lang", "g.source", F.length("text").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep every domain's share of tokens but toxic text, which the mixture wants none of."""
    prepared(tune(spark))
    return mixing.mixture(docs.select(COLUMNS), read(spark, sf_dir, "labels"), None)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document."""
    prepared(tune(spark))
    return pieces.coded_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("mixture", mixture), ("encoding", encoding)]

#: No SQL says what classifiers and piece scores decide; tests compare with plain forms.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepared(tune(spark)), sf_dir, "documents")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
