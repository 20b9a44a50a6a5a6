"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import WORD, documents, materialize
from tessera.llm.langid import fit_on_folds, identify
from tessera.llm.linedup import drop_repeated_lines
from tessera.llm.mixing import mixed_documents
from tessera.llm.ngram_join import drop_near_duplicates
from tessera.llm.packing import pack_documents

#: A document goes if its n-grams are less likely by so much (natural logarithm) under its
#: mixture of languages than under equal chances for all buckets.
LEAST_GAIN = -100.0
#: Rejected documents up to which their keys are sent to all executors (16 bytes each).
SENT_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some mixture of the learnt languages explains.

    Those without letters (``und``, null texts among them) go, and those whose gain is
    under LEAST_GAIN; a clean text in several learnt languages stays. Repeated rows are
    judged alike, each by its own text; a null doc_id is an id like others. All columns
    stay as they are, whatever their names; an empty table gives an empty result.
    """
    digest = F.xxhash64("text")
    keyed = docs.select(F.struct("doc_id", digest.alias("th")).alias("id"), "text")
    found = identify(keyed, fit_on_folds(docs), key="id")
    gone = found.where((F.col("lang_pred") == "und") | (F.col("gain") < LEAST_GAIN)).select(F.col("id.doc_id").alias("gone_id"), F.col("id.th").alias("gone_th"))
    gone = materialize(gone.distinct(), "rejected")
    gone = F.broadcast(gone) if gone.count() <= SENT_ROWS else gone
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_th"]), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that lost lines and of which no word is left goes.

    A null text stays null. Repeated rows are cut alike; a null doc_id is an id like
    others; n_chars is counted anew where lines went. All columns stay, whatever
    their names; an empty table gives an empty result.
    """
    names = docs.columns
    cut = drop_repeated_lines(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))).where((F.col("n_dropped") == 0) | F.col("text").rlike(WORD))
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("row.n_chars"))
    own = {"text": F.col("text"), "n_chars": length}
    return cut.select(*[own.get(c, F.col("row").getField(c)).alias(c) for c in names])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at similarity 0.8 or more.

    The one with the smallest doc_id (null last) stays. Rows, not ids, are joined:
    different texts of one id, or without id, all stay. Texts without words, null ones
    among them, link with nothing and stay. All columns stay, whatever their
    names; an empty table gives an empty result.
    """
    return drop_near_duplicates(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    Counted by row, so repeated rows and null ids have their own counts; a null source
    is a source; a document without words is taken in whole epochs only. All columns
    stay, whatever their names; an empty table gives an empty result.
    """
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 1024 tokens.

    Every row is packed, repeated ones each, null and empty texts as their end
    token alone; a null doc_id stays null. Other columns are left out; an empty table
    gives an empty result.
    """
    # the stages before leave executors little memory
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), together=3 << 20).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Models and tokenizers are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
