"""Corpus pipeline: language ID, near-duplicates, pseudonyms, mixing and packing, each on all that the one before kept.

It belongs to formweave.llm. Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs; all but the last return the columns of documents. Extra columns come
through as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm.alike import similar_groups
from formweave.llm.common import aside, keep, load, restored, texts_only
from formweave.llm.langid import UNKNOWN, identify, learned_from
from formweave.llm.mixing import mix_documents
from formweave.llm.packing import best_fit_packing
from formweave.llm.pii import pseudonymise, session_key
from formweave.llm.simhash import first_of_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or any letter, for which none can be named, go."""
    found = identify(aside(docs, "text"), learned_from(docs))
    return restored(found.where(F.col("lang_pred") != UNKNOWN), docs.columns, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that similarities of 0.8 or more of 5-word shingles join, found by SimHash."""
    boxed = aside(docs, "doc_id", "text").withColumn("_digest", F.xxhash64("text"))
    return first_of_groups(docs, boxed, similar_groups(texts_only(boxed, "_digest")))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal values replaced; n_chars follows the text."""
    found, size = pseudonymise(aside(docs, "text"), session_key(spark)), {}
    if "n_chars" in docs.columns:
        before = F.col(f"_rest.c{docs.columns.index('n_chars')}")
        after = F.when(F.col("n_pseudonyms") > 0, F.length("text")).otherwise(before)
        size = {"n_chars": after.cast(docs.schema["n_chars"].dataType)}
    return restored(found, docs.columns, "text", **size)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes, once for each pass over its source."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in training sequences."""
    return best_fit_packing(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("PII", pseudonyms),
    ("mixing", mixing),
    ("packing", packing),
]

#: SQL cannot express these stages (model, fingerprints, keyed permutations); tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"stage{i + 1}")
    return docs
