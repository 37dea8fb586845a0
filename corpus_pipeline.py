"""A corpus from raw documents to packed sequences, stage by stage.

Every stage works on all that the one before kept, and its decisions take effect: rejected documents and
copies go, secrets are masked in the text, and what is left is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ipquarry.llm import exact_dedup, near_dup, packing, quality, secrets
from ipquarry.llm.common import drop, scope, small_batches, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, doesn't reject."""
    small_batches(spark)
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, white space aside."""
    small_batches(spark)
    return exact_dedup.drop_duplicates(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    small_batches(spark)
    return near_dup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dup_stage),
    ("secret scans", secrets_stage),
    ("best-fit packing", packing_stage),
]

#: Models, token ids and fitted patterns aren't SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next; what a stage leaves besides goes with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name.replace(" ", "_")))
        if before is not None:
            drop(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
