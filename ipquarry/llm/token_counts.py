"""Exact token-length histogram of a corpus and what its suffix sums answer.

Documents are encoded once and counted by encoded length, with partial sums before the shuffle. For a
context limit L, the tokens of documents cut at L are the sum over lengths up to L plus L times the
number of longer documents; both, and every quantile, come from sums over the histogram. Those sums
change only at lengths that occur, so one row per length answers for every limit in between.

The running sums are taken in two levels, blocks of BLOCK lengths and within a block, so that no task
gets the whole histogram however many lengths occur.

Defined results: null texts count as empty and have length 0; no rows give no rows; repeated rows count
as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ipquarry.llm.byte_bpe import counts, vocabulary_path
from ipquarry.llm.common import stored, table, texts, trim

BLOCK = 1024


def lengths(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each document."""
    path = path or vocabulary_path()

    def run(batches):
        for batch in batches:
            trim()
            n = np.fromiter(counts(path, batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n)], ["doc_id", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """n_tokens, n_docs: the exact histogram."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """A row for each length that occurs, as a context limit.

    n_tokens, n_docs: the histogram. docs_upto, tokens_upto: of documents no longer than that. docs_over,
    tokens_over: of longer ones. total_tokens: of all. truncated_total: tokens left when every document
    is cut at n_tokens. quantile: share of documents no longer than that.
    """
    rows = counts.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / BLOCK).alias("block"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block", F.coalesce(F.sum("b_docs").over(after), F.lit(0)).alias("later_docs"), F.coalesce(F.sum("b_tokens").over(after), F.lit(0)).alias("later_tokens"),
        F.sum("b_docs").over(every).alias("all_docs"), F.sum("b_tokens").over(every).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", "all_docs", "total_tokens",
        (F.col("later_docs") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).alias("docs_over"),
        (F.col("later_tokens") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("tokens_over"),
    )
    return out.select(
        "n_tokens", "n_docs", (F.col("all_docs") - F.col("docs_over")).alias("docs_upto"), (F.col("total_tokens") - F.col("tokens_over")).alias("tokens_upto"),
        "docs_over", "tokens_over", "total_tokens", (F.col("total_tokens") - F.col("tokens_over") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
    )


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut at any limit, from suffix_sums()."""
    row = sums.where(F.col("n_tokens") <= limit).agg(F.max(F.struct("n_tokens", "tokens_upto", "docs_over")).alias("x")).first()["x"]
    if row is None:
        first = sums.agg(F.min(F.struct("n_tokens", "n_docs", "docs_over")).alias("x")).first()["x"]
        return 0 if first is None else limit * (first["n_docs"] + first["docs_over"])
    return row["tokens_upto"] + limit * row["docs_over"]


def quantile(sums: DataFrame, share: float) -> int | None:
    """The smallest length that at least that share of the documents doesn't exceed."""
    return sums.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]


def _query(spark, sf_dir):
    # The sums read the histogram twice; it's written once so that documents are encoded once.
    return suffix_sums(stored(histogram(lengths(table(spark, sf_dir, "documents"))), "histogram"))


QUERIES = {"op4_token_counts": _query}
ORACLE_SQL: dict[str, str] = {}
