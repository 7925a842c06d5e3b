"""Exact token-length histogram of a corpus; suffix sums answer every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents_of, materialize, slices
from .encoding import encode

#: Lengths to a block: suffix sums run inside blocks, then over the blocks' totals, so no window holds all lengths.
BLOCK = 1024


def _lengths(batches):
    for batch in slices(batches):
        counts = [len(encode(text)) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])


def token_lengths(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of each row's whole text. Null and empty texts have 0 tokens; repeated rows stay; a null
    doc_id stays null; further columns are ignored; an empty table gives no rows."""
    return documents_of(docs).mapInArrow(_lengths, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs, with the sums that answer a context limit of that length.

    n_docs, n_tokens_total: documents of exactly this length and their tokens. docs_ge, tokens_ge: suffix sums over
    this length and longer. docs_lt, tokens_lt: what is shorter. truncated_tokens: the corpus's tokens if each
    document is cut to this length. quantile: share of documents of at most this length. Rows repeated in the
    input count as often as they occur; an empty table gives no rows.
    """
    counted = token_lengths(docs).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))
    counted = counted.select(
        "n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("n_tokens_total"),
        F.floor(F.col("n_tokens") / BLOCK).alias("block"),
    )
    counted = materialize(counted, "token-counts")  # small, and used twice below: texts are encoded once
    # A block has at most BLOCK rows and there are as many blocks as the longest document has BLOCK tokens.
    blocks = counted.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens_total").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = counted.join(blocks, "block").select(
        "n_tokens", "n_docs", "n_tokens_total", "all_docs", "all_tokens",
        (F.col("later_docs") + F.sum("n_docs").over(within)).alias("docs_ge"),
        (F.col("later_tokens") + F.sum("n_tokens_total").over(within)).alias("tokens_ge"),
    )
    docs_lt, tokens_lt = F.col("all_docs") - F.col("docs_ge"), F.col("all_tokens") - F.col("tokens_ge")
    return out.select(
        "n_tokens", "n_docs", "n_tokens_total", "docs_ge", "tokens_ge", docs_lt.alias("docs_lt"),
        tokens_lt.alias("tokens_lt"), (tokens_lt + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_tokens"),
        ((docs_lt + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens of the corpus, documents over the limit, tokens if truncated to it.

    Reads only the histogram. The limits are a short list given by the caller; limits beyond the longest document
    and limits of 0 have their plain values.
    """
    limit = histogram.sparkSession.createDataFrame([(int(x),) for x in limits], "context_limit long")
    pairs = F.broadcast(limit).join(histogram.select("n_tokens", "n_docs"), F.lit(True), "left")
    n, d, cap = F.col("n_tokens"), F.coalesce(F.col("n_docs"), F.lit(0)), F.col("context_limit")
    n = F.coalesce(n, F.lit(0))
    return pairs.groupBy("context_limit").agg(
        F.sum(d).alias("n_docs"), F.sum(n * d).alias("n_tokens"), F.sum(F.when(n > cap, d).otherwise(0)).alias("docs_over"),
        F.sum(F.least(n, cap) * d).alias("truncated_tokens"),
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share in (0, 1]: the smallest encoded length that covers it. Repeated rows
    count as often as they occur; an empty corpus gives null."""
    share = histogram.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    pairs = F.broadcast(share).join(histogram.select("n_tokens", "quantile"), F.col("quantile") >= F.col("share"), "left")
    return pairs.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
