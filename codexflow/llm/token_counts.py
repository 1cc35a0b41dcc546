"""Exact length histogram: totals, quantiles and truncated totals for every limit.

Documents are aggregated by their exact encoded length; only the histogram is
kept. Suffix sums over it answer, for every context limit, how many documents
and ids there are beyond it and how many ids remain when each document is cut
at it. Sums run within blocks of lengths and over the blocks' totals, so no
task takes the whole histogram.

Nulls and edges: a null text is the empty text, of length 0. Rows that share a
``doc_id`` count each. An empty table has an empty histogram. Other columns of
the input are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import BYTE, column, encoder, tokenizer_path

#: Lengths in one block of the suffix sums.
BLOCK = 1024


def encoded_lengths(documents: DataFrame, tokenizer: str = BYTE) -> DataFrame:
    """``doc_id`` and the number of ids of each whole text, without an end id."""
    path = tokenizer_path(tokenizer)

    def count(batches):
        e = encoder(path, tokenizer)
        for batch in batches:
            n = [len(e.encode(t)) // e.dtype.itemsize for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array(column(batch, "doc_id"), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])
        e.forget()

    docs = documents.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return docs.mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens`` and ``n_docs``: one row for each length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs, taken as a context limit:

    ``docs_at_most``/``docs_over``, ``tokens_over`` (ids of the longer
    documents), ``truncated_total`` (ids left when each document is cut at L),
    ``lost`` (ids cut off) and ``quantile`` (share of documents of at most L).
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(every).alias("docs"),
        F.sum("t").over(every).alias("total"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    over = lambda c, rest: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(rest)
    return (
        h.join(blocks, "block")
        .withColumns({"docs_over": over("n_docs", "docs_after"), "tokens_over": over("tokens", "tokens_after")})
        .withColumn("lost", F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over"))
        .select(
            F.col("n_tokens").alias("context_limit"), "n_docs", "tokens",
            (F.col("docs") - F.col("docs_over")).alias("docs_at_most"), "docs_over", "tokens_over",
            (F.col("total") - F.col("lost")).alias("truncated_total"), "lost",
            ((F.col("docs") - F.col("docs_over")) / F.col("docs")).alias("quantile"),
        )
    )


def answer_limits(sums: DataFrame, limits: DataFrame) -> DataFrame:
    """Totals for limits that need not occur as lengths (column ``context_limit``).

    The next smaller length that occurs has the same longer documents.
    """
    marked = sums.select("context_limit", "docs_over", "tokens_over", F.lit(False).alias("asked")).unionByName(
        limits.select("context_limit").distinct().withColumns({"docs_over": F.lit(None).cast("long"), "tokens_over": F.lit(None).cast("long"), "asked": F.lit(True)})
    )
    # Within blocks of lengths, then from the block before: no task takes the whole histogram.
    marked = marked.withColumn("block", F.expr(f"context_limit div {BLOCK}"))
    over = ("docs_over", "tokens_over")
    up = Window.partitionBy("block").orderBy("context_limit", "asked").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The least of what is over a limit is that over the block's greatest length.
    blocks = marked.groupBy("block").agg(*(F.min(c).alias(c) for c in over))
    blocks = blocks.select("block", *(F.last(c, ignorenulls=True).over(earlier).alias(f"{c}_before") for c in over))
    first = sums.agg(F.max(F.col("docs_over") + F.col("docs_at_most")).alias("docs"), F.max(F.col("truncated_total") + F.col("lost")).alias("total"))
    found = marked.withColumns({c: F.last(c, ignorenulls=True).over(up) for c in over}).filter("asked").join(blocks, "block", "left")
    found = found.withColumns({c: F.coalesce(c, f"{c}_before") for c in over})
    found = found.crossJoin(F.broadcast(first)).withColumns({"docs_over": F.coalesce("docs_over", "docs"), "tokens_over": F.coalesce("tokens_over", "total")})
    return found.select("context_limit", "docs_over", (F.col("total") - F.col("tokens_over") + F.col("context_limit") * F.col("docs_over")).alias("truncated_total"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, as the sums read the histogram twice and the texts are to be encoded once.
    histogram = common.write_table(length_histogram(encoded_lengths(common.read(spark, sf_dir, "documents"))), "histogram")
    return suffix_sums(histogram)
