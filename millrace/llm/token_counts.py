"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import bpe
from millrace.llm.common import written

#: Lengths are dealt into blocks of so many; each block is summed by itself and offset by the blocks after it.
BLOCK = 64


def length_histogram(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``(n_tokens, n_docs)``: how many documents have each encoded length; null and empty texts have length 0."""
    counted = bpe.encode(docs.select(text_col), tokenizer_path, text_col, ids=False)
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """One row for each encoded length that occurs, read as a context limit:

    ``context_limit``, ``n_docs`` (documents of just that length), ``docs_over`` (longer ones), ``docs_within``,
    ``tokens_within`` (of documents that fit), ``tokens_truncated`` (of all documents, each cut at the limit),
    ``tokens_lost``, and ``quantile`` (the share of documents that fit). Between two rows every figure follows: for a
    limit ``c`` below the next length, ``tokens_truncated`` grows by ``docs_over`` for each further token.
    No documents, no rows.
    """
    h = written(histogram.select(F.col("n_tokens").alias("length"), "n_docs").withColumn("block", F.floor(F.col("length") / BLOCK)))
    # Blocks are few: one for each 64 tokens of the longest text at most, however many documents there are.
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("tokens_after")
    )
    whole = h.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("all_tokens")).first()
    above = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(F.broadcast(after), "block").select(
        "length", "n_docs",
        (F.coalesce(F.sum("n_docs").over(above), F.lit(0)) + F.col("docs_after")).alias("docs_over"),
        (F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(above), F.lit(0)) + F.col("tokens_after")).alias("tokens_over"),
    )
    docs, tokens = F.lit(whole.all_docs or 0), F.lit(whole.all_tokens or 0)
    kept = tokens - F.col("tokens_over") + F.col("docs_over") * F.col("length")
    return out.select(
        F.col("length").alias("context_limit"), "n_docs", "docs_over", (docs - F.col("docs_over")).alias("docs_within"),
        (tokens - F.col("tokens_over")).alias("tokens_within"), kept.alias("tokens_truncated"), (tokens - kept).alias("tokens_lost"),
        ((docs - F.col("docs_over")) / docs).alias("quantile"),
    )
