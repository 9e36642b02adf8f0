"""Exact token counts through a histogram of encoded lengths.

Documents are aggregated by encoded length, first within each task, so hot lengths never
meet in one. Suffix sums over the lengths then answer every question on totals: the n-th
longest document, and what remains of the corpus when each document is cut at a limit.

The sums run in two steps. Lengths are put into blocks that keep the order: one block per
length below 256, then 128 per power of two, at most 7,296 for any length. Sums within
blocks run in parallel; only the blocks' totals, bounded whatever the data, meet in one task.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.packing import Encoder
from lamella.llm.rows import hold

SLICE = 512
BLOCK_BITS = 7


@functools.cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)  # kept by the Python worker from task to task


def encoded_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length: the number of ids of each row's ``text``; a null text has none."""

    def run(batches):
        encoder = _encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                texts = [t or "" for t in batch.slice(at, SLICE).column(0).to_pylist()]
                lengths = [len(ids) // 4 for ids in encoder.ids(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["length"])

    return docs.select("text").mapInArrow(run, "length long")


def block(length: Column) -> Column:
    """Number of a length's block; longer lengths never have a smaller one."""
    digits = F.length(F.bin(length))
    over = F.greatest(digits - F.lit(BLOCK_BITS + 1), F.lit(0))
    return over * (1 << BLOCK_BITS) + F.call_function("shiftright", length, over)


def length_histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """length, docs, tokens, docs_upto, docs_from, tokens_from, truncated_tokens, total_docs, total_tokens.

    One row per encoded length that occurs. ``docs_upto`` and ``docs_from`` count documents
    of at most and of at least that length, ``tokens_from`` the ids of the latter;
    ``truncated_tokens`` is the corpus with every document cut at that length. A null or
    empty text has length 0; repeated rows and null ids are documents like any other, other
    columns are ignored, and an empty table has an empty histogram. The counts are written to
    a table of the shared folder, so texts are encoded once.
    """
    counts = hold(encoded_lengths(docs, tokenizer).groupBy("length").agg(F.count("*").alias("docs")), "lengths")
    counts = counts.select(block(F.col("length")).cast("int").alias("block"), "length", "docs", (F.col("length") * F.col("docs")).alias("tokens"))
    blocks = counts.groupBy("block").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    every, longer = Window.partitionBy(), Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    after = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(longer), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(longer), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(every).alias("total_docs"),
        F.sum("tokens").over(every).alias("total_tokens"),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length"))
    sums = counts.withColumns({"docs_here": F.sum("docs").over(within), "tokens_here": F.sum("tokens").over(within)})
    sums = sums.join(F.broadcast(after), "block").select(
        "length", "docs", "tokens", "total_docs", "total_tokens",
        (F.col("docs_here") + F.col("docs_after")).alias("docs_from"),
        (F.col("tokens_here") + F.col("tokens_after")).alias("tokens_from"),
    )
    cut = F.col("total_tokens") - F.col("tokens_from") + F.col("length") * F.col("docs_from")
    upto = F.col("total_docs") - F.col("docs_from") + F.col("docs")
    return sums.select(
        "length", "docs", "tokens", upto.alias("docs_upto"), "docs_from", "tokens_from",
        cut.alias("truncated_tokens"), "total_docs", "total_tokens",
    )


def limit_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, truncated_tokens, lost_tokens for any context limits, in one pass.

    Documents longer than a limit are cut to it. An empty histogram gives zeros; limits below
    zero are errors.
    """
    if any(limit < 0 for limit in limits):
        raise ValueError("a limit is at least 0")
    asked = sorted(set(limits))
    sums = []
    for limit in asked:
        over = F.col("length") > limit
        sums.append(F.coalesce(F.sum(F.when(over, F.col("docs"))), F.lit(0)).alias(f"over_{limit}"))
        sums.append(F.coalesce(F.sum(F.when(over, limit * F.col("docs")).otherwise(F.col("tokens"))), F.lit(0)).alias(f"kept_{limit}"))
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    answers = [
        F.struct(
            F.lit(limit).cast("long").alias("limit"), F.col(f"over_{limit}").alias("docs_over"),
            F.col(f"kept_{limit}").alias("truncated_tokens"), (F.col("_total") - F.col(f"kept_{limit}")).alias("lost_tokens"),
        )
        for limit in asked
    ]
    return histogram.agg(total.alias("_total"), *sums).select(F.inline(F.array(*answers)))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the smallest length that at least that share of the documents do not exceed.

    Null lengths where the histogram is empty.
    """
    reached = [F.min(F.when(F.col("docs_upto") >= F.lit(s) * F.col("total_docs"), F.col("length"))).alias(f"q{k}") for k, s in enumerate(shares)]
    answers = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{k}").alias("length")) for k, s in enumerate(shares)]
    return histogram.agg(*reached).select(F.inline(F.array(*answers)))
