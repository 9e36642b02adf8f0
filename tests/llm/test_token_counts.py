"""Length histogram: every column against counts of the library's own ids."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamella.llm.queries import byte_pairs
from lamella.llm.token_counts import block, length_histogram, limit_totals, quantiles

DOCS = "doc_id long, text string, length string, docs string, block string"


def lengths_by_hand(texts):
    whole = Tokenizer.from_file(byte_pairs())
    return [len(e.ids) for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, lengths):
    assert sorted((r.length, r.docs) for r in rows) == sorted(Counter(lengths).items())
    for r in rows:
        longer = [n for n in lengths if n >= r.length]
        assert r.tokens == r.length * r.docs
        assert (r.docs_from, r.tokens_from) == (len(longer), sum(longer))
        assert r.docs_upto == sum(n <= r.length for n in lengths)
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert (r.total_docs, r.total_tokens) == (len(lengths), sum(lengths))


def ask(histogram, lengths):
    limits = [0, 1, 7, 100, 512, 513, 1024, 10**9]
    for r in limit_totals(histogram, limits).collect():
        kept = sum(min(n, r.limit) for n in lengths)
        assert (r.docs_over, r.truncated_tokens, r.lost_tokens) == (sum(n > r.limit for n in lengths), kept, sum(lengths) - kept)
    ordered = sorted(lengths)
    for r in quantiles(histogram, [0.0, 0.25, 0.5, 0.99, 1.0]).collect():
        at = next((n for k, n in enumerate(ordered, 1) if k >= r.share * len(ordered)), None)
        assert r.length == at


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = lengths_by_hand([r.text for r in df.select("text").collect()])
    histogram = length_histogram(df, byte_pairs())
    check(histogram.collect(), lengths)
    ask(histogram, lengths)


def test_nulls_long_texts_repeated_rows_and_clashing_names(spark):
    texts = [None, "", " ", "a", "a", "a b", "x " * 50_000, "é" * 3_000, *["the same text"] * 300]
    df = spark.createDataFrame([(k if k % 3 else None, t, "clash", "clash", "clash") for k, t in enumerate(texts)], DOCS)
    histogram = length_histogram(df, byte_pairs())
    check(histogram.collect(), lengths_by_hand(texts))
    ask(histogram, lengths_by_hand(texts))


def test_nothing(spark):
    histogram = length_histogram(spark.createDataFrame([], DOCS), byte_pairs())
    assert histogram.collect() == []
    assert [tuple(r) for r in limit_totals(histogram, [5]).collect()] == [(5, 0, 0, 0)]
    assert [tuple(r) for r in quantiles(histogram, [0.5]).collect()] == [(0.5, None)]
    with pytest.raises(ValueError):
        limit_totals(histogram, [-1])


def test_blocks_keep_the_order_and_are_few(spark):
    ends = sorted({e for k in range(63) for e in (2**k - 1, 2**k, 2**k + 1)} | {2**63 - 1} | set(range(3000)))
    found = spark.createDataFrame([(n,) for n in ends if n < 2**63], "n long").select("n", block(F.col("n")).alias("b")).orderBy("n")
    numbers = [r.b for r in found.collect()]
    assert numbers == sorted(numbers) and numbers[:128] == list(range(128)) and numbers[-1] < 7_296
