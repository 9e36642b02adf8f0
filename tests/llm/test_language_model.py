"""Language-model scores against the same model in plain Python."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lamella.llm.language_model import Backoff, _counts, _pair, held_out, score_documents, train

DOCS = "doc_id long, text string, score string"


def tokens_of(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def by_hand(documents, least, discount):
    training = [tokens_of(t) for d, t in documents if zlib.crc32(str(d).encode()) % 7 != 2]
    words = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip([None, *t], t))
    total = Counter()
    for (first, _), n in pairs.items():
        total[first] += n
    n, v = sum(words.values()), len(words)
    unigram = lambda w: (words[w] + 1) / (n + v + 1)
    arcs = {p: (c - discount) / total[p[0]] for p, c in pairs.items() if c >= least}
    left, unseen = Counter(), Counter()
    for (first, second), p in arcs.items():
        left[first] += p
        unseen[first] += unigram(second)

    def probability(first, second):
        if (first, second) in arcs:
            return arcs[first, second]
        return unigram(second) * ((1 - left[first]) / (1 - unseen[first]) if first in left else 1)

    out = {}
    for d, t in documents:
        t = tokens_of(t)
        out[d] = (
            zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(words[w] > 0 for w in t), n,
            sum(math.log10(unigram(w)) for w in t), sum(math.log10(probability(a, b)) for a, b in zip([None, *t], t)),
        )
    states = [first for first in left]
    return out, probability, [*words, "nowhere"], states


def corpus(seed):
    pick = random.Random(seed)
    texts = [" ".join(f"W{min(pick.randrange(40), pick.randrange(40))}" for _ in range(pick.randrange(50))) for _ in range(120)]
    return list(enumerate([*texts, None, "", "é É\tx\x0by", "never seen words"]))


@pytest.mark.parametrize("how", [Backoff(), Backoff(words=10, least=1), Backoff(words=0)])
def test_scores(spark, how):
    documents = corpus(how.words)
    df = spark.createDataFrame([(d, t, "clash") for d, t in documents], DOCS)
    automaton, words = train(df.where(~held_out()), how)
    expected, probability, vocabulary, states = by_hand(documents, how.least, how.discount)
    got = score_documents(df, automaton, words).select("*", held_out().alias("held")).collect()
    assert len(got) == len(documents)
    for r in got:
        held, n, known, training, base, score = expected[r.doc_id]
        assert (r.held, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, training)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    for state in states[:5]:
        assert math.isclose(sum(probability(state, w) for w in vocabulary), 1, rel_tol=1e-9)


def test_counts_leave_a_task_in_small_batches():
    pick = random.Random(11)
    texts = [" ".join(f"w{pick.randrange(90_000)}" for _ in range(1000)) for _ in range(200)]

    class Task:
        """Runs the function of a task over the texts and looks no further."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            raise StopIteration([*run([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])])

    with pytest.raises(StopIteration) as got:
        _counts(Task(), 1)
    batches = got.value.value
    assert max(b.num_rows for b in batches) <= 1 << 16 < sum(b.num_rows for b in batches)
    rows = pa.Table.from_batches(batches).to_pylist()
    tokens = [tokens_of(t) for t in texts]
    pairs, words = Counter(p for t in tokens for p in zip([None, *t], t)), Counter(w for t in tokens for w in t)
    assert Counter(r["n"] for r in rows if r["first"] is not None) == Counter(pairs.values())
    assert Counter(r["n"] for r in rows if r["first"] is None) == Counter(words.values())
    assert len({(r["first"], r["second"]) for r in rows}) == len(rows) == len(pairs) + len(words)


def test_fewer_pairs_raise_the_least_count(spark):
    df = spark.createDataFrame([(d, t, "") for d, t in corpus(3)], DOCS)
    automaton, _ = train(df, Backoff(pairs=20))
    assert 0 < len(automaton.pairs) <= 20


def test_better_than_single_words_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    automaton, words = train(df.where(~held_out()))
    sums = score_documents(df.where(held_out()), automaton, words).selectExpr("sum(score)", "sum(base_score)").first()
    assert sums[0] > sums[1]


def test_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b", ""), (None, "a b", ""), (1, None, "")], DOCS)
    automaton, words = train(df)
    assert [r.n_tokens for r in score_documents(df, automaton, words).orderBy("n_tokens").collect()] == [1, 3, 3]
    automaton, words = train(df.limit(0))
    assert score_documents(df.limit(0), automaton, words).count() == 0
    assert [r.score for r in score_documents(df.where("doc_id = 1"), automaton, words).collect()] == [0.0]


@pytest.mark.parametrize("how", [Backoff(pairs=20), Backoff(pairs=20, words=5, bits=64), Backoff(pairs=0, words=0)])
def test_pairs_beyond_the_cache_count(spark, how):
    documents = corpus(3)
    df = spark.createDataFrame([(d, t, "") for d, t in documents], DOCS)
    expected, *_ = by_hand(documents, how.least, how.discount)
    automaton, tables = train(df.where(~held_out()), how)
    for r in score_documents(df, automaton, tables).collect():
        assert r.n_known == expected[r.doc_id][2]
        assert math.isclose(r.base_score, expected[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, expected[r.doc_id][5], rel_tol=1e-9)


def test_pairs_are_hashed_as_by_spark(spark):
    pick = random.Random(5)
    values = [[pick.randrange(-(1 << 63), 1 << 63) for _ in "ab"] for _ in range(50)] + [[0, -1]]
    expected = [r[0] for r in spark.createDataFrame(values, "a long, b long").selectExpr("xxhash64(a, b)").collect()]
    first, second = np.array(values, np.int64).view(np.uint64).T
    assert _pair(first, second).view(np.int64).tolist() == expected


def test_very_long_texts(spark, monkeypatch):
    pick = random.Random(8)
    long = " ".join(f"v{min(pick.randrange(30_000), pick.randrange(30_000))}" for _ in range(250_000))
    documents = [*corpus(4), (500, long), (501, long), (502, "b" * 1_000_000)]
    df = spark.createDataFrame([(d, t, "") for d, t in documents], DOCS)
    how = Backoff(pairs=2000, words=500)
    expected, *_ = by_hand(documents, how.least, how.discount)
    automaton, tables = train(df.where(~held_out()), how)
    for r in score_documents(df, automaton, tables).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == expected[r.doc_id][1:4]
        assert math.isclose(r.base_score, expected[r.doc_id][4], rel_tol=1e-9) and math.isclose(r.score, expected[r.doc_id][5], rel_tol=1e-9)
