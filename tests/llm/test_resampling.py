"""Importance resampling against plain Python; the k-th key and ranks with many copies."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lamella.llm.resampling import KEY, Resampling, kth_key, ranked, resample, with_key

DOCS = "doc_id long, text string, score string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, how):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[k : k + n]) for n in range(1, how.longest + 1) for k in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % how.buckets for r in runs]


def plain(documents, target, how=Resampling()):
    bags = [features(t, how) for _, t in documents]
    s, t = Counter(b for _, bag in bags for b in bag), Counter(b for text in target for b in features(text, how)[1])
    total = lambda c: sum(c.values()) + how.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * total(s) / ((s[b] + 1.0) * total(t))))
    rows = []
    for (doc_id, _), (words, bag) in zip(documents, bags):
        weight = sum(gain(b) for b in bag)
        h = int(hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(bag), weight, score, None, words])
    long_enough = [r for r in rows if r[5] >= how.least_words]
    long_enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(long_enough[: how.percent * len(long_enough) // 100], 1):
        row[4] = place
    return ordered(tuple(r[:5]) for r in rows)


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, v or 0) for v in r])


def check(spark, documents, target, how=Resampling()):
    df = spark.createDataFrame([(*d, "clash", "clash") for d in documents], DOCS)
    aims = spark.createDataFrame([(0, t, "clash") for t in target], "item_id long, text string, doc_id string")
    got = ordered(tuple(r) for r in resample(df, aims, how).collect())
    assert got == plain(documents, target, how)
    return got


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_plain_python(spark, longest):
    pick = random.Random(longest)
    words = ["Alpha", "beta", "é", "x1", "straße", "gamma", "Ünder", "0"]
    text = lambda n: pick.choice([" ", ", ", "\n"]).join(pick.choice(words) for _ in range(n))
    documents = [(k, text(pick.randrange(60))) for k in range(300)] + [(None, text(30)), (None, None), (4, text(40)), (5, "")]
    documents += [(1000, "one very long text " * 50_000)]
    documents += [(77, "a copy that many rows share " * 6)] * 150
    got = check(spark, documents, [text(12), None, "", text(3)], Resampling(longest=longest, percent=35, pivots=4, rows_per_slice=40))
    assert max(r[4] or 0 for r in got) == 35 * sum(features(t, Resampling())[0] >= 20 for _, t in documents) // 100


def test_empty_tables_and_small_shares(spark):
    assert check(spark, [(1, "a b c")], []) and check(spark, [(k, "word " * 30) for k in range(9)], ["word"])
    assert check(spark, [], ["x y"]) == []


def test_kth_key_and_ranks_where_most_rows_are_equal(spark):
    values = [5] * 700 + list(range(300))
    df = spark.range(1000).select(F.get(F.lit(values), F.col("id").cast("int")).alias("score"), F.lit(1).cast("long").alias("doc_id"))
    path_rows = with_key(df.withColumns({"n_features": F.lit(1).cast("long"), "weight": F.lit(1).cast("long"), "score": F.col("score").cast("long")}))
    keys = sorted(tuple(r) for r in path_rows.select(*KEY).collect())
    how = Resampling(pivots=3, rows_per_slice=100)
    for k in (1, 2, 294, 295, 700, 999, 1000):
        assert kth_key(path_rows, k, how) == keys[k - 1]
    out = ranked(path_rows, 1000, how).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 1001))
    assert [r.score for r in out] == sorted(values, reverse=True)
