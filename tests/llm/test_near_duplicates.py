"""Near-duplicates against all pairs in plain Python."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from lamella.llm.components import components
from lamella.llm.near_duplicates import estimate, near_duplicates, sketches
from tests.conftest import rows

SCHEMA = "doc_id long, text string, kept string"


def word_sets(documents):
    out = {}
    for doc_id, text in documents:
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        out.setdefault(doc_id, []).append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set())
    return out


def by_hand(documents):
    sets = word_sets(documents)
    low = {d: d for d in sets}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    for a, b in combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            low[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d in sets for s in sets[d])


def corpus(seed, groups=6, copies=9):
    pick = random.Random(seed)
    out = []
    common = [f"c{k}" for k in range(40)]
    for g in range(groups):
        base = [f"w{pick.randrange(400)}" for _ in range(pick.randrange(60, 200))]
        for _ in range(copies):
            words = list(base)
            for _ in range(int(len(base) * pick.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                words[pick.randrange(len(words))] = f"x{pick.randrange(10**6)}"
            out.append(" ".join(words + common * (g % 2)))
    out += ["one two", "One TWO", "one two three", "", "  \n", None, "a b c d e", "A\tb c d\x0be", None]
    pick.shuffle(out)
    return [(3 * k + 1, text) for k, text in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    documents = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in documents], SCHEMA)
    assert rows(near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == sorted(by_hand(documents), key=lambda r: str(r[0]))


def test_given_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows(near_duplicates(documents))
    expected = by_hand([(r.doc_id, r.text) for r in documents.collect()])
    assert got == sorted(expected, key=lambda r: str(r[0]))


def test_repeated_rows_nulls_and_nothing(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(5, text, ""), (5, text, ""), (None, text, ""), (None, "other words", ""), (9, None, "")], SCHEMA)
    expected = [(None, 1, None, True), (None, 26, 5, False), (5, 26, 5, True), (5, 26, 5, True), (9, 0, 9, True)]
    assert Counter(map(tuple, near_duplicates(df).collect())) == Counter(expected)
    assert near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_similarity(spark):
    words = [f"w{k}" for k in range(404)]
    other = words[:300] + [f"x{k}" for k in range(104)]
    df = spark.createDataFrame([(1, " ".join(words), ""), (2, " ".join(other), "")], SCHEMA)
    both = sketches(df)
    pair = both.where("doc_id = 1").selectExpr("packed p").crossJoin(both.where("doc_id = 2").selectExpr("packed q"))
    assert abs(pair.select(estimate("p", "q")).first()[0] - 296 / 504) < 0.12


def test_components_of_a_long_path(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95)]
    got = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(61)}, 90: 90, 95: 90, 100: 90}


def test_very_long_texts(spark):
    pick = random.Random(4)
    words = [f"w{pick.randrange(50_000)}" for _ in range(150_000)]
    near, far = list(words), list(words)
    for k in range(0, len(words), 100):
        near[k] = "x"
    for k in range(0, len(words), 20):
        far[k] = f"y{k}"
    documents = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, "z" * 2_000_000), (5, "z" * 2_000_000)]
    df = spark.createDataFrame([(d, t, "") for d, t in documents], SCHEMA)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect())
    assert got == by_hand(documents)


@pytest.mark.parametrize("few", [1_000_000, 1000])
def test_a_star_of_very_many_links(spark, monkeypatch, few):
    monkeypatch.setattr("lamella.llm.components.FEW", few)
    monkeypatch.setattr("lamella.llm.components.HEAVY_NODES", 20)
    star = spark.range(2, 6002).selectExpr("1L as a", "id as b")
    chains = spark.range(10_000, 10_500).selectExpr("id as a", "id + 500 as b")
    got = components(star.union(chains))
    assert got.where("node <= 6001").select("component").distinct().collect() == [(1,)]
    assert got.where("node > 6001 and component <> least(node, node - 500)").where("node >= 10500").count() == 0
    assert got.count() == 6001 + 1000
