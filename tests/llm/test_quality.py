"""Quality rules: statistics against plain Python, rules on labelled texts."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest

from lamella.llm.quality import BASE, Condition, Covering, DecisionList, judge, kept_documents, learn, marked_stems

DOCS = "doc_id long, text string, kept string, length int"


def base_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def texts(seed):
    pick = random.Random(seed)
    out = [None, "", " \n\t\r\x0b\x0c ", "a b", "a b c a b c", "a a a a", "é 😀 é 😀 é 😀", "x\n\nx\n x\nx \nx", "a|b #<>&%$*", "\xa0   x"]
    out += [" ".join(f"w{pick.randrange(n)}" for _ in range(pick.randrange(300))) + "\nsame\nsame" for n in (3, 10, 40, 2000) for _ in range(8)]
    return out


def test_base_statistics(spark):
    documents = list(enumerate(texts(3)))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in documents], DOCS)
    got = {r.doc_id: r for r in judge(df, DecisionList()).collect()}
    for doc_id, text in documents:
        r = got[doc_id]
        assert (*(r[c] for c in BASE), r.base_failed) == base_by_hand(text), text
        assert r.kept == (not r.base_failed)


def test_very_long_texts_and_repeated_rows(spark):
    pick = random.Random(9)
    long = [" ".join(f"w{pick.randrange(n)}" for _ in range(150_000)) + "\nx\nx" for n in (60, 3000)] + ["7" * 1_000_000, "a\n" * 200_000]
    documents = [(k, t) for k, t in enumerate(long)] + [(9, long[0])] * 2 + [(None, "a b c")] * 2
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in documents], DOCS)
    out = judge(df, DecisionList(((Condition("marked", True, 1.0),),), ("rude",))).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, *(r[c] for c in BASE), r.base_failed) for r in out)
    assert got == sorted((d is None, d or 0, *base_by_hand(t)) for d, t in documents)


def test_stems_are_as_long_as_their_texts_allow(spark):
    clean = [(k, f"path pathway word{k} wort wortlaut nice", False) for k in range(40)]
    toxic = [(100 + k, f"pathetic {'worthless' if k % 2 else 'worthlessness'} to{k}", True) for k in range(8)]
    toxic += [(200 + k, f"abcd{e} at{k}", True) for k, e in enumerate(["efgh", "xy", "efgi", "uvw", "efgh", "zz"])]
    rows = spark.createDataFrame(clean + toxic + [toxic[0]] * 5, "doc_id long, text string, toxic boolean")
    assert marked_stems(rows) == ("abcd", "pathetic ", "worthless")


def test_rules_are_ordered_and_printed(spark):
    rules = DecisionList(((Condition("symbols", True, 30.0), Condition("length", False, 400.0)), (Condition("marked", True, 1.0),)), ("rude",))
    good = " ".join(f"w{k}" for k in range(60))
    cases = [(1, good, "", 0), (2, good + " #" * 40, "", 0), (3, good + " RUDE.", "", 0), (4, good + " crude rud", "", 0), (5, good + " rude" + " #" * 40, "", 0)]
    df = spark.createDataFrame(cases, DOCS)
    got = {r.doc_id: r.rule for r in judge(df, rules).collect()}
    first = "symbols >= 30 and length < 400"
    assert got == {1: None, 2: first, 3: "marked >= 1", 4: None, 5: first}
    left = kept_documents(df, rules)
    assert left.columns == df.columns and sorted(map(tuple, left.collect())) == [cases[0], cases[3]]


def test_learns_from_labels_and_holds_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for_learning, held_out = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    rules = learn(documents, for_learning)
    assert rules.rules and rules.marked
    verdicts = judge(documents, rules).where("not base_failed").join(held_out, "doc_id")
    counts = {(r.q, r.t): (r.n, r.kept) for r in verdicts.groupBy(verdicts.quality.alias("q"), verdicts.toxic.alias("t")).agg({"*": "count", "kept": "count_if"}).toDF("q", "t", "n", "kept").collect()}
    print(rules, counts)
    clean, kept = counts[(1, 0)]
    assert kept >= 0.98 * clean
    toxic, kept = counts[(1, 1)]
    assert kept <= 0.3 * toxic  # few labelled toxic documents per language at this size


@pytest.mark.parametrize("labels", [[], [(None, 0, 0), (1, None, None), (77, 0, 1)]])
def test_without_labels_or_documents(spark, labels):
    df = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(60)), "", 0), (None, None, "", 0)], DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = learn(df, marks, Covering(sample=100))
    assert rules.rules == ()
    assert sorted((r.doc_id or 0, r.kept) for r in judge(df, rules).collect()) == [(0, False), (1, True)]
    assert judge(df.limit(0), learn(df.limit(0), marks)).count() == 0


def test_base_in_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: r for r in judge(spark.read.parquet(path), DecisionList()).collect()}
    for doc_id, text in duckdb.sql(f"select doc_id, text from '{path}'").fetchall():
        assert (*(got[doc_id][c] for c in BASE), got[doc_id].base_failed) == base_by_hand(text)


def test_stems_beyond_six_letters_and_whole_words(spark):
    pick = random.Random(7)
    texts_, rude = [], [f"achlich{a}{b}ung" for a in "bdfgk" for b in "aeiou"] + ["idiota"]
    for k in range(900):
        words = [f"wort{pick.randrange(300)}" for _ in range(60)] + ["achlichsam", "idiotas", "idiotario"]
        texts_.append((k, " ".join(words + ([rude[k // 2 % 26], rude[(k // 2 + 1) % 26]] if k % 2 else [])), k % 2 == 1))
    rows = spark.createDataFrame(texts_, "doc_id long, text string, toxic boolean")
    stems = marked_stems(rows)
    assert "idiota " in stems and {f"achlich{a}" for a in "bdfgk"} <= set(stems)
    rules = DecisionList(((Condition("marked", True, 1.0),),), stems)
    verdicts = judge(rows, rules).join(rows.select("doc_id", "toxic"), "doc_id")
    assert verdicts.where("toxic = (rule is null)").count() == 0
    labels = rows.selectExpr("doc_id", "1 as quality", "int(toxic) as toxic")
    left = judge(rows, learn(rows, labels)).join(labels, "doc_id").where("kept")
    assert {r.toxic: r.n for r in left.groupBy("toxic").agg({"*": "count"}).toDF("toxic", "n").collect()} == {0: 450}
