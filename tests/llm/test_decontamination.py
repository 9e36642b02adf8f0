"""Overlaps with benchmark items against a window search in plain Python."""

from __future__ import annotations

import hashlib
import random

import pytest

from lamella.llm.decontamination import Overlap, items_digest, n_hit, overlaps, without_overlaps
from lamella.llm.rows import plain_words

DOCS = "doc_id long, text string, items string, n_chars long"


def by_hand(text, items, window=10):
    words = plain_words(text)
    hit, found = set(), set()
    for item, content in items:
        content = plain_words(content)
        if not content:
            continue
        size = min(window, len(content))
        windows = {tuple(content[k : k + size]) for k in range(len(content) - size + 1)}
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in windows:
                hit.update(range(at, at + size))
                found.update([] if item is None else [str(item)])
    return len(words), sorted(hit), sorted(found)


def case(seed):
    pick = random.Random(seed)
    word = lambda n=12: f"w{pick.randrange(n)}"
    items = [(k, " ".join(word() for _ in range(pick.choice([1, 3, 9, 10, 11, 30])))) for k in range(25)]
    items += [(30, None), (31, " .. "), (None, "w1 w2"), (None, " ".join(f"w{k % 11}" for k in range(14))), (2, None), (2, "w5 w5 w5"), (2, "w5 w5 w5"), (32, items[0][1]), (33, items[4][1] + " W1"), (34, "w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3 w3")]
    texts = [" ".join(word() for _ in range(pick.randrange(80))) for _ in range(40)]
    texts += [f"a-b, {t}! zz" for _, t in items if t] + [" ".join(t for _, t in items if t), None, "", "?!", "w3 " * 40]
    return items, [(k, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("block", [8 << 20, 300])
def test_hits_and_items(spark, seed, block):
    items, documents = case(seed)
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in documents], DOCS)
    got = overlaps(docs, spark.createDataFrame(items, "item_id long, text string"), Overlap(max_block_bytes=block))
    for row in got.withColumn("hit", n_hit()).collect():
        words, hit, found = by_hand(row.text, items)
        spread = [k for s in row.spans for k in range(s["first"], s["last"] + 1)]
        assert (row.n_words, spread, sorted(row["items"]), row.hit) == (words, hit, found, len(hit)), row


def test_digest(spark):
    out = spark.createDataFrame([(["10", "9"],), ([],)], "items array<string>").select(items_digest()).collect()
    assert [r[0] for r in out] == [hashlib.sha256(x).hexdigest() for x in (b"10,9", b"")]


def test_stretches_are_cut_and_documents_removed(spark):
    item = " ".join(f"q{k}" for k in range(12))
    long = f"Keep é this, {item.upper()}. " + "and a good deal more of text that nobody asked for, in fact far more words"
    docs = spark.createDataFrame([(1, long, "x", 5), (2, item, "x", 5), (3, None, "x", None), (4, "fine", "x", 4)], DOCS)
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in without_overlaps(docs, items).collect()}
    assert set(got) == {1, 3, 4} and got[1].asDict().keys() == {"doc_id", "text", "items", "n_chars"}
    assert got[1].text == long.replace(item.upper(), "") and got[1].n_chars == len(got[1].text)
    assert got[3].text is None and got[4].n_chars == 4
    assert without_overlaps(docs.limit(0), items).count() == 0 and without_overlaps(docs, items.limit(0)).count() == 4
