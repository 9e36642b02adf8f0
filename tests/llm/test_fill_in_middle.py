"""Fill-in-the-middle: ranks of the skip list and whole rows against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from lamella.llm.fill_in_middle import FAN, FillInMiddle, SkipList, restored, transform, unit_edges

DOCS = "doc_id long, text string, form string, n string"


def plain(doc_id, text, how=FillInMiddle()):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - how.plain_percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < how.suffix_first_percent:
        return (doc_id, len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}")
    return (doc_id, len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_every_rank_is_reached_exactly():
    pick = random.Random(1)
    for n in [0, 1, 2, FAN, FAN + 1, FAN**2 - 1, FAN**2, FAN**2 + 1, FAN**3 + 7]:
        text = "".join(pick.choice(["ab", "C", " ", "é", "😀", "\n", "1"]) for _ in range(n))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        lanes = SkipList(unit_edges(text))
        assert lanes.n == len(units)
        passed = [0]
        for unit in units:
            passed.append(passed[-1] + len(unit))
        assert [lanes.code_points(rank) for rank in range(len(units) + 1)] == passed
        assert all(len(widths) <= len(units) / FAN**k + 1 for k, (widths, _) in enumerate(lanes.lanes))


def test_rows_and_round_trip(spark):
    pick = random.Random(2)
    pieces = ["word", " ", "é", "<P>", "<", "S>", "<M", ">", "\n", "😀", "x1"]
    docs = [(k, "".join(pick.choice(pieces[:3] + pieces[4:]) for _ in range(pick.randrange(40)))) for k in range(400)]
    docs += [(k, "a" + pick.choice(["<P>", "<S>", "<M>"])) for k in range(400, 420)]
    docs += [(None, "no id at all"), (None, None), (7, None), (7, "again 7"), (7, "again 7"), (8, "")]
    docs += [(9000, "long word " * 300_000), (9001, "x" * 2_000_000), (9002, "é" * 1_000_000)]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], DOCS)
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    out = transform(df).select("*", restored(F.col("form"), F.col("output")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in out), key=key) == sorted((plain(*d) for d in docs), key=key)
    assert sorted(r.back for r in out) == sorted(t or "" for _, t in docs)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert transform(df.limit(0)).count() == 0


def test_shares_of_forms_are_parameters(spark):
    df = spark.createDataFrame([(k, "some text", "", "") for k in range(200)], DOCS)
    forms = lambda *a: {r.form for r in transform(df, FillInMiddle(*a)).collect()}
    assert forms(5, 100, 20) == {"plain"} and forms(5, 0, 100) == {"spm"} and forms(5, 0, 0) == {"psm"}
