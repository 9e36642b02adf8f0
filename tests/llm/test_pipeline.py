"""The pipeline, stage by stage, against the plain Python versions of the operators."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from lamella.llm.rows import hold
from tests.llm.test_decontamination import by_hand as overlaps_by_hand
from tests.llm.test_near_duplicates import by_hand as components_by_hand
from tests.llm.test_packing import check as check_packing
from tests.llm.test_pii import base_by_hand as personal_by_hand
from tests.llm.test_quality import base_by_hand as quality_by_hand

SF_DIR = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    tables = {"documents": spark.read.parquet(f"{SF_DIR}/documents.parquet")}
    docs = tables["documents"]
    for name, stage in corpus_pipeline.STAGES:
        docs = tables[name] = hold(stage(spark, docs, SF_DIR), name)
    return {name: {r.doc_id: r for r in t.collect()} if name != "packing" else t.collect() for name, t in tables.items()} | {
        "columns": {name: t.columns for name, t in tables.items()}
    }


def test_columns(stages):
    assert all(c == COLUMNS for name, c in stages["columns"].items() if name != "packing")


def test_quality(stages, spark):
    before, after = stages["documents"], stages["quality_rules"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    failed = {d for d, r in before.items() if quality_by_hand(r.text)[-1]}
    assert not failed & set(after) and all(after[d] == before[d] for d in after)
    clean = {d for d, r in labels.items() if r.quality == 1 and r.toxic == 0} - failed
    assert len(clean & set(after)) >= 0.98 * len(clean)


def test_near_duplicates(stages):
    before, after = stages["quality_rules"], stages["near_duplicates"]
    expected = {d for d, _, _, kept in components_by_hand([(d, r.text) for d, r in before.items()]) if kept}
    assert set(after) == expected and all(after[d] == before[d] for d in after)


def test_decontamination(stages, spark):
    before, after = stages["near_duplicates"], stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    for doc_id, r in before.items():
        n, hit, _ = overlaps_by_hand(r.text, items)
        assert (doc_id in after) == (2 * len(hit) <= n)
        if doc_id in after:
            left = after[doc_id]
            assert left.n_chars == len(left.text) and (left == r if not hit else len(left.text) < len(r.text))


def test_personal_data(stages):
    before, after = stages["decontamination"], stages["personal_data"]
    assert set(before) == set(after)
    for doc_id, r in after.items():
        assert personal_by_hand(r.text)[1] == "" and r.n_chars == len(r.text)
        if not personal_by_hand(before[doc_id].text)[1] and "[" not in r.text:
            assert r == before[doc_id]


def test_packing(stages):
    documents = [(d, r.text) for d, r in stages["personal_data"].items()]
    check_packing(stages["packing"], documents)


def test_run_gives_the_same(stages, spark):
    assert corpus_pipeline.run(spark, SF_DIR).select("doc_id", "piece", "ids_crc32").distinct().count() == len(stages["packing"])


def small_tables(spark, folder, documents, labels, benchmark):
    """Tables of the three kinds, documents with columns that clash with names inside the operators."""
    clash = "n_chars long, kept string, node long, spans string, _text string, piece int, label string, `a.b` string"
    values = (7, "k", 1, "s", "t", 2, "l", "d")
    rows = [(d, t, "en", "web", *values) for d, t in documents]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {clash}").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_nulls_long_texts_repeated_rows_and_clashing_columns(spark, folder):
    pick = random.Random(11)
    prose = lambda n, salt: " ".join(f"{salt}{pick.randrange(10_000)}" for _ in range(n))
    item = prose(30, "item")
    documents = [(k, prose(80, "w")) for k in range(30)] + [(None, prose(70, "x")), (None, None), (40, None), (41, ""), (42, " ")]
    documents += [(50, documents[3][1])] * 3 + [(51, documents[3][1] + " tail"), (None, documents[3][1])]
    documents += [(60, prose(400_000, "l")), (61, "7" * 300_000), (62, prose(90, "y") + " " + item), (63, prose(90, "z") + " mail a.b@c.de"), (60, prose(60, "v"))]
    labels = [(0, 1, 0), (0, 1, 0), (1, None, None), (None, 0, 1), (99, 0, 0)]
    small_tables(spark, folder, documents, labels, [(1, item), (None, item), (2, None), (1, item)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, hold(stage(spark, docs, folder), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    # nulls, blanks and the text of one word go; then the copies with an id and the near copy. Rows without an id stay
    # together, and one of them is no copy
    assert sizes[:4] == [40, 36, 36, 36]
    texts = {r.doc_id: r.text for r in before.collect() if r.doc_id in (62, 63)}
    assert item not in texts[62] and texts[63].endswith(" mail [EMAIL]")
    check_packing([r for r in docs.collect() if r.doc_id not in (None, 60)], [(r.doc_id, r.text) for r in before.collect() if r.doc_id not in (None, 60)])


def test_empty_tables(spark, folder):
    small_tables(spark, folder, [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
