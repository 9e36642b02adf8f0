"""Sharding: sizes, gapless numbers, balance and the versions of the map."""

from __future__ import annotations

import random
import zlib

from lamella.llm.sharding import Slots, dealt, rebalanced, shard_documents

DOCS = "doc_id long, text string, shard string, slot string"


def check(rows, documents, shards):
    texts = {d: (t or "").encode() for d, t in documents}
    filled, load = {}, [0] * shards
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        assert (r.law, r.grown_shard) == ("bytes", None)
        filled.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(slots) == list(range(len(slots))) for slots in filled.values())
    assert len(rows) == len(documents) and set(filled) <= set(range(shards))
    return load


def test_balance_and_numbers(spark, folder):
    pick = random.Random(5)
    documents = [(k, pick.choice(["é", "x", "yz"]) * pick.randrange(3000)) for k in range(3000)]
    documents += [(3000 + k, "the same text") for k in range(1500)] + [(5000, None), (5001, "")]
    df = spark.createDataFrame([(d, t, "clash", "clash") for d, t in documents], DOCS)
    load = check(shard_documents(df, map_path=folder).collect(), documents, 40)
    assert max(load) - min(load) < 0.01 * sum(load) / 40
    versions = spark.read.parquet(f"{folder}/version=1").join(spark.read.parquet(f"{folder}/version=2"), "virtual_slot")
    assert versions.count() == 8192


def test_given_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = check(shard_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()], 40)
    assert max(load) < 1.02 * sum(load) / 40


def test_a_quarter_of_all_rows_alike(spark, folder):
    pick = random.Random(8)
    documents = [(k, "x" * pick.randrange(400)) for k in range(9000)]
    df = spark.createDataFrame([(d, t, "", "") for d, t in documents] + [(None, "the same text without an id", "", "")] * 3000, DOCS)
    df = df.union(spark.createDataFrame([(7, "y" * 1_000_000, "", "")], DOCS))
    out = shard_documents(df.where("doc_id is null or length(text) < 1000").repartition(5), map_path=folder)
    rows = out.collect()
    load, slots = [0] * 40, {}
    for r in rows:
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 12000 and max(load) - min(load) < 0.02 * sum(load) / 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.virtual_slot for r in rows if r.doc_id is None}) > 1000
    assert shard_documents(df).count() == 12001  # one very long text


def test_null_ids_repeated_rows_and_nothing(spark):
    df = spark.createDataFrame([(None, "a", "", ""), (None, "a", "", ""), (1, None, "", ""), (1, None, "", "")], DOCS)
    out = shard_documents(df, Slots(shards=3, slots=16)).collect()
    places = [(r.shard, r.slot) for r in out]
    assert len(out) == 4 and len(set(places)) == 4 and sorted(r.size for r in out) == [16, 16, 17, 17]
    assert shard_documents(df.limit(0)).count() == 0


def test_rebalancing_moves_few_slots():
    sizes = [100] * 64
    sizes[0] = 300
    before = dealt(64, 4)
    after = rebalanced(before, sizes, 4)
    assert sum(a != b for a, b in zip(before, after)) <= 4
    load = [sum(s for s, x in zip(sizes, after) if x == shard) for shard in range(4)]
    assert max(load) - min(load) <= 200
