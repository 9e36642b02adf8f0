from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lamella.operators.history import VALID_FROM, VALID_TO, scd1, scd2
from lamella.operators.skew import SkewPolicy
from lamella.sources.schemas import SchemaConflict
from lamella.streaming.silver import SilverTable

from .conftest import rows

SCHEMA = "k string, seq int, tie int, v string, u int"
ROLES = dict(tie_break=["tie"], untracked=["u"])


def silver(spark, folder, **more):
    return SilverTable(spark, f"{folder}/silver", ["k"], "seq", **{**ROLES, "buckets": 2, **more})


def random_events(seed, n=300):
    rng = random.Random(seed)
    made = [
        (rng.choice(["hot"] * 4 + list("abcdefgh")), rng.randrange(80), rng.randrange(3), rng.choice("XYZ"), i)
        for i in range(n)
    ]
    return list({e[:3]: e for e in made}.values())


def test_late_event_falls_inside_a_collapsed_version(spark, folder):
    table = silver(spark, folder)
    table.apply(spark.createDataFrame([("a", 10, 0, "A", 1), ("a", 20, 0, "A", 2), ("a", 30, 0, "B", 3)], SCHEMA), 0)
    assert len(rows(table.read(spark))) == 2
    table.apply(spark.createDataFrame([("a", 15, 0, "B", 9)], SCHEMA), 1)
    got = sorted(rows(table.read(spark), "_valid_from", "_valid_to", "v", "u"))
    assert got == [(10, 15, "A", 1), (15, 20, "B", 9), (20, 30, "A", 2), (30, None, "B", 3)]


PLAIN, SLICED = SkewPolicy(), SkewPolicy(min_rows=10)


@pytest.mark.parametrize(
    "order, skew", [("random", PLAIN), ("random", SLICED), ("slightly late", PLAIN), ("descending", SLICED)]
)
def test_batches_equal_a_full_recompute(spark, folder, order, skew):
    data = random_events(len(order))
    rng = random.Random(1)
    if order == "random":
        rng.shuffle(data)
    else:
        noise = 12 if order == "slightly late" else 0
        data.sort(key=lambda e: e[1] + rng.randint(0, noise), reverse=order == "descending")
    table = silver(spark, folder, skew=skew)
    size = len(data) // 3 + 1
    for n in range(3):
        table.apply(spark.createDataFrame(data[n * size : (n + 1) * size], SCHEMA), n)
    want = scd2(spark.createDataFrame(data, SCHEMA), ["k"], "seq", **ROLES, skew=None)
    assert rows(table.read(spark)) == rows(want)
    assert rows(table.current(spark)) == rows(want.where("_is_current"))


def test_replayed_batch_changes_nothing_and_a_new_stream_does(spark, folder):
    table = silver(spark, folder)
    first = spark.createDataFrame([("a", 1, 0, "A", 1)], SCHEMA)
    assert table.apply(first, 0, "s1")
    before = rows(table.read(spark))
    assert not table.apply(first, 0, "s1")
    assert rows(table.read(spark)) == before
    # another stream starts to number at 0 again; the same event once more is a duplicate
    assert table.apply(first, 0, "s2")
    assert rows(table.read(spark)) == before


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, folder, monkeypatch):
    table = silver(spark, folder)
    table.apply(spark.createDataFrame([("a", 1, 0, "A", 1)], SCHEMA), 0)
    before = rows(table.read(spark))
    batch = spark.createDataFrame([("a", 2, 0, "B", 2)], SCHEMA)
    with monkeypatch.context() as m:
        m.setattr(table._log, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(batch, 1)
    again = silver(spark, folder)
    assert rows(again.read(spark)) == before
    again.apply(batch, 1)
    assert len(rows(again.read(spark))) == 2


def test_null_keys_are_quarantined_and_counted(spark, folder):
    table = silver(spark, folder)
    table.apply(spark.createDataFrame([("a", 1, 0, "A", 1), (None, 1, 0, "A", 2), ("b", None, 0, "A", 3)], SCHEMA), 0)
    table.apply(spark.createDataFrame([(None, 2, 0, "A", 4)], SCHEMA), 1)
    assert rows(table.quarantined(spark), "u") == [(2,), (3,), (4,)]
    assert rows(table.read(spark), "k") == [("a",)]


def test_empty_batch(spark, folder):
    table = silver(spark, folder)
    table.apply(spark.createDataFrame([], SCHEMA), 0)
    assert table.read(spark).count() == 0
    table.apply(spark.createDataFrame([("a", 1, 0, "A", 1)], SCHEMA), 1)
    table.apply(spark.createDataFrame([], SCHEMA), 2)
    assert table.read(spark).count() == 1


def test_a_column_added_later_is_null_before(spark, folder):
    table = silver(spark, folder)
    table.apply(spark.createDataFrame([("a", 1, 0, "A", 1), ("b", 1, 0, "A", 1)], SCHEMA), 0)
    table.apply(spark.createDataFrame([("a", 2, 0, "A", 2, "new")], SCHEMA + ", extra string"), 1)
    got = rows(table.read(spark), "k", "_valid_from", "_valid_to", "extra")
    assert got == [("a", 1, 2, None), ("a", 2, None, "new"), ("b", 1, None, None)]


def test_type_1_ignores_late_events(spark, folder):
    data = random_events(5)
    table = silver(spark, folder, scd_type=1)
    for n in (2, 0, 1):
        table.apply(spark.createDataFrame(data[n::3], SCHEMA), {2: 0, 0: 1, 1: 2}[n])
    want = scd1(spark.createDataFrame(data, SCHEMA), ["k"], "seq", tie_break=["tie"])
    assert rows(table.read(spark)) == rows(want)


def test_compaction_and_vacuum_keep_the_content(spark, folder):
    data = sorted(random_events(9), key=lambda e: e[1])
    table = silver(spark, folder)
    size = len(data) // 6 + 1
    for n in range(5):
        table.apply(spark.createDataFrame(data[n * size : (n + 1) * size], SCHEMA), n)
    before = rows(table.read(spark))
    table.compact(spark, keep=1)
    assert rows(table.read(spark)) == before
    assert table.vacuum(keep_commits=1) > 0
    assert rows(table.read(spark)) == before
    # a late batch on top of the compacted table
    table.apply(spark.createDataFrame(data[5 * size :] + [("a", 0, 0, "late", 1)], SCHEMA), 5)
    want = scd2(spark.createDataFrame(data + [("a", 0, 0, "late", 1)], SCHEMA), ["k"], "seq", **ROLES, skew=None)
    assert rows(table.read(spark)) == rows(want)


def test_stream_restarts_with_its_checkpoint(spark, folder):
    data = random_events(4)
    table = silver(spark, folder)
    for n in range(2):
        spark.createDataFrame(data[n::2], SCHEMA).write.mode("append").parquet(f"{folder}/files")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(f"{folder}/files")
        table.start(stream, f"{folder}/checkpoint")
    want = scd2(spark.createDataFrame(data, SCHEMA), ["k"], "seq", **ROLES, skew=None)
    assert rows(table.read(spark)) == rows(want)


def test_wrong_type_is_an_error(spark, folder):
    with pytest.raises(ValueError, match="scd_type"):
        silver(spark, folder, scd_type=3)


def test_late_batch_rewrites_only_the_generations_it_touches(spark, folder):
    table = silver(spark, folder, buckets=2)
    for n in range(4):
        made = [(f"k{i}", 100 * n + s, 0, "XY"[s % 2], 0) for i in range(8) for s in range(6)]
        table.apply(spark.createDataFrame(made, SCHEMA), n)
    table.apply(spark.createDataFrame([("k1", 301, 1, "Z", 1)], SCHEMA), 4)
    closed = table._state()[1]["closed"]
    assert [bool(gone) for gone in closed.values()] == [False, False, False, True, False]
    assert table.read(spark).where(F.col("v") == "Z").count() == 1


def test_integral_keys_may_change_their_type_and_others_not(spark, folder):
    def events(dtype, first):
        return spark.range(5).select(F.col("id").cast(dtype).alias("k"), (F.col("id") + first).alias("ts"), F.lit(first).alias("v"))

    table = SilverTable(spark, f"{folder}/t", ["k"], "ts", buckets=64)
    for batch, dtype in enumerate(("int", "bigint", "int", "smallint", "bigint")):
        table.apply(events(dtype, 10 * batch), batch)
        assert table.current(spark).count() == 5
    assert table.read(spark).count() == 25
    table.apply(events("int", 5), 5)  # late for every key
    assert table.current(spark).count() == 5 and table.read(spark).count() == 30
    with pytest.raises(SchemaConflict):
        table.apply(events("string", 90), 6)
    with pytest.raises(SchemaConflict):
        table.apply(events("double", 90), 6)


def test_dropped_columns_are_not_on_disk(spark, folder):
    table = SilverTable(spark, f"{folder}/t", ["k"], "ts", drop=["pii"])
    for batch in range(2):
        table.apply(spark.createDataFrame([("a", batch, batch, "secret")], "k string, ts int, v int, pii string"), batch)
    assert table.read(spark).count() == 2
    for part in ("log", "runs"):
        assert "pii" not in spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(f"{folder}/t/{part}").columns


def test_many_small_batches_leave_few_generations(spark, folder, monkeypatch):
    monkeypatch.setattr("lamella.streaming.silver.MERGED", 2)
    table = SilverTable(spark, f"{folder}/silver", ["k"], "seq", tracked=["v"], buckets=2)
    events = spark.range(130).selectExpr("id % 7 as k", "id as seq", "id % 3 as v")
    sizes = []
    for n in range(13):
        part = events.where((F.col("seq") >= n * 10) & (F.col("seq") < n * 10 + 10))
        if n % 5 == 4:
            part = part.union(spark.sql(f"select {n % 7}L, {n * 3}L, 9L"))  # a late event
        table.apply(part, n)
        state = table._state()[1]
        sizes.append((len(state["closed"]), len(state["log"]), len(str(state.get("tiers", {})))))
    assert max(c for c, _, _ in sizes) <= 8 and max(n for _, n, _ in sizes) <= 8 and max(t for _, _, t in sizes) < 400
    late = spark.createDataFrame([(n % 7, n * 3, 9) for n in range(4, 13, 5)], "k long, seq long, v long")
    every = events.union(late)
    assert rows(table.read(spark), "k", "v", VALID_FROM, VALID_TO) == rows(scd2(every, ["k"], "seq", tracked=["v"]), "k", "v", VALID_FROM, VALID_TO)
    assert table.vacuum() > 0 and table.read(spark).count() == scd2(every, ["k"], "seq", tracked=["v"]).count()
