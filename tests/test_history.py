from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lamella.operators.history import VALID_FROM, VALID_TO, as_of, current, scd1, scd2, split_null_keys, temporal_join
from lamella.operators.skew import SkewPolicy, sketch_keys, with_slices

from .conftest import rows

SLICED = SkewPolicy(min_rows=3)
PLANS = pytest.mark.parametrize("skew", [None, SkewPolicy(), SLICED], ids=["plain", "checked", "sliced"])


def events(spark, data, schema="k string, seq int, v string"):
    return spark.createDataFrame(data, schema)


def spans(df):
    return rows(df, "k", "v", "_valid_from", "_valid_to")


@PLANS
def test_late_event_splits_a_version(spark, skew):
    df = events(spark, [("a", 10, "A"), ("a", 20, "A"), ("a", 30, "B"), ("a", 15, "B")])
    got = spans(scd2(df, ["k"], "seq", skew=skew))
    assert sorted(got, key=lambda r: r[2]) == [
        ("a", "A", 10, 15), ("a", "B", 15, 20), ("a", "A", 20, 30), ("a", "B", 30, None),
    ]


@PLANS
def test_untracked_change_opens_no_version_and_shows_the_latest_value(spark, skew):
    df = events(spark, [("a", n, "A", n * 10) for n in range(1, 9)], "k string, seq int, v string, u int")
    got = scd2(df, ["k"], "seq", untracked=["u"], skew=skew)
    assert rows(got, "v", "u", "seq", "_valid_from", "_valid_to") == [("A", 80, 8, 1, None)]


@PLANS
def test_null_is_a_value(spark, skew):
    df = events(spark, [("a", 1, "A"), ("a", 2, None), ("a", 3, None), ("a", 4, "A")])
    got = scd2(df, ["k"], "seq", skew=skew)
    assert sorted(rows(got, "_valid_from", "_valid_to", "v")) == [(1, 2, "A"), (2, 4, None), (4, None, "A")]


@PLANS
def test_duplicates_and_ties(spark, skew):
    schema = "k string, seq int, tie int, v string"
    df = events(spark, [("a", 1, 1, "A"), ("a", 1, 2, "B"), ("a", 1, 2, "B"), ("a", 2, 1, "C")] * 3, schema)
    got = scd2(df, ["k"], "seq", tie_break=["tie"], skew=skew)
    assert spans(got) == [("a", "B", 1, 2), ("a", "C", 2, None)]


def test_tie_without_a_tie_break_is_stable(spark):
    data = [("a", 1, v) for v in "QWERTY"]
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(data)
        seen.add(tuple(spans(scd2(events(spark, data).repartition(3), ["k"], "seq", skew=None))))
    assert len(seen) == 1


def test_nulls_in_key_or_sequence_are_set_apart(spark):
    df = events(spark, [("a", 1, "A"), (None, 1, "A"), ("b", None, "A")])
    good, bad = split_null_keys(df, ["k"], "seq")
    assert (good.count(), bad.count()) == (1, 2)
    assert scd2(df, ["k"], "seq").count() == 1
    pairs = events(spark, [("a", None, 1, "x"), ("a", "b", 1, "x")], "k1 string, k2 string, seq int, v string")
    assert rows(split_null_keys(pairs, ["k1", "k2"], "seq")[1], "k1", "k2") == [("a", None)]


def test_dropped_sequence_still_orders(spark):
    df = events(spark, [("a", 2, "B"), ("a", 1, "A")])
    got = scd2(df, ["k"], "seq", drop=["seq"])
    assert "seq" not in got.columns
    assert spans(got) == [("a", "A", 1, 2), ("a", "B", 2, None)]


def test_no_tracked_column_gives_one_version_with_the_latest_values(spark):
    df = events(spark, [("a", 1, "A"), ("a", 2, "B")])
    assert spans(scd2(df, ["k"], "seq", untracked=["v"])) == [("a", "B", 1, None)]


def test_map_columns_can_be_carried(spark):
    df = spark.sql("select * from values ('a', 1, map('x', 1)), ('a', 2, map('x', 2)) as t(k, seq, m)")
    assert scd2(df, ["k"], "seq", untracked=["m"]).first().m == {"x": 2}
    assert scd2(df, ["k"], "seq", untracked=["m"], skew=SkewPolicy(min_rows=1)).first().m == {"x": 2}
    assert scd1(df, ["k"], "seq").first().m == {"x": 2}


def test_wrong_names_are_errors(spark):
    df = events(spark, [("a", 1, "A")])
    with pytest.raises(ValueError, match="not found"):
        scd2(df, ["nope"], "seq")
    with pytest.raises(ValueError, match="key"):
        scd2(df, [], "seq")
    with pytest.raises(ValueError, match="dropped"):
        scd2(df, ["k"], "seq", drop=["k"])


def test_empty_input(spark):
    got = scd2(events(spark, []), ["k"], "seq")
    assert got.count() == 0
    assert got.columns == ["k", "seq", "v", "_valid_from", "_valid_to", "_is_current"]


def brute_force(data):
    """Versions of (k, seq, tie, v, u) events, one key and one event at a time."""
    out = []
    for key in {e[0] for e in data}:
        last = {}
        for e in sorted(e for e in data if e[0] == key):
            last[e[1]] = e
        runs = []
        for e in (last[s] for s in sorted(last)):
            if runs and runs[-1][1][3] == e[3]:
                runs[-1][1] = e
            else:
                runs.append([e[1], e])
        ends = [r[0] for r in runs[1:]] + [None]
        out += [(key, e[3], e[4], start, end) for (start, e), end in zip(runs, ends)]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_any_arrival_order_matches_brute_force(spark, seed):
    rng = random.Random(seed)
    # one key has about a third of the events
    data = [
        (rng.choice(["hot"] * 4 + list("abcdefgh")), rng.randrange(60), rng.randrange(4), rng.choice("XYZ"), n)
        for n in range(400)
    ]
    unique = list({e[:3]: e for e in data}.values())
    rng.shuffle(unique)
    df = events(spark, unique, "k string, seq int, tie int, v string, u int").repartition(5)
    want = brute_force(unique)
    for skew in (None, SkewPolicy(min_rows=20), SLICED):
        got = scd2(df, ["k"], "seq", tie_break=["tie"], untracked=["u"], skew=skew)
        assert sorted(rows(got, "k", "v", "u", "_valid_from", "_valid_to"), key=str) == want


def test_intervals_have_no_gap_and_one_open_end(spark):
    rng = random.Random(7)
    data = [(rng.choice("abc"), rng.randrange(1000), rng.choice("XY")) for _ in range(300)]
    got = rows(scd2(events(spark, data), ["k"], "seq"), "k", "_valid_from", "_valid_to")
    for key in "abc":
        mine = sorted((r[1:] for r in got if r[0] == key), key=lambda r: r[0])
        assert [end for _, end in mine[:-1]] == [start for start, _ in mine[1:]]
        assert mine[-1][1] is None


def test_only_one_shuffle_and_sort(spark):
    df = spark.range(100).selectExpr("id % 7 as k", "id as seq", "id % 3 as v", "id as u")
    plan = scd2(df, ["k"], "seq", untracked=["u"], skew=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_scd1_keeps_the_last_by_sequence_and_tie(spark):
    df = events(spark, [("a", 2, "B"), ("a", 1, "A"), ("b", 1, "C"), (None, 9, "D")])
    assert rows(scd1(df, ["k"], "seq")) == [("a", 2, "B"), ("b", 1, "C")]
    assert rows(scd1(df, ["k"], "seq", drop=["seq"])) == [("a", "B"), ("b", "C")]


def test_as_of_is_half_open(spark):
    history = scd2(events(spark, [("a", 10, "A"), ("a", 20, "B")]), ["k"], "seq")
    assert [rows(as_of(history, t), "v") for t in (9, 10, 19, 20)] == [[], [("A",)], [("A",)], [("B",)]]
    assert rows(current(history), "v") == [("B",)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("skew", [None, SkewPolicy(min_rows=10), SLICED], ids=["plain", "some", "sliced"])
def test_temporal_join_matches_a_range_join(spark, how, skew):
    rng = random.Random(3)
    keys = ["hot"] * 4 + list("abcd") + [None]
    history = scd2(
        events(spark, [(rng.choice(keys[:-1]), rng.randrange(20, 200), rng.choice("XYZ")) for _ in range(120)]),
        ["k"], "seq", drop=["seq"], skew=None,
    ).drop("_is_current")
    # many facts at one moment of the large key, and keys without history
    facts = [(rng.choice(keys + ["none"]), rng.randrange(0, 220), n) for n in range(150)]
    facts += [("hot", 100, 1000)] * 60
    facts = events(spark, facts, "k string, at int, n int")
    h = history.withColumnRenamed("k", "hk")
    inside = (F.col("k") == F.col("hk")) & (F.col("_valid_from") <= F.col("at"))
    inside &= F.col("_valid_to").isNull() | (F.col("at") < F.col("_valid_to"))
    want = facts.join(h, inside, how).drop("hk")
    got = temporal_join(facts, history, ["k"], "at", how=how, skew=skew)
    assert rows(got, *want.columns) == rows(want)


def test_slices_follow_the_order_and_are_balanced(spark):
    df = spark.range(8000).selectExpr("0 as k", "id * 7 % 8000 as seq")
    per_slice = with_slices(df, ["k", "seq"], 8).groupBy("_slice").agg(F.min("seq"), F.max("seq"), F.count("*")).collect()
    got = sorted(tuple(r) for r in per_slice)
    assert len(got) == 8 and max(r[3] for r in got) < 3000
    assert all(a[2] < b[1] for a, b in zip(got, got[1:]))


def test_hot_keys_are_found_and_sketches_add_up(spark):
    df = spark.range(1000).selectExpr("if(id < 400, 0, id) as k")
    found = sketch_keys(df, ["k"], SkewPolicy(min_rows=100))
    assert found.rows == 1000 and list(found.counts.values()) == [400]
    assert found.hot().rows == 400 and found.hot().slices == 4
    twice = found + sketch_keys(df.selectExpr("cast(k as int) as k"), ["k"], SkewPolicy(min_rows=100))
    assert twice.rows == 2000 and twice.hot().rows == 800 and twice.hot().hashes == found.hot().hashes
    assert sketch_keys(df, ["k"], SkewPolicy(min_rows=500)).hot() is None
    assert sketch_keys(df.limit(0), ["k"], SkewPolicy(min_rows=0)).hot() is None
    assert sketch_keys(spark.range(100_000), ["id"], SkewPolicy(min_rows=50, tracked=256)).hot() is None


def counted(spark, df):
    """The rows, and a count of how often rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_a_sketch_handed_on_spares_passes_over_the_input(spark):
    plain = spark.range(6000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as seq", "id % 7 as v").repartition(4)
    want = rows(scd2(plain, ["k"], "seq", skew=None))
    policy = SkewPolicy(min_rows=500)
    sketch = sketch_keys(plain, ["k"], policy)
    passes = {}
    for name, skew in (("none", None), ("policy", policy), ("sketch", sketch)):
        df, seen = counted(spark, plain)
        assert rows(scd2(df, ["k"], "seq", skew=skew)) == want
        passes[name] = seen.value / 6000
    assert passes == {"none": 1, "policy": 3, "sketch": 2}


def test_a_lazy_history_is_computed_once_for_a_large_key(spark):
    events_ = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) as k", "id as seq", "id % 7 as v")
    facts = spark.range(2000).selectExpr("if(id % 2 = 0, 0, id % 50) as k", "id as at", "id as n")
    plain = scd2(events_, ["k"], "seq", skew=None).select("k", "v", VALID_FROM, VALID_TO)
    want = rows(temporal_join(facts, plain, ["k"], "at", skew=None))
    policy = SkewPolicy(min_rows=300)
    sketch = sketch_keys(facts, ["k"], policy) + sketch_keys(events_, ["k"], policy)
    df, seen = counted(spark, plain)
    assert rows(temporal_join(facts, df, ["k"], "at", skew=sketch)) == want
    assert seen.value == plain.count()
