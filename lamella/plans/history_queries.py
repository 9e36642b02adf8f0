"""Change capture over the event stream and the orders."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators.history import (
    INGESTED,
    VALID_FROM,
    VALID_TO,
    as_of,
    current,
    scd1,
    scd2,
    split_null_keys,
    temporal_join,
)
from lamella.operators.skew import KeySketch, SkewPolicy, sketch_keys
from lamella.plans.registry import query, table
from lamella.session import work_dir
from lamella.sources.export import write_files
from lamella.sources.files import FileSource
from lamella.sources.tables import stream_table
from lamella.streaming.bronze import ingest
from lamella.streaming.silver import SilverTable

EVENTS = ("event_id", "ts", "user_id", "event_type", "value", "props")
TYPES = dict(keys=["user_id"], sequence_by="ts", tie_break=["event_id"], tracked=["event_type"])


def versions_sql(source: str, keys: str, seq: str, tie: str, tracked: str, columns: str) -> str:
    """Versions by gaps and islands: number the changes of a key, group by that number.

    ``tracked`` may be empty: then a key has one version.
    """
    changed = f"{tracked} IS DISTINCT FROM lag({tracked}) OVER w" if tracked else "false"
    return f"""
    WITH latest AS (
      SELECT * FROM {source}
      QUALIFY row_number() OVER (PARTITION BY {keys}, {seq} ORDER BY {tie} DESC) = 1),
    marked AS (
      SELECT *, CASE WHEN row_number() OVER w = 1 OR {changed} THEN 1 ELSE 0 END AS changed
      FROM latest WINDOW w AS (PARTITION BY {keys} ORDER BY {seq})),
    numbered AS (
      SELECT *, sum(changed) OVER (PARTITION BY {keys} ORDER BY {seq} ROWS UNBOUNDED PRECEDING) AS ver FROM marked),
    starts AS (
      SELECT *, min({seq}) OVER (PARTITION BY {keys}, ver) AS _valid_from FROM numbered
      QUALIFY row_number() OVER (PARTITION BY {keys}, ver ORDER BY {seq} DESC) = 1)
    SELECT {columns}, _valid_from, lead(_valid_from) OVER k AS _valid_to, lead(_valid_from) OVER k IS NULL AS _is_current
    FROM starts WINDOW k AS (PARTITION BY {keys} ORDER BY _valid_from)
    """


EVENT_VERSIONS = versions_sql("events", "user_id", "ts", "event_id", "event_type", ", ".join(EVENTS))


def _day(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*EVENTS)


@query("scd2_events", EVENT_VERSIONS)
def scd2_events(spark, sf_dir):
    return scd2(_events(spark, sf_dir), **TYPES)


@query(
    "scd2_untracked",
    versions_sql(
        "(SELECT event_id, ts, user_id, value > 50 AS high, value FROM events)",
        "user_id", "ts", "event_id", "high", "event_id, ts, user_id, high, value",
    ),
)
def scd2_untracked(spark, sf_dir):
    """All columns are tracked but the ones named; a change of ``value`` alone opens no version."""
    events = _events(spark, sf_dir).select("event_id", "ts", "user_id", (F.col("value") > 50).alias("high"), "value")
    return scd2(events, ["user_id"], "ts", tie_break=["event_id"], untracked=["value"])


@query(
    "scd2_drop_columns",
    versions_sql("events", "user_id", "ts", "event_id", "event_type", "event_id, user_id, event_type"),
)
def scd2_drop_columns(spark, sf_dir):
    """The sequence column is among the dropped ones; it still orders and gives the validity."""
    return scd2(
        _events(spark, sf_dir), ["user_id"], "ts", tie_break=["event_id"], drop=["ts", "value", "props"]
    )


@query(
    "scd2_no_tracked_columns",
    versions_sql("events", "user_id", "ts", "event_id", "", ", ".join(EVENTS)),
)
def scd2_no_tracked_columns(spark, sf_dir):
    """As in the shipped configuration, where nearly all columns are excluded from tracking."""
    return scd2(
        _events(spark, sf_dir), ["user_id"], "ts", tie_break=["event_id"], untracked=["event_type", "value", "props"]
    )


@query(
    "scd2_composite_key",
    versions_sql("events", "user_id, event_type", "ts", "event_id", "props", ", ".join(EVENTS)),
)
def scd2_composite_key(spark, sf_dir):
    return scd2(
        _events(spark, sf_dir), ["user_id", "event_type"], "ts", tie_break=["event_id"], untracked=["value"]
    )


SKEWED = """
    (SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id END AS user_id, event_type, value, props
     FROM events)
"""


def _skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, a third of them under one key."""
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id"))
    return _events(spark, sf_dir).withColumn("user_id", hot)


def _sliced(events: DataFrame) -> KeySketch:
    """A limit that the large key is above at every size of the table."""
    found = sketch_keys(events, ["user_id"], SkewPolicy(min_rows=0))
    return KeySketch(SkewPolicy(min_rows=max(1, found.rows // 20)), found.rows, found.counts)


@query("scd2_skewed_key", versions_sql(SKEWED, "user_id", "ts", "event_id", "event_type", ", ".join(EVENTS)))
def scd2_skewed_key(spark, sf_dir):
    """A third of the rows under one key: that key is cut into slices."""
    events = _skewed(spark, sf_dir)
    return scd2(events, **TYPES, skew=_sliced(events))


def _apply_in(spark: SparkSession, batches: list[DataFrame], **parameters) -> SilverTable:
    silver = SilverTable(spark, work_dir(spark, "silver"), buckets=8, **{**TYPES, **parameters})
    for number, batch in enumerate(batches):
        silver.apply(batch, number)
    return silver


@query("scd2_late_events", EVENT_VERSIONS)
def scd2_late_events(spark, sf_dir):
    """The newest events arrive first, then the oldest, then those in between; one batch twice."""
    events = _events(spark, sf_dir)
    old, new = F.col("ts") < _day("2024-01-10"), F.col("ts") >= _day("2024-01-20")
    silver = _apply_in(spark, [events.where(new), events.where(old), events.where(~old & ~new)])
    silver.apply(events.where(old), 1)
    return silver.read(spark)


@query("scd2_incremental", EVENT_VERSIONS)
def scd2_incremental(spark, sf_dir):
    """Files to bronze to silver as streams, with events spread over three arrivals."""
    events = _events(spark, sf_dir)
    root = work_dir(spark, "scd2-incremental")
    silver = SilverTable(spark, f"{root}/silver", buckets=8, **TYPES)
    source = FileSource(f"{root}/files", "parquet", schema=events.schema)
    for arrival in range(3):
        write_files(events.where(F.col("event_id") % 3 == arrival), f"{root}/files", "parquet")
        ingest(spark, source, f"{root}/bronze", f"{root}/bronze-checkpoint")
        silver.start(stream_table(spark, f"{root}/bronze").drop(INGESTED), f"{root}/silver-checkpoint")
    return silver.read(spark)


@query("scd2_incremental_key_widened", EVENT_VERSIONS)
def scd2_incremental_key_widened(spark, sf_dir):
    """The key arrives as int, then as bigint, then as int again."""
    events = _events(spark, sf_dir)
    stored = events.schema["user_id"].dataType
    batches = [
        events.where(F.col("event_id") % 3 == n).withColumn("user_id", F.col("user_id").cast(dtype))
        for n, dtype in enumerate(("int", "bigint", "int"))
    ]
    history = _apply_in(spark, batches).read(spark)
    return history.withColumn("user_id", F.col("user_id").cast(stored))


@query(
    "scd1_incremental",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def scd1_incremental(spark, sf_dir):
    events = _events(spark, sf_dir)
    batches = [events.where(F.col("event_id") % 3 == n) for n in (2, 0, 1)]
    return _apply_in(spark, batches, scd_type=1, tracked=None).read(spark)


@query(
    "scd2_default_sequence",
    """
    WITH arrived AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 1 ELSE 2 END AS arrival FROM events),
    last AS (
      SELECT * FROM arrived
      QUALIFY row_number() OVER (PARTITION BY user_id, arrival ORDER BY event_id DESC) = 1),
    compared AS (
      SELECT *, lag(event_type) OVER u AS before, lead(event_type) OVER u AS after
      FROM last WINDOW u AS (PARTITION BY user_id ORDER BY arrival))
    SELECT user_id, event_type, before IS NULL AS opened_first, after IS NULL OR after = event_type AS _is_current
    FROM compared WHERE before IS DISTINCT FROM event_type
    """,
)
def scd2_default_sequence(spark, sf_dir):
    """Ordered by ingestion time: all events of a micro-batch share it, the tie break decides."""
    events = _events(spark, sf_dir)
    root = work_dir(spark, "scd2-default-sequence")
    source = FileSource(f"{root}/files", "parquet", schema=events.schema, max_files=1_000_000)
    first = F.col("ts") < _day("2024-01-16")
    for arrival in (first, ~first):
        write_files(events.where(arrival), f"{root}/files", "parquet")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    bronze = spark.read.parquet(f"{root}/bronze")
    history = scd2(bronze, ["user_id"], tie_break=["event_id"], tracked=["event_type"])
    opened = history.groupBy("user_id").agg(F.min(VALID_FROM).alias("_opened"))
    return history.join(opened, "user_id").select(
        "user_id", "event_type", (F.col(VALID_FROM) == F.col("_opened")).alias("opened_first"), "_is_current"
    )


@query(
    "scd2_external_source",
    versions_sql(
        "orders", "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus",
        "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    ),
)
def scd2_external_source(spark, sf_dir):
    """History over a table that no bronze step wrote; orders of one day are ties."""
    return scd2(
        table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", tie_break=["o_orderkey"], tracked=["o_orderstatus"]
    )


@query("scd2_duplicates", EVENT_VERSIONS)
def scd2_duplicates(spark, sf_dir):
    events = _events(spark, sf_dir)
    return scd2(events.unionByName(events), **TYPES)


@query("scd2_quarantine", "SELECT event_id, event_id % 50 = 0 OR event_id % 70 = 1 AS quarantined FROM events")
def scd2_quarantine(spark, sf_dir):
    """Nulls put into keys and sequences; both sides of the split are returned."""
    broken = _events(spark, sf_dir).withColumns(
        {
            "user_id": F.when(F.col("event_id") % 50 != 0, F.col("user_id")),
            "ts": F.when(F.col("event_id") % 70 != 1, F.col("ts")),
        }
    )
    good, bad = split_null_keys(broken, ["user_id"], "ts")
    return good.select("event_id", F.lit(False).alias("quarantined")).unionByName(
        bad.select("event_id", F.lit(True).alias("quarantined"))
    )


@query(
    "scd1_latest",
    "SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def scd1_latest(spark, sf_dir):
    return scd1(_events(spark, sf_dir), ["user_id"], "ts", tie_break=["event_id"])


@query("scd2_current", f"SELECT * FROM ({EVENT_VERSIONS}) WHERE _valid_to IS NULL")
def scd2_current(spark, sf_dir):
    return current(scd2(_events(spark, sf_dir), **TYPES))


@query(
    "scd2_as_of",
    f"""
    SELECT * FROM ({EVENT_VERSIONS})
    WHERE _valid_from <= TIMESTAMP '2024-01-15' AND (_valid_to IS NULL OR TIMESTAMP '2024-01-15' < _valid_to)
    """,
)
def scd2_as_of(spark, sf_dir):
    return as_of(scd2(_events(spark, sf_dir), **TYPES), datetime(2024, 1, 15))


def _join_purchases(events: DataFrame, skew: KeySketch) -> DataFrame:
    """Each purchase with what its user did last before it."""
    purchases = events.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value")
    history = scd2(events.where(F.col("event_type") != "purchase"), **TYPES, skew=skew)
    states = history.select("user_id", F.col("event_type").alias("state"), VALID_FROM, VALID_TO)
    return temporal_join(purchases, states, ["user_id"], "ts", how="left", skew=skew)


def _join_sql(source: str) -> str:
    others = versions_sql(
        f"(SELECT * FROM {source} WHERE event_type <> 'purchase')", "user_id", "ts", "event_id", "event_type",
        "user_id, event_type AS state",
    )
    return f"""
    SELECT p.event_id, p.user_id, p.ts, p.value, h.state, h._valid_from, h._valid_to
    FROM (SELECT * FROM {source} WHERE event_type = 'purchase') p LEFT JOIN ({others}) h
      ON p.user_id = h.user_id AND h._valid_from <= p.ts AND (h._valid_to IS NULL OR p.ts < h._valid_to)
    """


@query("scd2_temporal_join", _join_sql("events"))
def scd2_temporal_join(spark, sf_dir):
    events = _events(spark, sf_dir)
    return _join_purchases(events, sketch_keys(events, ["user_id"]))


@query("scd2_temporal_join_skewed", _join_sql(SKEWED))
def scd2_temporal_join_skewed(spark, sf_dir):
    events = _skewed(spark, sf_dir)
    return _join_purchases(events, _sliced(events))
