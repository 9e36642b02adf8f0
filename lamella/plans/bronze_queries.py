"""File ingestion: the tables are written out as files, ingested, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions import json as J
from lamella.plans.registry import query, table
from lamella.session import work_dir
from lamella.sources.changed_files import read_changed_files
from lamella.sources.commits import CommitLog
from lamella.sources.export import convert, write_control_table, write_files, write_json_documents
from lamella.sources.files import FileSource, read_control_table
from lamella.sources.records import CORRUPT, UNMATCHED
from lamella.sources.schemas import SchemaStore
from lamella.sources.tables import stream_table
from lamella.streaming.bronze import append_stream, bronze_schema, default_schema_dir, ingest, read_bronze
from lamella.streaming.landing import compact_bronze, landed_batches, landed_rows

AUDIT = "_ingestion_timestamp"
ADDED = (AUDIT, UNMATCHED)


def _round_trip(spark: SparkSession, df: DataFrame, format: str) -> DataFrame:
    """Write as files, ingest as a stream, read the bronze table."""
    root = work_dir(spark, f"bronze-{format}")
    write_files(df, f"{root}/files", format)
    source = FileSource(f"{root}/files", format, schema=df.schema)
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze")


@query("bronze_csv", "SELECT * FROM part")
def bronze_csv(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "part"), "csv").drop(*ADDED)


@query("bronze_json", "SELECT * FROM events")
def bronze_json(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "events"), "json").drop(*ADDED)


@query("bronze_parquet", "SELECT * FROM orders")
def bronze_parquet(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "orders"), "parquet").drop(*ADDED)


@query("bronze_orc", "SELECT * FROM customer")
def bronze_orc(spark, sf_dir):
    return _round_trip(spark, table(spark, sf_dir, "customer"), "orc").drop(*ADDED)


@query("bronze_json_multiline", "SELECT * FROM customer")
def bronze_json_multiline(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    root = work_dir(spark, "bronze-multiline")
    write_json_documents(df, f"{root}/files")
    source = FileSource(f"{root}/files", "json", schema=df.schema, multi_line=True)
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze").drop(*ADDED)


INFERRED_SUPPLIER = """
    SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier
"""


@query("bronze_schema_infer", INFERRED_SUPPLIER)
def bronze_schema_infer(spark, sf_dir):
    root = work_dir(spark, "bronze-infer")
    write_files(table(spark, sf_dir, "supplier"), f"{root}/files", "csv")
    ingest(spark, FileSource(f"{root}/files", "csv"), f"{root}/bronze", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze").drop(*ADDED)


@query("bronze_schema_persist", INFERRED_SUPPLIER)
def bronze_schema_persist(spark, sf_dir):
    """The second start does not infer: it reads with the schema kept by the first."""
    root = work_dir(spark, "bronze-persist")
    source = FileSource(f"{root}/files", "csv")
    for rest in (0, 1):
        part = table(spark, sf_dir, "supplier").where(F.col("s_suppkey") % 2 == rest)
        write_files(part, f"{root}/files", "csv")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint", schema_dir=f"{root}/schemas", evolve=False)
    stored = SchemaStore(spark, f"{root}/schemas").latest()
    return spark.read.schema(stored).parquet(f"{root}/bronze")


@query(
    "bronze_schema_evolve",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal,
           CASE WHEN c_custkey < (SELECT max(c_custkey) // 2 FROM customer) THEN NULL ELSE c_mktsegment END
             AS c_mktsegment
    FROM customer
    """,
)
def bronze_schema_evolve(spark, sf_dir):
    """Files that come later have one column more; the stream restarts with the wider schema."""
    df = table(spark, sf_dir, "customer")
    middle = df.agg(F.max("c_custkey")).first()[0] // 2
    root = work_dir(spark, "bronze-evolve")
    source = FileSource(f"{root}/files", "json")
    early = df.where(F.col("c_custkey") < middle).drop("c_mktsegment")
    for part in (early, df.where(F.col("c_custkey") >= middle)):
        write_files(part, f"{root}/files", "json")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint", schema_dir=f"{root}/schemas")
    stored = SchemaStore(spark, f"{root}/schemas").latest()
    bronze = spark.read.schema(stored).parquet(f"{root}/bronze")
    return bronze.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])


@query("bronze_incremental", "SELECT * FROM orders")
def bronze_incremental(spark, sf_dir):
    """Three arrivals and a run without new files: every row once."""
    df = table(spark, sf_dir, "orders")
    root = work_dir(spark, "bronze-incremental")
    source = FileSource(f"{root}/files", "csv", schema=df.schema)
    for arrival in range(4):
        if arrival < 3:
            write_files(df.where(F.col("o_orderkey") % 3 == arrival), f"{root}/files", "csv")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/bronze").drop(*ADDED)


@query("bronze_max_files", "SELECT *, CAST(5 AS BIGINT) AS batches FROM orders")
def bronze_max_files(spark, sf_dir):
    """Five files, one per micro-batch; each batch has its own audit time."""
    df = table(spark, sf_dir, "orders")
    root = work_dir(spark, "bronze-max-files")
    write_files(df.repartition(5), f"{root}/files", "parquet")
    source = FileSource(f"{root}/files", "parquet", schema=df.schema, max_files=1)
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    bronze = spark.read.parquet(f"{root}/bronze")
    batches = bronze.select(AUDIT).distinct().count()
    return bronze.drop(*ADDED).withColumn("batches", F.lit(batches).cast("bigint"))


def _rewrite_in_place(spark: SparkSession, folder: str, column: str, scratch: str) -> None:
    """Replace every file of a folder by one of the same name with ``column`` raised by one."""
    log = CommitLog(spark, folder)
    names = [n for n in log.children(folder) if n.startswith("part-")]
    for i, name in enumerate(names):
        changed = spark.read.parquet(f"{folder}/{name}")
        changed.withColumn(column, F.col(column) + 1).coalesce(1).write.parquet(f"{scratch}/{i}")
        new = next(n for n in log.children(f"{scratch}/{i}") if n.startswith("part-"))
        log.replace_file(f"{scratch}/{i}/{new}", f"{folder}/{name}")


def _ingest_rewritten(spark: SparkSession, sf_dir: str, allow: bool) -> tuple[str, T.StructType]:
    df = table(spark, sf_dir, "supplier")
    root = work_dir(spark, "bronze-overwrites")
    for rest in (0, 1):
        write_files(df.where(F.col("s_suppkey") % 2 == rest), f"{root}/files/rest{rest}", "parquet")
    options = {"recursiveFileLookup": "true"}
    source = FileSource(f"{root}/files", "parquet", schema=df.schema, allow_overwrites=allow, options=options)
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    _rewrite_in_place(spark, f"{root}/files/rest1", "s_acctbal", f"{root}/scratch")
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    return f"{root}/bronze", df.schema


@query("bronze_no_overwrites", "SELECT * FROM supplier")
def bronze_no_overwrites(spark, sf_dir):
    bronze, _ = _ingest_rewritten(spark, sf_dir, allow=False)
    return spark.read.parquet(bronze).drop(*ADDED)


@query(
    "bronze_allow_overwrites",
    """
    SELECT * FROM supplier
    UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal + 1 FROM supplier WHERE s_suppkey % 2 = 1
    """,
)
def bronze_allow_overwrites(spark, sf_dir):
    bronze, _ = _ingest_rewritten(spark, sf_dir, allow=True)
    return read_changed_files(spark, bronze).drop(*ADDED)


@query("bronze_audit_column", "SELECT *, true AS stamped FROM customer")
def bronze_audit_column(spark, sf_dir):
    bronze = _round_trip(spark, table(spark, sf_dir, "customer"), "parquet")
    return bronze.withColumn("stamped", F.col(AUDIT).isNotNull()).drop(*ADDED)


@query("stream_table_read", "SELECT * FROM events")
def stream_table_read(spark, sf_dir):
    """A second stream reads the bronze table that a first one wrote."""
    df = table(spark, sf_dir, "events")
    root = work_dir(spark, "stream-table")
    write_files(df, f"{root}/files", "parquet")
    ingest(spark, FileSource(f"{root}/files", "parquet", schema=df.schema), f"{root}/bronze", f"{root}/c1")
    append_stream(stream_table(spark, f"{root}/bronze"), f"{root}/copy", f"{root}/c2")
    return spark.read.parquet(f"{root}/copy").drop(*ADDED)


@query("tsv_json_read", "SELECT event_id, event_type, CAST(props ->> '$.k' AS INTEGER) AS k FROM events")
def tsv_json_read(spark, sf_dir):
    root = work_dir(spark, "tsv")
    write_control_table(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), f"{root}/tsv")
    rows = read_control_table(spark, f"{root}/tsv")
    parsed = F.from_json("props", "k int")
    return rows.select(F.col("event_id").cast("bigint"), "event_type", parsed.k.alias("k"))


@query(
    "json_extract",
    """
    SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k,
           coalesce(props ->> '$.absent', '100') AS absent FROM events
    """,
)
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", J.field("props", "k", "int").alias("k"), J.field("props", "absent", default="100").alias("absent")
    )


@query("convert_json_to_parquet", "SELECT * FROM orders")
def convert_json_to_parquet(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    root = work_dir(spark, "convert")
    write_files(df, f"{root}/files", "json")
    convert(spark, FileSource(f"{root}/files", "json"), df.schema, f"{root}/parquet")
    return spark.read.parquet(f"{root}/parquet")


@query(
    "bronze_csv_mixed_headers",
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_totalprice END AS o_totalprice,
           CASE WHEN o_orderkey % 3 = 2 THEN o_orderpriority END AS o_orderpriority
    FROM orders
    """,
)
def bronze_csv_mixed_headers(spark, sf_dir):
    """Files with and without some columns, all taken in one look."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    root = work_dir(spark, "bronze-mixed-headers")
    for rest, left_out in enumerate((["o_orderpriority"], ["o_totalprice", "o_orderpriority"], [])):
        write_files(df.where(F.col("o_orderkey") % 3 == rest).drop(*left_out), f"{root}/files", "csv")
    source = FileSource(f"{root}/files", "csv", max_files=1000)
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint", schema_dir=f"{root}/schemas")
    bronze = read_bronze(spark, source, f"{root}/bronze", f"{root}/schemas")
    return bronze.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])


@query("bronze_csv_header_moved", "SELECT * FROM supplier")
def bronze_csv_header_moved(spark, sf_dir):
    """Later files have the same columns in another order."""
    df = table(spark, sf_dir, "supplier")
    root = work_dir(spark, "bronze-header-moved")
    source = FileSource(f"{root}/files", "csv")
    for rest, order in ((0, df.columns), (1, df.columns[::-1])):
        write_files(df.where(F.col("s_suppkey") % 2 == rest).select(*order), f"{root}/files", "csv")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint", schema_dir=f"{root}/schemas")
    bronze = read_bronze(spark, source, f"{root}/bronze", f"{root}/schemas")
    return bronze.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])


@query(
    "bronze_malformed_kept",
    """
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'broken ' || event_id END AS broken,
           CASE WHEN event_id % 10 <> 0 THEN user_id END AS user_id
    FROM events
    """,
)
def bronze_malformed_kept(spark, sf_dir):
    """Every tenth line is no JSON; its text is in the bronze table, beside the events."""
    events = table(spark, sf_dir, "events")
    root = work_dir(spark, "bronze-malformed")
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("broken "), "event_id")).otherwise(F.to_json(F.struct("event_id", "user_id")))
    events.select(line).write.text(f"{root}/files")
    source = FileSource(f"{root}/files", "json")
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    bronze = read_bronze(spark, source, f"{root}/bronze").withColumn("broken", F.try_element_at(UNMATCHED, F.lit(CORRUPT)))
    number = F.coalesce("event_id", F.substring_index("broken", " ", -1).cast("bigint"))
    return bronze.select(number.alias("event_id"), "broken", F.col("user_id").cast(events.schema["user_id"].dataType))


@query(
    "bronze_unmatched_fields",
    """
    SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id,
           CASE WHEN event_id % 7 = 0 THEN '"user ' || user_id || '"' END AS other_user,
           CASE WHEN event_id % 5 = 0 THEN '{"k":"' || event_type || '"}' END AS extra
    FROM events
    """,
)
def bronze_unmatched_fields(spark, sf_dir):
    """Later events have texts in a numeric field, and a field that the frozen schema lacks."""
    events = table(spark, sf_dir, "events")
    root = work_dir(spark, "bronze-unmatched")
    source = FileSource(f"{root}/files", "json")
    store = SchemaStore(spark, f"{root}/schemas")
    store.save(events.select("event_id", "user_id").schema)
    plain = F.to_json(F.struct("event_id", "user_id"))
    odd = F.to_json(F.struct("event_id", F.concat(F.lit("user "), "user_id").alias("user_id")))
    extra = F.concat(F.lit(',"extra":'), F.to_json(F.struct(F.col("event_type").alias("k"))), F.lit("}"))
    line = F.when(F.col("event_id") % 7 == 0, odd).otherwise(plain)
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.regexp_replace(line, r"\}$", ""), extra)).otherwise(line)
    events.select(line).write.text(f"{root}/files")
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint", schema_dir=f"{root}/schemas", evolve=False)
    bronze = read_bronze(spark, source, f"{root}/bronze", f"{root}/schemas")
    rest = lambda name: F.try_element_at(UNMATCHED, F.lit(name)).alias({"user_id": "other_user"}.get(name, name))
    return bronze.select("event_id", "user_id", rest("user_id"), rest("extra"))


@query("bronze_compacted", "SELECT *, true AS fewer FROM orders")
def bronze_compacted(spark, sf_dir):
    """A bronze table of many small files after compaction, and one more batch after that."""
    df = table(spark, sf_dir, "orders")
    root = work_dir(spark, "bronze-compacted")
    source = FileSource(f"{root}/files", "parquet", schema=df.schema, max_files=1)
    write_files(df.where(F.col("o_orderkey") % 5 != 0).repartition(6), f"{root}/files", "parquet")
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    before, after = compact_bronze(spark, f"{root}/bronze", bronze_schema(spark, source, default_schema_dir(f"{root}/bronze")))
    write_files(df.where(F.col("o_orderkey") % 5 == 0).coalesce(1), f"{root}/files", "parquet")
    ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    return read_bronze(spark, source, f"{root}/bronze").drop(*ADDED).withColumn("fewer", F.lit(after < before))


@query("bronze_change_feed", "SELECT *, 'insert' AS _change_type FROM orders WHERE o_orderkey % 3 <> 0")
def bronze_change_feed(spark, sf_dir):
    """What the second and third arrival brought, from their files alone."""
    df = table(spark, sf_dir, "orders")
    root = work_dir(spark, "bronze-changes")
    source = FileSource(f"{root}/files", "csv", schema=df.schema, max_files=1000)
    for arrival in range(3):
        write_files(df.where(F.col("o_orderkey") % 3 == arrival), f"{root}/files", "csv")
        ingest(spark, source, f"{root}/bronze", f"{root}/checkpoint")
    ((stream, batches),) = landed_batches(spark, f"{root}/bronze").items()
    schema = bronze_schema(spark, source, default_schema_dir(f"{root}/bronze"))
    return landed_rows(spark, f"{root}/bronze", schema, stream, after=batches[0]).drop(*ADDED, "_batch")
