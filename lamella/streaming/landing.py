"""Micro-batches written as files of a plain folder, each exactly once, and their upkeep.

A batch is written to a hidden folder, marked as complete, and its files are moved into the
table under names that begin with the batch's number. A record of them then tells that the
batch is done. A batch that is run again after a crash goes on where it stopped: before the
mark it is written anew, after it the rest of its files is moved. The schema may differ
from batch to batch.

Streams read the folder file by file, so files stay as they came. Compaction writes merged
copies of the small ones to a hidden folder and records what they replace; batch readers
take those, streams go on with the originals until ``vacuum`` deletes them.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.commits import LANDED, CommitLog
from lamella.sources.tables import packed_scans

COMPACTED = "_compacted"


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """A name kept next to the checkpoint, so that batch numbers of a new one are not taken for old ones."""
    log, named = CommitLog(spark, checkpoint), f"{checkpoint.rstrip('/')}.stream"
    if not log.exists(named):
        log.write_text(named, uuid.uuid4().hex)
    return log.read_text(named)


def land(rows: DataFrame, target: str, stream: str, number: int) -> bool:
    """Add a batch to the table, in files of the advisory size; False if it was added before."""
    target = target.rstrip("/")
    log = CommitLog(rows.sparkSession, f"{target}/{LANDED}/{stream}")
    if log.committed(number):
        return False
    if log.exists(f"{target}/_spark_metadata"):
        raise ValueError(f"{target} is written by a file sink, whose readers would not see other files")
    name = f"{stream[:8]}-{number:010d}"
    staged, complete = f"{target}/_staged/{name}", f"{target}/_staged/{name}/_complete"
    if not log.exists(complete):
        log.delete_folder(staged)
        rows.hint("rebalance").write.parquet(staged)
        log.write_text(complete, "")
    for file, _ in log.sized_files(staged):
        log.move(f"{staged}/{file}", f"{target}/{name}-{file}")
    files = [f for f, _ in log.sized_files(target) if f.startswith(f"{name}-")]
    log.commit(number, {"files": files})
    log.delete_folder(staged)
    return True


def landed_batches(spark: SparkSession, target: str) -> dict[str, list[int]]:
    """The batch numbers of each stream that wrote to the table."""
    log = CommitLog(spark, target)
    return {s: CommitLog(spark, f"{target}/{LANDED}/{s}").numbers() for s in log.children(f"{target}/{LANDED}")}


def landed_rows(spark: SparkSession, target: str, schema: T.StructType, stream: str, after: int = -1, until: int | None = None) -> DataFrame:
    """Rows of the batches of a stream after one number and up to another; no other file is read.

    All rows of an append-only table are inserts, which ``_change_type`` says; ``_batch`` is
    the batch's number. Batches must not have been vacuumed.
    """
    target = target.rstrip("/")
    log = CommitLog(spark, f"{target}/{LANDED}/{stream}")
    wanted = [n for n in log.numbers() if after < n and (until is None or n <= until)]
    number = F.regexp_extract("_metadata.file_name", r"^[0-9a-f]{8}-([0-9]{10})-", 1).cast("bigint").alias("_batch")
    files = []
    if wanted:
        records = spark.read.schema("files array<string>").json([f"{target}/{LANDED}/{stream}/{n:010d}.json" for n in wanted])
        files = [f"{target}/{r.file}" for r in records.select(F.explode("files").alias("file")).orderBy("file").collect()]
    if not files:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_batch", T.LongType()), T.StructField("_change_type", T.StringType())]))
    return spark.read.schema(schema).parquet(*files).select("*", number, F.lit("insert").alias("_change_type"))


def _state(spark: SparkSession, target: str) -> tuple[CommitLog, int, dict]:
    log = CommitLog(spark, f"{target}/{COMPACTED}")
    last = log.latest()
    return (log, last[0] + 1, last[1]) if last else (log, 0, {"replaced": [], "merged": []})


def live_files(spark: SparkSession, target: str) -> list[tuple[str, int]]:
    """Files, relative to the table, that hold each row once, with their sizes."""
    log, _, state = _state(spark, target)
    gone = set(state["replaced"])
    merged = [(f"{COMPACTED}/{folder}/{n}", size) for folder in state["merged"] for n, size in log.sized_files(f"{target}/{COMPACTED}/{folder}")]
    return [(n, size) for n, size in [*log.sized_files(target), *merged] if n not in gone]


def read_landed(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """Batch read of the table; merged files in place of the small ones that they replace."""
    target = target.rstrip("/")
    reader = spark.read.schema(schema) if schema else spark.read
    if not _state(spark, target)[2]["merged"]:
        return reader.parquet(target)
    return reader.parquet(*[f"{target}/{name}" for name, _ in live_files(spark, target)])


def compact_bronze(spark: SparkSession, target: str, schema: T.StructType, target_bytes: int = 256 << 20) -> tuple[int, int]:
    """Merge the small files of a bronze table, those below half the target; returns live files before and after.

    May run while streams write and read: they do not see merged files. Packing happens in
    the scan; nothing is shuffled.
    """
    target = target.rstrip("/")
    log, number, state = _state(spark, target)
    files = live_files(spark, target)
    small = {name: size for name, size in files if size < target_bytes / 2}
    if len(small) <= max(1, math.ceil(sum(small.values()) / target_bytes)):
        return len(files), len(files)
    folder = uuid.uuid4().hex
    with packed_scans(spark, target_bytes):
        spark.read.schema(schema).parquet(*[f"{target}/{n}" for n in small]).write.parquet(f"{target}/{COMPACTED}/{folder}")
    log.commit(number, {"replaced": sorted({*state["replaced"], *small}), "merged": [*state["merged"], folder]})
    return len(files), len(live_files(spark, target))


def vacuum_bronze(spark: SparkSession, target: str) -> int:
    """Delete files that merged ones replace; streams that have not taken them yet lose them."""
    target = target.rstrip("/")
    log, number, state = _state(spark, target)
    for name in state["replaced"]:
        log.delete_folder(f"{target}/{name}")
    kept = [f for f in state["merged"] if log.sized_files(f"{target}/{COMPACTED}/{f}")]
    if state["replaced"]:
        log.commit(number, {"replaced": [], "merged": kept})
    return len(state["replaced"])
