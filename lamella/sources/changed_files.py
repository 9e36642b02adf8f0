"""Ingestion that takes rewritten files again.

Every run compares the listing of the source, by path, time and length, with a ledger of
what was taken. Data and ledger entries of a run become visible with one commit, so a
run that fails half-way leaves nothing behind for readers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.session import work_dir
from lamella.sources.commits import CommitLog
from lamella.sources.files import FileSource, list_files, read_files, with_audit
from lamella.sources.schemas import Resolved

FILE = ["path", "modificationTime", "length"]


LEDGERS = 32
RUNS = 64  # runs that a commit names itself; earlier ones are named in files of as many
AHEAD = 32  # runs whose files are looked up at a time


def _state(spark: SparkSession, target: str) -> tuple[CommitLog, int, dict]:
    log = CommitLog(spark, f"{target.rstrip('/')}/_commits")
    last = log.latest()
    return (log, last[0] + 1, last[1]) if last else (log, 0, {"runs": [], "ledgers": []})


def _runs(spark: SparkSession, target: str) -> list[str]:
    """All committed runs in their order."""
    log, _, state = _state(spark, target)
    earlier = [run for name in state.get("folded", []) for run in json.loads(log.read_text(f"{target.rstrip('/')}/_commits/runs/{name}"))]
    return [*earlier, *state["runs"]]


def _with_run(log: CommitLog, target: str, state: dict, run: str) -> dict:
    """The state with one more run; ``RUNS`` of them are written to a file of their own."""
    runs, folded = [*state["runs"], run], state.get("folded", [])
    if len(runs) > RUNS:
        name = f"{uuid.uuid4().hex}.runs"
        log.write_text(f"{target.rstrip('/')}/_commits/runs/{name}", json.dumps(runs[:-1]))
        runs, folded = runs[-1:], [*folded, name]
    return {**state, "runs": runs, "folded": folded}


def ingest_changed_files(
    spark: SparkSession, source: FileSource, schema: T.StructType | Callable[[list[str]], Resolved], target: str
) -> int:
    """Append new and rewritten files to ``target``; returns how many were taken.

    The source is listed once; what differs from the ledger is written to a working table
    and taken from there in runs of ``source.max_files``, oldest first, of which only the
    paths of the next ``AHEAD`` runs reach the driver. ``schema`` may be a function of a
    run's files. After every ``LEDGERS`` runs the ledger is folded into one folder.
    """
    log, number, state = _state(spark, target)
    changed = list_files(spark, source.path)
    if state["ledgers"]:
        changed = changed.join(_ledger(spark, target, state), FILE, "left_anti")
    working = work_dir(spark, "changed-files")
    changed.withColumn("_at", F.unix_micros("modificationTime")).write.parquet(working)
    everything, taken, last = spark.read.parquet(working), 0, None
    place = F.struct("_at", "path")
    while True:
        pending = everything if last is None else everything.where(place > F.struct(F.lit(last._at), F.lit(last.path)))
        ahead = pending.select("_at", "path").orderBy("_at", "path").limit(source.max_files * AHEAD).collect()
        if not ahead:
            log.delete_folder(working)
            return taken
        for at in range(0, len(ahead), source.max_files):
            files = ahead[at : at + source.max_files]
            run, until = f"run-{uuid.uuid4().hex}", files[-1]
            paths = [f.path for f in files]
            known = schema(paths) if callable(schema) else Resolved(schema)
            rows = read_files(spark, source, known.schema or T.StructType(), paths, known.all_known)
            with_audit(rows).write.parquet(f"{target}/{run}/data")
            own = place <= F.struct(F.lit(until._at), F.lit(until.path))
            if last is not None:
                own &= place > F.struct(F.lit(last._at), F.lit(last.path))
            entries, kept = everything.where(own).select(*FILE).coalesce(1), state["ledgers"]
            if len(kept) >= LEDGERS:
                entries, kept = entries.unionByName(_ledger(spark, target, state)), []
            entries.write.parquet(f"{target}/{run}/files")
            state = _with_run(log, target, {**state, "ledgers": [*kept, f"{run}/files"]}, run)
            log.commit(number, state)
            number, taken, last = number + 1, taken + len(files), until


def _ledger(spark: SparkSession, target: str, state: dict) -> DataFrame:
    return spark.read.parquet(*[f"{target}/{folder}" for folder in state["ledgers"]])


def changed_runs(spark: SparkSession, target: str, schema: T.StructType | None = None, first: int = 0) -> list[DataFrame]:
    """The committed runs in their order, from number ``first`` on; numbers never change."""
    reader = spark.read.schema(schema) if schema else spark.read
    return [reader.parquet(f"{target}/{run}/data") for run in _runs(spark, target)[first:]]


def read_changed_files(spark: SparkSession, target: str, schema: T.StructType | None = None) -> DataFrame:
    """All committed rows of a target of ``ingest_changed_files``."""
    runs = _runs(spark, target)
    if not runs:
        raise FileNotFoundError(f"nothing was ingested into {target} yet")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*[f"{target}/{r}/data" for r in runs])

