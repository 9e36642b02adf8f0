"""Whole-table jobs: change feed, profile, compaction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.commits import LANDED, CommitLog
from lamella.sources.tables import changed_rows, compact_table, packed_scans, read_table, replace_table, table_folders


def change_feed(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row changes between two states of a table with unique keys.

    ``_change_type`` is ``insert``, ``delete``, or a pair ``update_preimage`` and
    ``update_postimage``. The rows of both states are grouped by key, each with its side,
    and combined before the one shuffle; neither side is sorted. Columns that only ``new``
    has are null before; types that differ are those of ``new``.
    """
    columns = [c for c in new.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        given = {c: F.col(f"`{c}`") if c in df.columns else F.lit(None) for c in new.columns}
        typed = df.select(*(value.cast(new.schema[c].dataType).alias(c) for c, value in given.items()))
        return typed.select(*keys, F.struct(*columns).alias("_row"), F.lit(name).alias("_side"))

    both = side(old, "old").unionByName(side(new, "new")).groupBy(*keys)
    both = both.agg(*(F.any_value(F.when(F.col("_side") == s, F.col("_row")), ignoreNulls=F.lit(True)).alias(f"_{s}") for s in ("old", "new")))
    changed = [~F.col(f"_old.`{c}`").eqNullSafe(F.col(f"_new.`{c}`")) for c in columns]
    any_changed = reduce(lambda a, b: a | b, changed, F.lit(False))

    def row(kind: str, side: str):
        return F.struct(F.lit(kind).alias("_change_type"), F.col(side).alias("_row"))

    rows = (
        F.when(F.col("_old").isNull(), F.array(row("insert", "_new")))
        .when(F.col("_new").isNull(), F.array(row("delete", "_old")))
        .when(any_changed, F.array(row("update_preimage", "_old"), row("update_postimage", "_new")))
    )
    return both.select(*keys, F.inline(rows)).select(*keys, "_row.*", "_change_type").select(*new.columns, "_change_type")


def table_changes(
    spark: SparkSession, path: str, keys: Sequence[str], since: int, until: int | None = None
) -> DataFrame:
    """Row changes of a table from one of its versions to a later one, or to the current one.

    Only files that one of the two versions lacks are read.
    """
    before, after = changed_rows(spark, path, since, until)
    return change_feed(before, after, keys)


def profile(df: DataFrame) -> DataFrame:
    """Name, type, position, rows and nulls of every column, by one aggregate pass."""
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col("rows").alias("row_count"),
            F.col(f"n{i}").alias("null_count"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return totals.select(F.inline(F.array(*entries)))


def compact(
    spark: SparkSession, path: str, target_bytes: int = 256 << 20, into: str | None = None
) -> tuple[int, int]:
    """Pack the small files of a table into files of about ``target_bytes``; larger ones stay.

    A plain folder is brought into a table, or ``into`` another one. Bronze tables, which
    streams add to and read from, have ``compact_bronze``. Packing happens in the scan,
    where one task reads many small files, so nothing is shuffled and no task holds more
    than its own output. Returns files before and after.
    """
    log = CommitLog(spark, f"{path}/_commits")
    if into is None and (log.exists(f"{path}/_spark_metadata") or log.exists(f"{path}/{LANDED}")):
        raise ValueError(f"{path} is appended to by a stream; use compact_bronze, or compact it into another table")
    if into is None and log.numbers():
        return compact_table(spark, path, target_bytes)

    def files(table: str) -> int:
        return sum(len(log.sized_files(f)) for f in table_folders(spark, table))

    before = files(path)
    with packed_scans(spark, target_bytes):
        replace_table(read_table(spark, path), into or path)
    return before, files(into or path)


def write_balanced(df: DataFrame, path: str) -> int:
    """Full refresh in files of the advisory size, whatever partitions the plan ends with."""
    return replace_table(df.hint("rebalance"), path)
