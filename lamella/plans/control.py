"""Pipelines described by a control table: one operation per row, grouped, run in order.

The table has the columns ``operation_type`` (bronze, silver, gold or manual),
``pipeline_group``, ``file_format``, ``source_path``, ``target_table`` and, as JSON,
``pipeline_config``. It is configuration and small; the data it names is not.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.operators import rules as R
from lamella.operators.history import INGESTED
from lamella.plans.steps import Body, Step, StepParams, run_steps
from lamella.sources.changed_files import changed_runs
from lamella.sources.files import FORMATS, FileSource, read_control_table
from lamella.sources.tables import TableRef, read_table, replace_table, stream_table
from lamella.streaming.bronze import bronze_schema, ingest, read_bronze
from lamella.streaming.silver import SilverTable

# The operation types, and below the option names, of the control tables.
KINDS = ("bronze", "silver", "gold", "manual")


@dataclass(frozen=True)
class Operation:
    """One row of the control table."""

    kind: str
    group: str
    source: str
    target: TableRef
    file_format: str | None
    config: Mapping[str, Any]

    @staticmethod
    def of(row: Mapping[str, str | None]) -> Operation:
        """Bad JSON, an unknown kind and a missing key list are errors, not defaults."""
        kind = row["operation_type"]
        if kind not in KINDS:
            raise ValueError(f"operation_type must be one of {KINDS}, not {kind!r}")
        config = json.loads(row["pipeline_config"] or "{}")
        if kind == "silver" and not config.get("keys"):
            raise ValueError(f"silver table {row['target_table']} needs keys")
        return Operation(
            kind=kind,
            group=row["pipeline_group"],
            source=row["source_path"],
            target=TableRef.parse(row["target_table"]),
            file_format=row["file_format"] or None,
            config=config,
        )

    def file_source(self) -> FileSource:
        """Options are named as in the configuration; unknown ones go to the reader."""
        given = dict(self.config)
        for handled in ("cloudFiles.schemaLocation", "cloudFiles.checkpointLocation"):
            given.pop(handled, None)

        def flag(name: str, default: str) -> bool:
            return str(given.pop(name, default)).lower() == "true"

        return FileSource(
            path=self.source,
            format=self.file_format,
            header=flag("header", "true"),
            infer=flag("inferSchema", "true"),
            multi_line=flag("multiline", "false"),
            max_files=int(given.pop("cloudFiles.maxFilesPerTrigger", 100)),
            allow_overwrites=flag("cloudFiles.allowOverwrites", "false"),
            options={k: str(v) for k, v in given.items()},
        )

    def schema_dir(self, root: str) -> str:
        return self.config.get("cloudFiles.schemaLocation") or f"{self.target.path(root)}.schemas"

    def silver_table(self, spark: SparkSession, root: str, **settings) -> SilverTable:
        """``track_history_except_column_list`` keeps the columns without versioning on them;
        ``except_column_list`` leaves them out."""
        return SilverTable(
            spark,
            self.target.path(root),
            self.config["keys"],
            self.config.get("sequence_by", INGESTED),
            tie_break=self.config.get("tie_break", ()),
            untracked=[
                c
                for c in self.config.get("track_history_except_column_list", ())
                if c != self.config.get("sequence_by", INGESTED)
            ],
            drop=self.config.get("except_column_list", ()),
            scd_type=int(self.config.get("stored_as_scd_type", 2)),
            **settings,
        )


def read_operations(spark: SparkSession, path: str) -> list[Operation]:
    """Operations of a control table, in its order. Two rows may not write one table."""
    columns = ["operation_type", "pipeline_group", "file_format", "source_path", "target_table", "pipeline_config"]
    table = read_control_table(spark, path)
    missing = R.missing_columns(table, columns)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    operations = [Operation.of(row.asDict()) for row in table.select(*columns).collect()]
    targets = [o.target for o in operations]
    twice = sorted({f"{t.schema}.{t.table}" for t in targets if targets.count(t) > 1})
    if twice:
        raise ValueError(f"written by two operations: {twice}")
    return operations


def run_group(
    spark: SparkSession,
    operations: list[Operation],
    group: str,
    root: str,
    bodies: Mapping[str, Body] | None = None,
    **silver_settings,
) -> dict[str, DataFrame]:
    """Run one group: bronze, then silver, then gold, then manual steps by their order.

    Tables lie at ``root/schema/table``. ``bodies`` holds the code of gold and manual
    operations by ``source_path``; each gets the tables so far by ``schema.table``.
    """
    mine = [o for o in operations if o.group == group]
    if not mine:
        raise ValueError(f"no operation is in group {group!r}")
    bodies, tables = bodies or {}, {}
    for op in (o for o in mine if o.kind == "bronze"):
        path = op.target.path(root)
        checkpoint = op.config.get("cloudFiles.checkpointLocation") or f"{path}.checkpoint"
        ingest(spark, op.file_source(), path, checkpoint, schema_dir=op.schema_dir(root))
        tables[_name(op)] = read_bronze(spark, op.file_source(), path, op.schema_dir(root))
    written = {o.target: o for o in operations if o.kind == "bronze"}
    for op in (o for o in mine if o.kind == "silver"):
        silver = op.silver_table(spark, root, **silver_settings)
        origin = TableRef.parse(op.source)
        path, bronze = origin.path(root), written.get(origin)
        schema = bronze_schema(spark, bronze.file_source(), bronze.schema_dir(root)) if bronze else None
        if bronze and bronze.file_source().allow_overwrites:
            first = silver.applied(_name(bronze)) + 1
            for number, run in enumerate(changed_runs(spark, path, schema, first), first):
                silver.apply(run, number, _name(bronze))
        else:
            silver.start(stream_table(spark, path, schema), f"{op.target.path(root)}.checkpoint")
        tables[_name(op)] = silver.read(spark)
    for op in (o for o in mine if o.kind == "gold"):
        path = op.target.path(root)
        replace_table(bodies[op.source](spark, tables, StepParams(group, "gold", 0, 1)), path)
        tables[_name(op)] = read_table(spark, path)
    manual = [o for o in mine if o.kind == "manual"]
    if manual:
        steps = [Step(_name(o), bodies.get(o.source), int(o.config.get("order", 0))) for o in manual]
        paths = {_name(o): o.target.path(root) for o in manual}
        tables.update(run_steps(spark, group, steps, tables, root, paths))
    return tables


def _name(op: Operation) -> str:
    return f"{op.target.schema}.{op.target.table}"


def config_rules() -> list[R.Rule]:
    """The checks of the older twelve-column control table, as row rules.

    The allowed values, prefixes and field names are fixed values of that table.
    """
    stored = ("s3://", "abfss://")
    unity = F.col("source_type") == "unity"
    serverless = F.col("cluster_size") == "serverless"

    def location(key: str) -> R.Rule:
        in_volume = unity & F.startswith(R.J.field("autoloader_options", key), F.lit("/Volumes/"))
        return R.json_prefix("autoloader_options", key, stored, in_volume, ["source_type"])

    def path_of(kind: str, prefix: str) -> R.Rule:
        return R.prefix_when("source_path", [prefix], F.col("source_type") == kind, ["source_type"])

    return [
        R.in_set("source_type", ["s3", "adls", "unity"]),
        R.in_set("file_format", FORMATS),
        R.in_set("trigger_type", ["file", "time"]),
        R.in_set("pipeline_type", ["dlt", "notebook"]),
        R.in_set("cluster_size", ["small", "medium", "large", "serverless"]),
        path_of("unity", "/Volumes/"),
        path_of("s3", "s3://"),
        path_of("adls", "abfss://"),
        R.json_valid("autoloader_options"),
        location("schema_location"),
        location("checkpoint_location"),
        R.json_valid("cluster_config"),
        R.json_key("cluster_config", "warehouse_id", ["your_warehouse_id"], serverless, ["cluster_size"]),
        R.json_valid("email_notifications"),
        R.json_array("email_notifications", "recipients"),
        R.json_type("email_notifications", "email_on_success", "BOOLEAN"),
        R.json_type("email_notifications", "email_on_failure", "BOOLEAN"),
        R.array_forall("email_notifications", "recipients", ["@", "."]),
    ]
