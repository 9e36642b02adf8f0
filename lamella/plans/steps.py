"""Ordered chains of user steps."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.sources.tables import read_table, replace_table

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class StepParams:
    """What a step is told about its place in the chain; the index starts at 0."""

    pipeline_group: str
    operation_type: str
    operation_index: int
    total_operations: int

    def add_to(self, df: DataFrame) -> DataFrame:
        """The parameters as columns."""
        return df.withColumns({name: F.lit(value) for name, value in vars(self).items()})


Body = Callable[[SparkSession, Mapping[str, DataFrame], StepParams], DataFrame]


@dataclass(frozen=True)
class Step:
    """``body`` gets the input tables and the outputs of all earlier steps by name."""

    name: str
    body: Body | None
    order: int = 0


def run_steps(
    spark: SparkSession,
    group: str,
    steps: Sequence[Step],
    inputs: Mapping[str, DataFrame],
    root: str,
    paths: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Run steps by ascending order, equal orders as given, each after the one before.

    A step's output is written below ``root``, or to its entry in ``paths``, before the next
    step reads it. A failing step ends the chain; what earlier steps wrote stays. Steps without a body are skipped.
    """
    if len({s.name for s in steps}) != len(steps):
        raise ValueError("two steps write the same table")
    tables, ran = dict(inputs), {}
    ordered = sorted(steps, key=lambda s: s.order)
    for index, step in enumerate(ordered):
        if step.body is None:
            log.warning("step %s has no body and is skipped", step.name)
            continue
        params = StepParams(group, "manual", index, len(ordered))
        path = (paths or {}).get(step.name) or f"{root.rstrip('/')}/{step.name}"
        replace_table(step.body(spark, tables, params), path)
        tables[step.name] = ran[step.name] = read_table(spark, path)
    if not ran:
        raise ValueError(f"group {group} has no step to run")
    return ran
