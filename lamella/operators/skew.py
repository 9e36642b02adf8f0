"""Finding keys too large for one task, and cutting them into ordered slices.

Keys are hashed, and a mergeable sketch of the most frequent hashes is taken: each task
keeps a bounded number of counters, and what reaches the driver is as bounded, whatever
the size of the table. Every key with more than about 3.5 / ``tracked`` of all rows is in it, with a
count that is never too high. A sketch is taken once and can be handed on: that of events
serves for their history too, which has no more rows per key, and sketches add up.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.session import work_dir

SLICE = "_slice"


@dataclass(frozen=True)
class SkewPolicy:
    """Rows above which a key is too large for one task, and counters per sketch."""

    min_rows: int = 2_000_000
    tracked: int = 1 << 16


@dataclass(frozen=True)
class HotKeys:
    """Hashes of the keys above the limit, and the rows that they hold together."""

    hashes: tuple[int, ...]
    rows: int
    rows_per_slice: int

    @property
    def slices(self) -> int:
        return max(2, math.ceil(self.rows / self.rows_per_slice))


@dataclass(frozen=True)
class KeySketch:
    """Counts of the most frequent key hashes of some rows, and the policy they were taken under."""

    policy: SkewPolicy
    rows: int
    counts: Mapping[int, int]

    def __add__(self, other: KeySketch) -> KeySketch:
        counts = Counter(self.counts) + Counter(other.counts)
        return KeySketch(self.policy, self.rows + other.rows, dict(counts.most_common(self.policy.tracked)))

    def hot(self) -> HotKeys | None:
        """None when no key is above the limit."""
        large = {h: n for h, n in self.counts.items() if n > self.policy.min_rows}
        if not large:
            return None
        return HotKeys(tuple(sorted(large)), sum(large.values()), max(1, self.policy.min_rows))


Skew = SkewPolicy | KeySketch | None


def key_bucket(keys: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Integral keys hash as bigint, so sketches of tables that differ in that add up."""
    integral = {k for k in keys if isinstance(df.schema[k].dataType, T.IntegralType)}
    return F.xxhash64(*(F.col(k).cast("long") if k in integral else F.col(k) for k in keys))


def sketch_keys(df: DataFrame, keys: Sequence[str], policy: SkewPolicy = SkewPolicy()) -> KeySketch:
    """One pass over the key columns, added up in tasks."""
    state = F.call_function("approx_top_k_accumulate", F.col("h"), F.lit(policy.tracked))
    hashed = df.select(_key_hash(df, keys).alias("h")).agg(state.alias("state"), F.count(F.lit(1)).alias("rows"))
    top = F.call_function("approx_top_k_estimate", F.col("state"), F.lit(policy.tracked))
    large = F.filter(top, lambda x: x["count"] > policy.min_rows // 8)  # others hardly matter to a sum of sketches
    found = hashed.select("rows", large.alias("large")).first()
    return KeySketch(policy, found.rows, {item: count for item, count in found.large})


def find_hot_keys(df: DataFrame, keys: Sequence[str], skew: Skew) -> HotKeys | None:
    """From a sketch that is handed on, or from one of ``df``; without a policy none is looked for."""
    if skew is None:
        return None
    return (skew if isinstance(skew, KeySketch) else sketch_keys(df, keys, skew)).hot()


def split_hot(df: DataFrame, keys: Sequence[str], hot: HotKeys) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    is_hot = _key_hash(df, keys).isin(list(hot.hashes))
    return df.where(~is_hot), df.where(is_hot)


def with_slices(df: DataFrame, order: Sequence[str], slices: int) -> DataFrame:
    """Range-partition by ``order`` and number the ranges.

    A key with many rows spans several consecutive slices, each of bounded size, and the
    slice numbers follow the order. Range bounds come from a sample of one execution, so
    a result derived from the numbers has to be materialized before it is used twice.
    """
    return df.repartitionByRange(slices, *order).withColumn(SLICE, F.spark_partition_id())


_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_folder(path: str):
    """Let ``materialize`` write below ``path``, which the caller deletes when it is done."""
    token = _scratch.set(path)
    try:
        yield
    finally:
        _scratch.reset(token)


def materialize(df: DataFrame) -> DataFrame:
    """Write to a table in the shared folder and read it from there.

    Cuts the lineage, survives the loss of executors, and lets later filters and column
    choices reach the scan.
    """
    scratch = _scratch.get()
    path = f"{scratch}/{uuid.uuid4().hex}" if scratch else work_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
