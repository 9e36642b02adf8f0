"""Stored, evolving schemas of file sources."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from lamella.sources.commits import CommitLog
from lamella.sources.files import TEXT, FileSource, by_header, infer_schema, list_paths


class SchemaConflict(ValueError):
    """New files have a type that older data cannot be read as."""


# Old type -> wider types that Parquet files of the old type can be read as.
WIDER = {
    T.ByteType(): (T.ShortType(), T.IntegerType(), T.LongType(), T.DoubleType()),
    T.ShortType(): (T.IntegerType(), T.LongType(), T.DoubleType()),
    T.IntegerType(): (T.LongType(), T.DoubleType()),
    T.FloatType(): (T.DoubleType(),),
    T.DateType(): (T.TimestampNTZType(),),
}


def wider_type(old: T.DataType, new: T.DataType, name: str, keep: bool = False) -> T.DataType:
    """The type both can be read as."""
    if old == new or isinstance(new, T.NullType):
        return old
    if isinstance(old, T.NullType):
        return new
    if isinstance(old, T.StructType) and isinstance(new, T.StructType):
        return merge_schemas(old, new, f"{name}.", keep)
    if isinstance(old, T.ArrayType) and isinstance(new, T.ArrayType):
        return T.ArrayType(wider_type(old.elementType, new.elementType, f"{name}[]", keep))
    if new in WIDER.get(old, ()):
        return new
    if old in WIDER.get(new, ()):
        return old
    raise SchemaConflict(f"column {name} is {old.simpleString()}, new files have {new.simpleString()}")


def merge_schemas(old: T.StructType, new: T.StructType, prefix: str = "", keep: bool = False) -> T.StructType:
    """Old columns in their order, widened where needed, then the added ones.

    With ``keep`` a column stays as it is where no type holds both.
    """
    added = {f.name: f for f in new.fields}
    fields = []
    for f in old.fields:
        other = added.pop(f.name, None)
        try:
            dtype = wider_type(f.dataType, other.dataType, prefix + f.name, keep) if other else f.dataType
        except SchemaConflict:
            if not keep:
                raise
            dtype = f.dataType
        fields.append(T.StructField(f.name, dtype, True))
    return T.StructType(fields + [T.StructField(f.name, f.dataType, True) for f in added.values()])


class SchemaStore:
    """Numbered schema versions below one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self._log = CommitLog(spark, folder)

    def latest(self) -> T.StructType | None:
        last = self._log.latest()
        return T.StructType.fromJson(json.loads(last[1]["schema"])) if last else None

    def versions(self) -> int:
        return len(self._log.numbers())

    def save(self, schema: T.StructType) -> None:
        last = self._log.latest()
        self._log.commit(last[0] + 1 if last else 0, {"schema": schema.json()})


def found_schema(spark: SparkSession, source: FileSource, paths: list[str] | None, sampling: float = 1.0) -> T.StructType | None:
    """What the files themselves have; CSV files of one header at a time, so they may differ."""
    if source.format != "csv" or not source.header:
        return infer_schema(spark, source, paths, sampling=sampling)
    groups = by_header(spark, source, list_paths(spark, source) if paths is None else paths)
    found = [infer_schema(spark, source, files, sampling=sampling) for files in groups.values()]
    return reduce(lambda a, b: merge_schemas(a, b, keep=True), filter(None, found)) if any(found) else None


@dataclass(frozen=True)
class Resolved:
    """A schema, and whether it has every field of the files it was resolved for."""

    schema: T.StructType | None
    all_known: bool = False


def resolve(
    spark: SparkSession,
    source: FileSource,
    store: SchemaStore | None,
    paths: list[str] | None = None,
    *,
    evolve: bool = True,
    sampling: float = 1.0,
) -> Resolved:
    """Schema to read files with: the stored one, widened by what these files have.

    ``paths`` are the files just taken; without them it is all that is there. An explicit
    schema is not inferred over, but merged with the stored one. Text that no common type
    holds leaves the column as it is and is kept in ``_unmatched``; for formats with types
    of their own it is a ``SchemaConflict``.
    """
    stored = store.latest() if store else None
    if stored is not None and not evolve:
        return Resolved(stored)
    found = source.schema or found_schema(spark, source, paths, sampling)
    if found is None:
        return Resolved(stored)
    all_known = source.schema is None and sampling >= 1.0
    try:
        merged = merge_schemas(stored, found) if stored is not None else _nullable(found)
    except SchemaConflict:
        if source.format not in TEXT or source.schema is not None:
            raise
        merged, all_known = merge_schemas(stored, found, keep=True), False
    merged = _nullable(merged)
    if store and merged != stored:
        store.save(merged)
    return Resolved(merged, all_known)


def resolve_schema(spark: SparkSession, source: FileSource, store: SchemaStore | None, **more) -> T.StructType | None:
    return resolve(spark, source, store, **more).schema


def _nullable(schema: T.StructType) -> T.StructType:
    fields = [f for f in schema.fields if not isinstance(f.dataType, T.NullType)]
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])
