"""JSON text in string columns, read with built-in functions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_json(c: str | Column) -> Column:
    """Whether the text is well-formed JSON; null for null."""
    value = _col(c)
    return F.when(value.isNotNull(), F.try_parse_json(value).isNotNull())


def field(c: str | Column, key: str, dtype: str = "string", default: Any = None) -> Column:
    """Top-level field as ``dtype``, or the default where absent or not readable as that."""
    value = F.try_variant_get(F.try_parse_json(_col(c)), f"$['{key}']", dtype)
    return value if default is None else F.coalesce(value, F.lit(default).cast(dtype))


def has_field(c: str | Column, key: str) -> Column:
    """Whether a JSON object has the field, even if it holds null; null for bad JSON."""
    keys = F.json_object_keys(_col(c))
    return F.when(F.coalesce(is_json(c), F.lit(False)), F.coalesce(F.array_contains(keys, key), F.lit(False)))


def field_type(c: str | Column, key: str) -> Column:
    """Type of a field, such as ``BOOLEAN``, ``BIGINT`` or ``ARRAY<STRING>``; null when absent."""
    value = F.try_variant_get(F.try_parse_json(_col(c)), f"$['{key}']", "variant")
    return F.schema_of_variant(value)


def string_array(c: str | Column, key: str) -> Column:
    """A field holding an array of strings; null when it is absent or not an array."""
    return F.try_variant_get(F.try_parse_json(_col(c)), f"$['{key}']", "array<string>")
