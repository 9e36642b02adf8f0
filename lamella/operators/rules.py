"""Row rules: violations in one pass, splitting good rows from bad, validated append."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import json as J
from lamella.functions.text import is_blank
from lamella.session import work_dir
from lamella.sources.tables import append_table, delete_rows, drop_table, read_table, replace_table, table_notes


class RuleViolations(ValueError):
    """Rows broke the rules; carries the first messages, the number of all and the table that holds them."""

    def __init__(self, count: int, messages: list[str], path: str):
        super().__init__(f"{count} violations, all of them in {path}:\n" + "\n".join(messages))
        self.count, self.messages, self.path = count, messages, path


@dataclass(frozen=True, eq=False)
class Rule:
    """``broken`` is true for rows that violate the rule; null counts as not broken."""

    name: str
    broken: Column
    message: Column
    columns: tuple[str, ...]


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _message(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else _text(p) for p in parts])


def in_set(column: str, allowed: Sequence) -> Rule:
    """The value is one of ``allowed``; null is not."""
    c = F.col(column)
    return Rule(f"{column}_in_set", ~c.isin(list(allowed)) | c.isNull(), _message(f"invalid {column}: ", c), (column,))


def not_null(column: str) -> Rule:
    """Neither null nor, for text, blank."""
    return Rule(f"{column}_not_null", is_blank(F.col(column).cast("string")), _message(f"{column} is missing"), (column,))


def prefix_when(column: str, prefixes: Sequence[str], when: Column | None = None, when_columns: Sequence[str] = ()) -> Rule:
    """The value starts with one of ``prefixes`` wherever ``when`` holds; null does not."""
    c = F.col(column)
    starts = reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])
    broken = ~F.coalesce(starts, F.lit(False))
    broken = broken & when if when is not None else broken
    return Rule(f"{column}_prefix", broken, _message(f"invalid {column}: ", c), (column, *when_columns))


def json_valid(column: str) -> Rule:
    """Well-formed JSON, where there is anything."""
    c = F.col(column)
    return Rule(f"{column}_json", ~is_blank(c) & ~J.is_json(c), _message(f"invalid JSON in {column}: ", c), (column,))


def json_key(
    column: str,
    key: str,
    placeholders: Sequence[str] = (),
    when: Column | None = None,
    when_columns: Sequence[str] = (),
) -> Rule:
    """The field is there, not empty and not a placeholder. Bad JSON is left to ``json_valid``."""
    value = J.field(column, key)
    broken = J.is_json(column) & (is_blank(value) | value.isin(["", *placeholders]))
    broken = broken & when if when is not None else broken
    return Rule(f"{column}_{key}_present", broken, _message(f"{column} needs {key}"), (column, *when_columns))


def json_prefix(
    column: str,
    key: str,
    prefixes: Sequence[str],
    waived: Column | None = None,
    when_columns: Sequence[str] = (),
) -> Rule:
    """The field, where given, starts with one of ``prefixes`` unless ``waived`` holds."""
    value = J.field(column, key)
    starts = reduce(lambda a, b: a | b, [value.startswith(p) for p in prefixes])
    broken = ~is_blank(value) & ~starts
    broken = broken & ~F.coalesce(waived, F.lit(False)) if waived is not None else broken
    return Rule(f"{column}_{key}_prefix", broken, _message(f"invalid {key}: ", value), (column, *when_columns))


def json_type(column: str, key: str, dtype: str) -> Rule:
    """The field, where given, has the JSON type, such as ``BOOLEAN`` or ``BIGINT``."""
    found = J.field_type(column, key)
    return Rule(f"{column}_{key}_type", found != dtype, _message(f"{key} must be {dtype}, not ", found), (column,))


def json_array(column: str, key: str) -> Rule:
    """The field is an array with at least one element. Bad JSON is left to ``json_valid``."""
    size = F.coalesce(F.size(J.string_array(column, key)), F.lit(0))
    broken = J.is_json(column) & (size < 1)
    return Rule(f"{column}_{key}_array", broken, _message(f"{key} must be a non-empty list"), (column,))


def array_forall(column: str, key: str, contains: Sequence[str]) -> Rule:
    """Every element of the array contains all of ``contains``, such as ``@`` and ``.``."""

    def fits(x: Column) -> Column:
        return F.coalesce(reduce(lambda a, b: a & b, [F.contains(x, F.lit(t)) for t in contains]), F.lit(False))

    bad = F.filter(J.string_array(column, key), lambda x: ~fits(x))
    message = _message(f"invalid {key}: ", F.array_join(bad, ", ", "null"))
    return Rule(f"{column}_{key}_format", F.size(bad) > 0, message, (column,))


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that the frame lacks, in the order asked for."""
    return [c for c in required if c not in df.columns]


def _usable(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if not missing_columns(df, r.columns)]


def validate(df: DataFrame, rules: Sequence[Rule], key: str | Column) -> DataFrame:
    """Violations as rows (``row_key``, ``rule``, ``message``): one scan, no shuffle.

    A rule on a column that is not there gives one violation without a row key instead.
    """
    usable = _usable(df, rules)
    row_key = (F.col(key) if isinstance(key, str) else key).alias("row_key")
    found = [F.when(r.broken, F.struct(F.lit(r.name).alias("rule"), r.message.alias("message"))) for r in usable]
    if found:
        # a projection of its own, where Spark evaluates what rules have in common once
        listed = df.select(row_key, F.array(*found).alias("_found"))
        out = listed.select("row_key", F.inline(F.array_compact("_found")))
    else:
        out = df.limit(0).select(row_key, F.lit("").alias("rule"), F.lit("").alias("message"))
    absent = [(r.name, f"missing columns: {missing_columns(df, r.columns)}") for r in rules if r not in usable]
    if absent:
        rows = df.sparkSession.createDataFrame(absent, "rule string, message string")
        out = out.unionByName(rows, allowMissingColumns=True)
    return out


def invalid_values(df: DataFrame, column: str, allowed: Sequence) -> DataFrame:
    """The distinct values outside ``allowed``, null among them; combined before the shuffle."""
    return df.where(in_set(column, allowed).broken).select(column).distinct()


def is_broken(rules: Sequence[Rule]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(r.broken, F.lit(False)) for r in rules], F.lit(False))


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, rows that break one)."""
    bad = is_broken(rules)
    return df.where(~bad), df.where(bad)


def require(df: DataFrame, rules: Sequence[Rule], key: str | Column, shown: int = 100) -> None:
    """Raise ``RuleViolations`` if any row breaks a rule.

    All violations are written to a new table in the shared folder, which the error names;
    at most ``shown`` reach the driver.
    """
    path = work_dir(df.sparkSession, "violations")
    count = replace_table(validate(df, rules, key), path)
    if count:
        head = read_table(df.sparkSession, path).limit(shown).collect()
        raise RuleViolations(count, [f"{r.rule}: {r.message}" for r in head], path)
    drop_table(df.sparkSession, path)


def fingerprint(rules: Sequence[Rule]) -> str:
    """Equal for rule sets that say the same; numbers that Spark gives to lambda variables do not count."""
    said = sorted(f"{r.name}|{r.broken}|{r.message}|{r.columns}" for r in rules)
    return hashlib.sha256(re.sub(r"([a-z])_[0-9]+\b", r"\1", "\n".join(said)).encode()).hexdigest()


def append_validated(path: str, rows: DataFrame, rules: Sequence[Rule], key: str | Column, defaults: dict | None = None) -> int:
    """Append all of ``rows`` to the table, or nothing and raise.

    The rules hold for the stored and the new rows together. The commit notes the rule set,
    so stored rows are read only when it differs, when something else was written in
    between, or when a rule needs a column that they lack. Columns missing from the new
    rows take their default, and nulls do too. Columns that the table lacks widen it. The
    new rows are written before they are checked, so what is checked is what becomes
    visible, whatever ``rows`` is computed from.
    """
    for name, value in (defaults or {}).items():
        given = F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value)
        rows = rows.withColumn(name, given)
    stored, said = read_table(rows.sparkSession, path), fingerprint(rules)
    needed = {c for r in rules for c in r.columns}
    known = table_notes(rows.sparkSession, path).get("rules") == said and needed <= set(stored.columns)
    before = rows.sparkSession.createDataFrame([], stored.schema) if known else stored

    def check(new: DataFrame) -> None:
        require(before.unionByName(new, allowMissingColumns=True), rules, key)

    return append_table(rows, path, check, {"rules": said})


def delete_by_value(spark: SparkSession, path: str, column: str, value) -> bool:
    """Delete rows by value; nulls stay. Says whether any row matched."""
    return delete_rows(spark, path, F.col(column) == F.lit(value)) > 0
