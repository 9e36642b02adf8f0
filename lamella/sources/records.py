"""Records split into typed columns and a map of what does not fit them.

A record's fields are read as the columns of a schema. What the schema has no column for,
and what its column cannot hold, goes into the map ``_unmatched`` by field name, with its
text. A record that cannot be read at all is there as a whole, under ``_corrupt_record``.
So every text that arrives is found again, whatever the schema says at that moment.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNMATCHED, CORRUPT = "_unmatched", "_corrupt_record"
UNMATCHED_TYPE = T.MapType(T.StringType(), T.StringType())

_FIELDS = "map<string,variant>"


def _read(value: Column, dtype: str) -> Column:
    return F.try_variant_get(value, "$", dtype)


def _child(fields: Column, name: str) -> Column:
    return F.try_element_at(fields, F.lit(name))


def _fitted(value: Column, dtype: T.DataType) -> tuple[Column, Column]:
    """(the value as the type, whether that loses something of it). Null and absent lose nothing."""
    given = value.isNotNull() & ~F.is_variant_null(value)
    if isinstance(dtype, T.VariantType):
        return value, F.lit(False)
    if isinstance(dtype, T.StructType):
        inner = _read(value, _FIELDS)
        pairs = [_fitted(_child(inner, f.name), f.dataType) for f in dtype.fields]
        columns, lost = [typed.alias(f.name) for f, (typed, _) in zip(dtype.fields, pairs)], [x for _, x in pairs]
        unknown = F.size(F.map_filter(inner, lambda k, _: ~k.isin(dtype.names))) > 0
        return F.when(inner.isNotNull(), F.struct(*columns)), given & (inner.isNull() | unknown | F.exists(F.array(*lost), lambda x: x))
    if isinstance(dtype, T.BinaryType):
        typed = F.try_to_binary(_read(value, "string"), F.lit("base64"))
        return typed, given & typed.isNull()
    typed = _read(value, dtype.simpleString())
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        same = F.to_json(F.try_parse_json(F.to_json(typed))).eqNullSafe(F.to_json(value))
        return typed, given & ~same
    if isinstance(dtype, T.BooleanType):
        fits = _read(value, "string").isin("true", "false")
    elif isinstance(dtype, T.IntegralType):
        text, number = _read(value, "string"), _read(value, "double").eqNullSafe(typed.cast("double"))
        fits = typed.cast("string").eqNullSafe(text) | (number & ~F.startswith(F.to_json(value), F.lit('"')))
    elif isinstance(dtype, T.DecimalType):
        fits = _read(value, "double").eqNullSafe(typed.cast("double"))
    else:
        return typed, given & typed.isNull()
    lost = given & (typed.isNull() | ~fits)
    return F.when(~lost, typed), lost


def _unknown(text: Column, schema: T.StructType, path: str = "$") -> list[Column]:
    """Whether objects have fields that the schema does not name, here and in its structs."""
    keys = F.json_object_keys(text if path == "$" else F.get_json_object(text, path))
    found = [F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, schema.names)).cast("array<string>"))) > 0, F.lit(False))]
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            found += _unknown(text, f.dataType, f"{path}['{f.name}']")
        elif "struct" in f.dataType.simpleString():
            found.append(F.lit(True))  # structs inside arrays and maps are looked at one by one
    return found


def split_json(
    texts: DataFrame, schema: T.StructType, options: Mapping[str, str], keep_corrupt: bool = False, all_known: bool = False
) -> DataFrame:
    """Columns of ``schema`` and ``_unmatched`` from JSON in the column ``value``.

    A text is an object or an array of objects, each of which is a record. Spark's parser
    reads them; only records that it reports, or that have unknown fields, are taken apart
    field by field. ``all_known`` says that the schema was inferred from these very texts,
    which spares the look for unknown fields. Columns besides ``value``, those of source
    folders, take the place of fields of their name. Arrays and maps that would read back
    differently are kept whole besides. With ``keep_corrupt`` the column
    ``_corrupt_record`` has the text of each record that lost something.
    """
    folder = [c for c in texts.columns if c != "value"]
    own = T.StructType([f for f in schema.fields if f.name not in folder])
    several = F.transform(_read(F.try_parse_json("value"), "array<variant>"), lambda v: F.to_json(v))
    one = F.coalesce(F.when(F.startswith(F.ltrim("value"), F.lit("[")), several), F.array("value"))
    records = texts.where(F.trim("value") != "").select(*folder, F.explode(one).alias("_text"))

    parsing = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("_text", T.StructType([*own.fields, T.StructField(CORRUPT, T.StringType())]), parsing)
    reported = F.col(f"_parsed.{CORRUPT}").isNotNull()
    for found in [] if all_known else _unknown(F.col("_text"), own):
        reported |= found
    records = records.withColumn("_parsed", parsed)
    records = records.withColumn("_fields", F.when(reported, _read(F.try_parse_json("_text"), _FIELDS)))
    records = records.withColumn("_broken", F.col("_fields").isNull() & F.col(f"_parsed.{CORRUPT}").isNotNull())

    fields, out, lost = F.col("_fields"), {}, []
    for f in own.fields:
        plain = F.col(f"_parsed.`{f.name}`")
        typed, loses = _fitted(_child(fields, f.name), f.dataType)
        out[f.name] = F.when(fields.isNull(), plain).otherwise(F.coalesce(plain, typed)).alias(f.name)
        whole = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        lost.append(F.when(loses if whole else loses & plain.isNull(), f.name))
    out |= {c: F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in folder if c in schema.names}
    missing = F.array_compact(F.array(F.lit(None).cast("string"), *lost))
    rest = F.map_filter(fields, lambda k, _: ~k.isin(own.names) | F.array_contains(missing, k))
    rest = F.transform_values(rest, lambda _, v: F.to_json(v))
    rest = F.when(F.col("_broken"), F.create_map(F.lit(CORRUPT), "_text")).when(fields.isNotNull() & (F.size(rest) > 0), rest)
    columns = [out[f.name] for f in schema.fields] + [rest.alias(UNMATCHED)]
    if keep_corrupt:
        columns.append(F.when(F.col("_broken") | (fields.isNotNull() & (F.size(missing) > 0)), F.col("_text")).alias(CORRUPT))
    return records.select(*columns)


def _from_csv(text: Column, dtype: T.DataType, options: Mapping[str, str]) -> Column:
    """The text as the type, or null."""
    if isinstance(dtype, T.BooleanType):
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    for kinds, option in (((T.DateType,), "dateFormat"), ((T.TimestampType,), "timestampFormat"), ((T.TimestampNTZType,), "timestampNTZFormat")):
        if isinstance(dtype, kinds) and option in options:
            return F.try_to_timestamp(text, F.lit(options[option])).cast(dtype)
    return text.try_cast(dtype)


def split_csv(rows: DataFrame, schema: T.StructType, options: Mapping[str, str], fields: list[str], keep_corrupt: bool = False) -> DataFrame:
    """The same from CSV rows whose ``fields`` were read as strings, with ``_corrupt_record``.

    The text of a row with too many or too few fields is kept whole, besides the fields it
    has. For ``keep_corrupt``, fields that do not fit are put together to a row again.
    """
    columns, rest = [], []
    for f in schema.fields:
        if f.name not in fields:
            known = F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)
            columns.append(known.cast(f.dataType).alias(f.name))
            continue
        text = F.col(f"`{f.name}`")
        typed = _from_csv(text, f.dataType, options)
        columns.append(typed.alias(f.name))
        if not isinstance(f.dataType, T.StringType):
            rest.append((f.name, typed.isNull() & (F.trim(text) != "")))
    unknown = [(name, F.col(f"`{name}`").isNotNull()) for name in fields if name not in schema.names]
    corrupt = [(CORRUPT, F.col(CORRUPT).isNotNull())]
    entries = [F.when(lost, F.struct(F.lit(n).alias("k"), F.col(f"`{n}`").alias("v"))) for n, lost in [*rest, *unknown, *corrupt]]
    unmatched = F.map_from_entries(F.array_compact(F.array(*entries)))
    out = [*columns, F.when(F.size(unmatched) > 0, unmatched).alias(UNMATCHED)]
    if keep_corrupt:
        whole = F.to_csv(F.struct(*(F.col(f"`{n}`") for n in fields)))
        any_lost = F.exists(F.array(F.lit(False), *(lost for _, lost in rest)), lambda x: x)
        out.append(F.coalesce(F.col(CORRUPT), F.when(any_lost, whole)).alias(CORRUPT))
    return rows.select(*out)
