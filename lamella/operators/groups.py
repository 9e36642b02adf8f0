"""Per-group questions; all but ranks combine on the map side before the one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.functions import json as J
from lamella.functions.text import is_blank
from lamella.operators.skew import SLICE, Skew, SkewPolicy, find_hot_keys, materialize, split_hot, with_slices


def group_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per group; null groups are kept."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def group_all_match(df: DataFrame, by: Sequence[str], condition: Column, name: str = "all_match") -> DataFrame:
    """Whether the condition holds in all rows of the group; a null is not a match."""
    return df.groupBy(*by).agg(F.bool_and(F.coalesce(condition, F.lit(False))).alias(name))


def first_by_priority(
    df: DataFrame, by: Sequence[str], value: str, priority: Sequence[str | Column], default=None, name: str | None = None
) -> DataFrame:
    """The first value per group, by ascending priority, nulls last, that is neither null nor blank."""
    given = F.when(~is_blank(value), F.col(value))
    ranks = [F.col(p) if isinstance(p, str) else p for p in priority]
    order = F.when(given.isNotNull(), F.struct(*(c for p in ranks for c in (p.isNull(), p))))
    best = F.min_by(given, order)
    return df.groupBy(*by).agg((F.coalesce(best, F.lit(default)) if default is not None else best).alias(name or value))


def group_min_by(df: DataFrame, by: Sequence[str], value: str, derived: Column, name: str | None = None) -> DataFrame:
    """The value with the smallest derived number per group; of equals, the smallest value. Rows without one do not count."""
    order = F.when(derived.isNotNull(), F.struct(derived, F.col(value)))
    return df.groupBy(*by).agg(F.min_by(F.col(value), order).alias(name or value))


def sort_by_json_number(df: DataFrame, column: str, key: str, *then: str | Column, default: int = 0) -> DataFrame:
    """Total order by a number inside JSON text; absent or bad counts as ``default``."""
    return df.orderBy(J.field(column, key, "int", default), *then)


def rank_by_json_number(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    key: str,
    *then: str | Column,
    default: int = 0,
    name: str = "position",
    skew: Skew = SkewPolicy(),
) -> DataFrame:
    """The rows with their place, from 1, in that order within each group.

    Groups too large for one task are cut into ordered slices; rows are numbered within
    each, and the sizes of the slices before are added.
    """
    order = [J.field(column, key, "int", default), *(F.col(c) if isinstance(c, str) else c for c in then)]

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))

    hot = find_hot_keys(df, by, skew)
    if hot is None:
        return numbered(df)
    ordinary, large = split_hot(df, by, hot)
    return numbered(ordinary).unionByName(_numbered_in_slices(large, by, order, name, hot.slices))


def _numbered_in_slices(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str, slices: int) -> DataFrame:
    ordering = [f"_order{i}" for i in range(len(order))]
    # positions in a written table do not change, so ties and copies keep one order
    fixed = materialize(rows.select("*", *(c.alias(o) for o, c in zip(ordering, order))))
    fixed = fixed.withColumn("_copy", F.monotonically_increasing_id())
    sliced = with_slices(fixed, [*by, *ordering, "_copy"], slices)
    within = Window.partitionBy(*by, SLICE).orderBy(*ordering, "_copy")
    placed = materialize(sliced.withColumn("_place", F.row_number().over(within)).drop("_copy", *ordering))
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_rows"))
    before = sizes.select(
        F.struct(*by).alias("_by"), F.col(SLICE).alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    same = (F.col("_of") == F.col(SLICE)) & F.col("_by").eqNullSafe(F.struct(*by))
    place = (F.col("_place") + F.col("_before")).cast("int").alias(name)
    return placed.join(before, same).select(*rows.columns, place)
