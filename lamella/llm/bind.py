"""Naming intermediate columns so that Spark evaluates them once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, **values: Column) -> DataFrame:
    """``df`` with further columns, each evaluated once per row.

    A plain projection would be folded into the next one and its expressions repeated
    wherever they are used, inside lambdas even per element. Exploding an array of one
    struct keeps them apart.
    """
    one = F.struct(*(value.alias(name) for name, value in values.items()))
    return df.select("*", F.explode(F.array(one)).alias("_bound")).select("*", "_bound.*").drop("_bound")
