"""Gold tables: projections and summaries of silver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product_analytics(silver: DataFrame, key: str, processed_at: Column | None = None) -> DataFrame:
    """Key with fixed attributes, and the time of processing.

    The attribute values are fixed values of the shipped gold table.
    """
    return silver.select(
        F.col(key).cast("string").alias("product_id"),
        F.lit("Analytics Data").alias("data_type"),
        F.lit("2024").alias("year"),
        F.lit("Q1").alias("quarter"),
        F.lit(1000).alias("inventory_value"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"),
    )


def inventory_value(products: DataFrame, by: Sequence[str], price: str, quantity: str) -> DataFrame:
    """Products, pieces and value in stock per group; money in decimals, so sums are exact."""
    value = F.col(price).cast("decimal(18,2)") * F.col(quantity)
    return products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("products"),
        F.sum(F.col(quantity).cast("bigint")).alias("stock_quantity"),
        F.sum(value).cast("decimal(38,2)").alias("inventory_value"),
    )


def by_quarter(facts: DataFrame, date: str, amount: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and amount per year and quarter, both read from a date."""
    return facts.groupBy(
        F.year(date).cast("string").alias("year"),
        F.concat(F.lit("Q"), F.quarter(date)).alias("quarter"),
        *by,
    ).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.col(amount).cast("decimal(18,2)")).cast("decimal(38,2)").alias("amount"),
    )


def enrich(facts: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join with a dimension of unique keys.

    No hint: Spark broadcasts the dimension if its measured size is below
    ``spark.sql.autoBroadcastJoinThreshold``, and otherwise sorts, splitting skewed keys.
    """
    return facts.join(dimension, list(on), "left")
