"""Sinks, table upkeep, groups, text, and gold tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.functions import text
from lamella.operators import groups
from lamella.operators.rules import append_validated, delete_by_value, in_set, not_null, prefix_when
from lamella.operators.tables import compact, profile, table_changes
from lamella.plans import gold
from lamella.plans.registry import query, table
from lamella.session import work_dir
from lamella.sources.tables import append_table, delete_rows, read_table, replace_table


@query("compact_table", "SELECT * FROM lineitem")
def compact_table(spark, sf_dir):
    """A table of 64 small files, packed into few."""
    path = work_dir(spark, "compact")
    replace_table(table(spark, sf_dir, "lineitem").repartition(64), path)
    compact(spark, path)
    return read_table(spark, path)


@query(
    "change_feed_evolved",
    """
    SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, NULL::VARCHAR AS note, 'delete' AS _change_type
    FROM part WHERE p_partkey % 10 = 3
    UNION ALL SELECT p_partkey + 1000000000, p_name, p_brand, p_type, p_size, p_retailprice, 'new ' || p_brand, 'insert'
    FROM part WHERE p_partkey % 4 = 0
    """,
)
def change_feed_evolved(spark, sf_dir):
    """Rows are deleted, then rows with one more column are appended: changes across both versions."""
    part = table(spark, sf_dir, "part")
    path = work_dir(spark, "evolved-changes")
    for rest in (0, 1):
        append_table(part.where(F.col("p_partkey") % 2 == rest), path)
    delete_rows(spark, path, F.col("p_partkey") % 10 == 3)
    added = part.where(F.col("p_partkey") % 4 == 0).withColumn("note", F.concat(F.lit("new "), "p_brand"))
    append_table(added.withColumn("p_partkey", F.col("p_partkey") + 1000000000), path)
    return table_changes(spark, path, ["p_partkey"], since=1)


@query(
    "change_feed",
    """
    WITH edited AS (
      SELECT c_custkey, c_name, c_nationkey,
             CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal,
             CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
      FROM customer WHERE c_custkey % 7 <> 0
      UNION ALL SELECT -1 - c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
      WHERE c_custkey % 5 = 0),
    joined AS (
      SELECT o.c_custkey AS old_key, n.c_custkey AS new_key, o AS old_row, n AS new_row
      FROM customer o FULL OUTER JOIN edited n ON o.c_custkey = n.c_custkey),
    changes AS (
      SELECT unnest(CASE
               WHEN old_key IS NULL THEN [{'t': 'insert', 'r': new_row}]
               WHEN new_key IS NULL THEN [{'t': 'delete', 'r': old_row}]
               WHEN old_row IS DISTINCT FROM new_row
                 THEN [{'t': 'update_preimage', 'r': old_row}, {'t': 'update_postimage', 'r': new_row}]
               ELSE [] END) AS c
      FROM joined)
    SELECT c.r.c_custkey AS c_custkey, c.r.c_name AS c_name, c.r.c_nationkey AS c_nationkey,
           c.r.c_acctbal AS c_acctbal, c.r.c_mktsegment AS c_mktsegment, c.t AS _change_type FROM changes
    """,
)
def change_feed_query(spark, sf_dir):
    """Customers against an edited copy, two versions of a table: changed, nulled, deleted, added rows."""
    old, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    edited = old.where(key % 7 != 0).withColumns(
        {
            "c_acctbal": F.when(key % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")),
            "c_mktsegment": F.when(key % 11 != 0, F.col("c_mktsegment")),
        }
    )
    added = old.where(key % 5 == 0).withColumn("c_custkey", -1 - key)
    path = work_dir(spark, "changes")
    replace_table(old, path)
    replace_table(edited.unionByName(added), path)
    return table_changes(spark, path, ["c_custkey"], since=0)


PRODUCT_ANALYTICS = """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, 'Analytics Data' AS data_type, '2024' AS year, 'Q1' AS quarter,
           1000 AS inventory_value, TIMESTAMP '2024-06-01' AS processed_at FROM part
"""


def _processed_at():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


@query("gold_projection", PRODUCT_ANALYTICS)
def gold_projection(spark, sf_dir):
    return gold.product_analytics(table(spark, sf_dir, "part"), "p_partkey", _processed_at())


@query("gold_full_refresh", PRODUCT_ANALYTICS)
def gold_full_refresh(spark, sf_dir):
    """Refreshed twice; the second time from the table itself."""
    path = work_dir(spark, "gold")
    replace_table(gold.product_analytics(table(spark, sf_dir, "part"), "p_partkey", _processed_at()), path)
    replace_table(read_table(spark, path).distinct(), path)
    return read_table(spark, path)


@query(
    "gold_inventory_value",
    """
    SELECT p_type, count(*) AS products, CAST(sum(p_size) AS BIGINT) AS stock_quantity,
           CAST(sum(CAST(p_retailprice AS DECIMAL(18,2)) * p_size) AS DECIMAL(38,2)) AS inventory_value
    FROM part GROUP BY p_type
    """,
)
def gold_inventory_value(spark, sf_dir):
    return gold.inventory_value(table(spark, sf_dir, "part"), ["p_type"], "p_retailprice", "p_size")


@query(
    "gold_by_quarter",
    """
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, 'Q' || quarter(o_orderdate) AS quarter, o_orderstatus,
           count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
    FROM orders GROUP BY ALL
    """,
)
def gold_by_quarter(spark, sf_dir):
    return gold.by_quarter(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", ["o_orderstatus"])


CUSTOMER_COLUMNS = {
    "c_custkey": "bigint",
    "c_name": "string",
    "c_nationkey": "int",
    "c_acctbal": "double",
    "c_mktsegment": "string",
}


@query(
    "table_profile",
    " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count,"
        f" count(*) FILTER (WHERE {'c_custkey % 4 = 0' if c == 'c_mktsegment' else c + ' IS NULL'}) AS null_count"
        " FROM customer"
        for i, (c, t) in enumerate(CUSTOMER_COLUMNS.items())
    ),
)
def table_profile(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return profile(df.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))))


@query("group_count", "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type")
def group_count(spark, sf_dir):
    return groups.group_count(table(spark, sf_dir, "events"), ["event_type"])


@query(
    "group_all_match",
    "SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS all_match FROM orders GROUP BY o_custkey",
)
def group_all_match(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return groups.group_all_match(orders, ["o_custkey"], F.col("o_orderstatus").isin("F", "O"))


@query(
    "group_first_by_priority",
    """
    SELECT o_custkey, coalesce(
             first(o_orderpriority ORDER BY o_orderdate, o_orderkey) FILTER (WHERE o_orderstatus = 'P'), 'none')
             AS first_priority
    FROM orders GROUP BY o_custkey
    """,
)
def group_first_by_priority(spark, sf_dir):
    """Per customer the priority of the first pending order; ``none`` without one."""
    orders = table(spark, sf_dir, "orders")
    given = orders.withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")))
    return groups.first_by_priority(
        given, ["o_custkey"], "o_orderpriority", ["o_orderdate", "o_orderkey"], default="none", name="first_priority"
    )


@query(
    "group_min_by",
    """
    SELECT p_brand, first(p_name ORDER BY length(p_name), p_name) AS shortest_name FROM part GROUP BY p_brand
    """,
)
def group_min_by(spark, sf_dir):
    return groups.group_min_by(
        table(spark, sf_dir, "part"), ["p_brand"], "p_name", F.length("p_name"), name="shortest_name"
    )


@query("sort_by_json_field", "SELECT event_id, props FROM events")
def sort_by_json_field(spark, sf_dir):
    """Sorted by ``k``; the check compares rows only, ``rank_by_json_field`` shows the order."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    return groups.sort_by_json_number(events, "props", "k", "event_id")


@query(
    "rank_by_json_field",
    """
    SELECT user_id, event_id,
           CAST(row_number() OVER (PARTITION BY user_id
             ORDER BY coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0), event_id) AS INTEGER) AS position
    FROM events
    """,
)
def rank_by_json_field(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "props")
    return groups.rank_by_json_number(events, ["user_id"], "props", "k", "event_id").drop("props")


@query(
    "str_last_part",
    """
    SELECT page_id, split_part(split_part(url, '/', 3), '.', -1) AS top_domain,
           split_part(split_part(url, '/', 3), '.', 1) AS first_label
    FROM pages
    """,
)
def str_last_part(spark, sf_dir):
    host = text.part("url", 2, "/")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.last_part(host).alias("top_domain"), text.part(host, 0).alias("first_label")
    )


@query(
    "str_normalise",
    """
    SELECT o_orderkey, replace(o_orderpriority, 'NOT ', '') AS without_not,
           array_to_string(list_transform(string_split(replace(lower(replace(o_orderpriority, ' ', '_')), '_', ' '), ' '),
             lambda w: CASE WHEN w[2] = '-' THEN w[1] || '-' || upper(w[3]) || w[4:] ELSE upper(w[1]) || w[2:] END), ' ')
             AS label
    FROM orders
    """,
)
def str_normalise(spark, sf_dir):
    name = F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit("_")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.without("o_orderpriority", "NOT ").alias("without_not"), text.label(name).alias("label")
    )


@query(
    "append_validated",
    """
    SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_suppkey % 2 = 1 THEN 0.0::DOUBLE ELSE s_acctbal END AS s_acctbal
    FROM supplier
    """,
)
def append_validated_query(spark, sf_dir):
    """Half of the suppliers is there; the other half comes without a balance and takes the default."""
    suppliers = table(spark, sf_dir, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    path = work_dir(spark, "append")
    replace_table(suppliers.where(~odd), path)
    rules = [not_null("s_name"), prefix_when("s_name", ["Supplier#"]), in_set("s_nationkey", range(25))]
    append_validated(path, suppliers.where(odd).drop("s_acctbal"), rules, "s_suppkey", {"s_acctbal": 0.0})
    return read_table(spark, path)


@query(
    "append_validated_widens",
    """
    SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS s_nationkey,
           CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS s_acctbal
    FROM supplier
    """,
)
def append_validated_widens(spark, sf_dir):
    """The second half lacks one column of the table and brings another, which the table takes over."""
    suppliers = table(spark, sf_dir, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    path = work_dir(spark, "append-wider")
    replace_table(suppliers.where(~odd).select("s_suppkey", "s_name", "s_nationkey"), path)
    append_validated(path, suppliers.where(odd).select("s_suppkey", "s_name", "s_acctbal"), [not_null("s_name")], "s_suppkey")
    return read_table(spark, path)


@query("delete_by_key", "SELECT * FROM orders WHERE o_orderstatus <> 'P'")
def delete_by_key(spark, sf_dir):
    """Two parts; a value in none of them rewrites nothing."""
    orders = table(spark, sf_dir, "orders")
    path = work_dir(spark, "delete")
    replace_table(orders.where(F.col("o_orderkey") % 2 == 0), path)
    append_table(orders.where(F.col("o_orderkey") % 2 == 1), path)
    assert delete_by_value(spark, path, "o_orderstatus", "P")
    assert not delete_by_value(spark, path, "o_orderstatus", "P")
    return read_table(spark, path)
