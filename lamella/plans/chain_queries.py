"""Chains of steps, and the way from files to gold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators.history import INGESTED
from lamella.plans.control import read_operations, run_group
from lamella.plans.gold import enrich, inventory_value
from lamella.plans.registry import query, table
from lamella.plans.steps import Step, run_steps
from lamella.session import work_dir
from lamella.sources.export import write_control_table, write_files
from lamella.sources.files import FileSource
from lamella.sources.tables import read_table, replace_table, stream_table
from lamella.streaming.bronze import ingest
from lamella.streaming.silver import SilverTable

GROUP = "order_analytics"


def _prepare(spark, tables, params):
    orders = tables["orders"].where(F.col("o_orderstatus") != "P")
    return orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(18,2)").alias("amount"))


def _enrich(spark, tables, params):
    customers = tables["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nations = tables["nation"].select("n_nationkey", "n_name")
    with_customer = enrich(tables["prepared"], customers, ["o_custkey"])
    return enrich(with_customer, nations, ["n_nationkey"])


def _report(spark, tables, params):
    return tables["enriched"].groupBy("n_name").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("amount").cast("decimal(38,2)").alias("amount")
    )


def _run(spark, sf_dir):
    steps = [Step("report", _report, 3), Step("prepared", _prepare, 1), Step("enriched", _enrich, 2)]
    inputs = {name: table(spark, sf_dir, name) for name in ("orders", "customer", "nation")}
    return run_steps(spark, GROUP, steps, inputs, work_dir(spark, "steps"))


@query(
    "steps_chain",
    "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders WHERE o_orderstatus <> 'P'",
)
def steps_chain(spark, sf_dir):
    """Given out of order; what the first step wrote."""
    return _run(spark, sf_dir)["prepared"]


@query(
    "steps_enrich",
    """
    SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, n_nationkey, n_name
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P'
    """,
)
def steps_enrich(spark, sf_dir):
    return _run(spark, sf_dir)["enriched"]


@query(
    "steps_final_report",
    """
    SELECT n_name, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS amount
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderstatus <> 'P' GROUP BY n_name
    """,
)
def steps_final_report(spark, sf_dir):
    return _run(spark, sf_dir)["report"]


@query(
    "steps_params",
    """
    SELECT s_suppkey, s_name, 'supplier_load' AS pipeline_group, 'manual' AS operation_type,
           1 AS operation_index, 2 AS total_operations FROM supplier
    """,
)
def steps_params(spark, sf_dir):
    """Each step is told its group, type, position and the number of steps."""

    def first(spark, tables, params):
        return tables["supplier"].select("s_suppkey", "s_name")

    def second(spark, tables, params):
        return params.add_to(tables["first"])

    inputs = {"supplier": table(spark, sf_dir, "supplier")}
    steps = [Step("first", first, 1), Step("second", second, 2)]
    return run_steps(spark, "supplier_load", steps, inputs, work_dir(spark, "params"))["second"]


@query(
    "medallion_end_to_end",
    """
    WITH marked AS (
      SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS changed
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    starts AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to
               FROM marked WHERE changed = 1)
    SELECT event_type, count(*) AS versions, count(*) FILTER (WHERE valid_to IS NULL) AS open_versions,
           count(DISTINCT user_id) AS users
    FROM starts GROUP BY event_type
    """,
)
def medallion_end_to_end(spark, sf_dir):
    """Events as CSV files to bronze, to silver history, to a gold table per event type."""
    events = table(spark, sf_dir, "events")
    root = work_dir(spark, "medallion")
    write_files(events, f"{root}/files", "csv")
    source = FileSource(f"{root}/files", "csv", schema=events.schema)
    ingest(spark, source, f"{root}/bronze", f"{root}/bronze-checkpoint")
    silver = SilverTable(
        spark,
        f"{root}/silver",
        ["user_id"],
        "ts",
        tie_break=["event_id"],
        tracked=["event_type"],
        drop=["value", "props", INGESTED],
        buckets=8,
    )
    silver.start(stream_table(spark, f"{root}/bronze"), f"{root}/silver-checkpoint")
    per_user = silver.read(spark).groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("versions"), F.count_if("_is_current").alias("open_versions")
    )
    summary = per_user.groupBy("event_type").agg(
        F.sum("versions").alias("versions"),
        F.sum("open_versions").alias("open_versions"),
        F.count(F.lit(1)).alias("users"),
    )
    replace_table(summary, f"{root}/gold")
    return read_table(spark, f"{root}/gold")


@query(
    "control_table_run",
    """
    SELECT p_type, count(*) AS products, CAST(sum(p_size) AS BIGINT) AS stock_quantity,
           CAST(sum(CAST(p_retailprice AS DECIMAL(18,2)) * p_size) AS DECIMAL(38,2)) AS inventory_value
    FROM part WHERE p_size > 10 GROUP BY p_type
    """,
)
def control_table_run(spark, sf_dir):
    """Parts as CSV files through bronze, silver, gold and one manual step, all named in a TSV table."""
    root = work_dir(spark, "control")
    write_files(table(spark, sf_dir, "part"), f"{root}/files", "csv")
    silver = '{"keys": ["p_partkey"], "track_history_except_column_list": ["p_name"], "stored_as_scd_type": "2"}'
    rows = [
        ("bronze", "parts", "file", "csv", f"{root}/files", "main.bronze.parts", '{"header": "true"}'),
        ("silver", "parts", "table", None, "main.bronze.parts", "main.silver.parts", silver),
        ("gold", "parts", "notebook", None, "large_parts", "main.gold.large_parts", "{}"),
        ("manual", "parts", "notebook", None, "inventory", "main.gold.inventory", '{"order": 1}'),
    ]
    columns = "operation_type, pipeline_group, source_type, file_format, source_path, target_table, pipeline_config"
    write_control_table(spark.createDataFrame(rows, columns.split(", ")).coalesce(1), f"{root}/control")

    def large_parts(spark, tables, params):
        return tables["silver.parts"].where(F.col("_is_current") & (F.col("p_size") > 10))

    def inventory(spark, tables, params):
        return inventory_value(tables["gold.large_parts"], ["p_type"], "p_retailprice", "p_size")

    operations = read_operations(spark, f"{root}/control")
    bodies = {"large_parts": large_parts, "inventory": inventory}
    return run_group(spark, operations, "parts", f"{root}/tables", bodies, buckets=8)["gold.inventory"]


WIDENED_SUPPLIERS = """
    SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 2 = 1 THEN s_acctbal END AS s_acctbal, s_suppkey % 2 = 1 AS in_second
    FROM supplier
    """


def _widened_suppliers(spark, sf_dir, options):
    """A second file has a further column; both runs of the group end in the silver table."""
    suppliers, odd = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 2 == 1
    root = work_dir(spark, "control-wider")
    silver = '{"keys": ["s_suppkey"], "stored_as_scd_type": "2"}'
    rows = [
        ("bronze", "suppliers", "file", "parquet", f"{root}/files", "main.bronze.suppliers", options),
        ("silver", "suppliers", "table", None, "main.bronze.suppliers", "main.silver.suppliers", silver),
    ]
    columns = "operation_type, pipeline_group, source_type, file_format, source_path, target_table, pipeline_config"
    write_control_table(spark.createDataFrame(rows, columns.split(", ")).coalesce(1), f"{root}/control")
    operations = read_operations(spark, f"{root}/control")
    narrow = suppliers.where(~odd).select("s_suppkey", "s_name")
    for arrival in (narrow, suppliers.where(odd).select("s_suppkey", "s_name", "s_acctbal")):
        write_files(arrival, f"{root}/files", "parquet")
        tables = run_group(spark, operations, "suppliers", f"{root}/tables", buckets=8)
    bronze = tables["bronze.suppliers"].select("s_suppkey", F.col("s_acctbal").isNotNull().alias("in_second"))
    current = tables["silver.suppliers"].where("_is_current").select("s_suppkey", "s_name", "s_acctbal")
    return current.join(bronze, "s_suppkey")


@query("bronze_schema_evolve_control", WIDENED_SUPPLIERS)
def bronze_schema_evolve_control(spark, sf_dir):
    return _widened_suppliers(spark, sf_dir, "{}")


@query("control_table_overwrites", WIDENED_SUPPLIERS)
def control_table_overwrites(spark, sf_dir):
    """The same where rewritten files are taken again, which has a layout of its own."""
    return _widened_suppliers(spark, sf_dir, '{"cloudFiles.allowOverwrites": "true"}')
