"""Row rules, on tables with some rows broken on purpose."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.operators import rules as R
from lamella.plans.control import config_rules
from lamella.plans.registry import query, table


@query(
    "rule_in_set",
    """
    SELECT o_orderkey AS row_key, 'o_orderstatus_in_set' AS rule,
           'invalid o_orderstatus: ' || coalesce(s, 'null') AS message
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders)
    WHERE s IS NULL OR s NOT IN ('F', 'O')
    """,
)
def rule_in_set(spark, sf_dir):
    status = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", status)
    return R.validate(orders, [R.in_set("o_orderstatus", ["F", "O"])], "o_orderkey")


@query(
    "rule_invalid_values",
    """
    SELECT DISTINCT o_orderpriority FROM (
      SELECT CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)
    WHERE o_orderpriority IS NULL OR o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
    """,
)
def rule_invalid_values(spark, sf_dir):
    priority = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", priority)
    return R.invalid_values(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query(
    "rule_not_null",
    """
    SELECT o_orderkey AS row_key, 'o_orderpriority_not_null' AS rule, 'o_orderpriority is missing' AS message
    FROM orders WHERE o_orderkey % 10 IN (0, 1)
    """,
)
def rule_not_null(spark, sf_dir):
    rest = F.col("o_orderkey") % 10
    broken = F.when(rest == 1, F.lit("  ")).when(rest != 0, F.col("o_orderpriority"))
    orders = table(spark, sf_dir, "orders").withColumn("o_orderpriority", broken)
    return R.validate(orders, [R.not_null("o_orderpriority")], "o_orderkey")


@query(
    "rule_prefix_when",
    """
    WITH p AS (
      SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN 'secure' ELSE 'any' END AS kind,
             CASE WHEN page_id % 3 = 0 THEN 'ftp://a' ELSE 'https://a' END AS home FROM pages)
    SELECT page_id AS row_key, 'url_prefix' AS rule, 'invalid url: ' || url AS message FROM p
    WHERE kind = 'secure' AND NOT starts_with(url, 'https://')
    UNION ALL
    SELECT page_id, 'options_home_prefix', 'invalid home: ' || home FROM p
    WHERE home LIKE 'ftp%' AND kind <> 'secure'
    """,
)
def rule_prefix_when(spark, sf_dir):
    """A prefix asked for under a condition, and one inside JSON that a condition waives."""
    key = F.col("page_id")
    home = F.when(key % 3 == 0, F.lit("ftp://a")).otherwise(F.lit("https://a"))
    pages = table(spark, sf_dir, "pages").withColumns(
        {
            "kind": F.when(key % 2 == 0, F.lit("secure")).otherwise(F.lit("any")),
            "options": F.to_json(F.struct(home.alias("home"))),
        }
    )
    secure = F.col("kind") == "secure"
    rules = [
        R.prefix_when("url", ["https://"], secure, ["kind"]),
        R.json_prefix("options", "home", ["http://", "https://"], secure, ["kind"]),
    ]
    return R.validate(pages, rules, "page_id")


BROKEN_PROPS = """
    (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, 4) WHEN event_id % 7 = 1 THEN '{"j": 1}'
            WHEN event_id % 7 = 2 THEN '{"k": "none"}' WHEN event_id % 7 = 3 THEN NULL ELSE props END AS props
     FROM events)
"""


def _broken_props(spark, sf_dir):
    rest, props = F.col("event_id") % 7, F.col("props")
    broken = (
        F.when(rest == 0, F.substring(props, 1, 4))
        .when(rest == 1, F.lit('{"j": 1}'))
        .when(rest == 2, F.lit('{"k": "none"}'))
        .when(rest != 3, props)
    )
    return table(spark, sf_dir, "events").withColumn("props", broken)


@query(
    "rule_json_valid",
    f"""
    SELECT event_id AS row_key, 'props_json' AS rule, 'invalid JSON in props: ' || props AS message
    FROM {BROKEN_PROPS} WHERE props IS NOT NULL AND NOT json_valid(props)
    """,
)
def rule_json_valid(spark, sf_dir):
    return R.validate(_broken_props(spark, sf_dir), [R.json_valid("props")], "event_id")


@query(
    "rule_json_key",
    f"""
    SELECT event_id AS row_key, 'props_k_present' AS rule, 'props needs k' AS message
    FROM {BROKEN_PROPS}
    WHERE CASE WHEN json_valid(props) THEN coalesce(props ->> '$.k', '') IN ('', 'none') ELSE false END
    """,
)
def rule_json_key(spark, sf_dir):
    return R.validate(_broken_props(spark, sf_dir), [R.json_key("props", "k", ["none"])], "event_id")


def _notifications(spark, sf_dir):
    """Notification settings per event, with a flag, a list or an address that is wrong in some."""
    rest = F.col("event_id") % 6
    flag = F.when(rest == 0, F.lit("1")).when(rest == 1, F.lit('"yes"')).otherwise(F.lit("true"))
    user = F.concat(F.lit('"user'), F.col("user_id"), F.lit('@example.com"'))
    recipients = (
        F.when(rest == 2, F.lit("[]"))
        .when(rest == 3, F.concat(F.lit("["), user, F.lit(', "nobody"]')))
        .otherwise(F.concat(F.lit("["), user, F.lit("]")))
    )
    cell = F.concat(F.lit('{"on_success": '), flag, F.lit(', "recipients": '), recipients, F.lit("}"))
    return table(spark, sf_dir, "events").withColumn("notifications", F.when(rest != 4, cell).otherwise(F.lit("{}")))


@query(
    "rule_json_type",
    """
    SELECT event_id AS row_key, 'notifications_on_success_type' AS rule,
           'on_success must be BOOLEAN, not ' || CASE event_id % 6 WHEN 0 THEN 'BIGINT' ELSE 'STRING' END AS message
    FROM events WHERE event_id % 6 IN (0, 1)
    """,
)
def rule_json_type(spark, sf_dir):
    return R.validate(_notifications(spark, sf_dir), [R.json_type("notifications", "on_success", "BOOLEAN")], "event_id")


@query(
    "rule_json_array",
    """
    SELECT event_id AS row_key, 'notifications_recipients_array' AS rule,
           'recipients must be a non-empty list' AS message
    FROM events WHERE event_id % 6 IN (2, 4)
    """,
)
def rule_json_array(spark, sf_dir):
    return R.validate(_notifications(spark, sf_dir), [R.json_array("notifications", "recipients")], "event_id")


@query(
    "rule_array_forall",
    """
    SELECT event_id AS row_key, 'notifications_recipients_format' AS rule, 'invalid recipients: nobody' AS message
    FROM events WHERE event_id % 6 = 3
    """,
)
def rule_array_forall(spark, sf_dir):
    rule = R.array_forall("notifications", "recipients", ["@", "."])
    return R.validate(_notifications(spark, sf_dir), [rule], "event_id")


@query(
    "rule_quarantine",
    f"""
    SELECT event_id, props, coalesce(NOT json_valid(props), false)
             OR CASE WHEN json_valid(props) THEN coalesce(props ->> '$.k', '') IN ('', 'none') ELSE false END AS bad
    FROM {BROKEN_PROPS}
    """,
)
def rule_quarantine(spark, sf_dir):
    rules = [R.json_valid("props"), R.json_key("props", "k", ["none"])]
    good, bad = R.quarantine(_broken_props(spark, sf_dir), rules)
    return (
        good.withColumn("bad", F.lit(False)).unionByName(bad.withColumn("bad", F.lit(True))).select("event_id", "props", "bad")
    )


@query(
    "rule_config_table",
    """
    SELECT c_custkey AS row_key, CASE c_custkey % 10
        WHEN 1 THEN 'source_type_in_set' WHEN 2 THEN 'file_format_in_set' WHEN 3 THEN 'trigger_type_in_set'
        WHEN 4 THEN 'cluster_size_in_set' WHEN 5 THEN 'source_path_prefix' WHEN 6 THEN 'cluster_config_json'
        WHEN 7 THEN 'autoloader_options_schema_location_prefix' WHEN 8 THEN 'email_notifications_recipients_format'
        ELSE 'email_notifications_email_on_success_type' END AS rule,
      CASE c_custkey % 10
        WHEN 1 THEN 'invalid source_type: ftp' WHEN 2 THEN 'invalid file_format: xml' WHEN 3 THEN 'invalid trigger_type: null'
        WHEN 4 THEN 'invalid cluster_size: huge' WHEN 5 THEN 'invalid source_path: s3://' || c_name
        WHEN 6 THEN 'invalid JSON in cluster_config: {' || c_name WHEN 7 THEN 'invalid schema_location: /tmp/' || c_name
        WHEN 8 THEN 'invalid recipients: nobody' ELSE 'email_on_success must be BOOLEAN, not STRING' END AS message
    FROM customer WHERE c_custkey % 10 <> 0
    """,
)
def rule_config_table(spark, sf_dir):
    """All checks of a control table, over one that is derived from customers; nine of ten rows break one."""
    customer = table(spark, sf_dir, "customer")
    fault = F.col("c_custkey") % 10

    def value(good, number: int, bad):
        return F.when(fault == number, bad).otherwise(good)

    options = F.struct(
        value(F.concat(F.lit("abfss://c@a/"), "c_name"), 7, F.concat(F.lit("/tmp/"), "c_name")).alias("schema_location"),
        F.lit("abfss://c@a/checkpoint").alias("checkpoint_location"),
    )
    people = F.array(F.lit("a@b.org"), value(F.lit("c@d.org"), 8, F.lit("nobody")))
    mail = F.struct(people.alias("recipients"), F.lit(True).alias("email_on_success"), F.lit(False).alias("email_on_failure"))
    odd = F.struct(people.alias("recipients"), F.lit("yes").alias("email_on_success"), F.lit(False).alias("email_on_failure"))
    config = customer.select(
        "c_custkey", F.lit("dlt").alias("pipeline_type"), value(F.lit("adls"), 1, F.lit("ftp")).alias("source_type"),
        value(F.concat(F.lit("abfss://c@a/"), "c_name"), 5, F.concat(F.lit("s3://"), "c_name")).alias("source_path"),
        value(F.lit("csv"), 2, F.lit("xml")).alias("file_format"), value(F.lit("time"), 3, F.lit(None)).alias("trigger_type"),
        value(F.lit("small"), 4, F.lit("huge")).alias("cluster_size"), F.to_json(options).alias("autoloader_options"),
        value(F.lit("{}"), 6, F.concat(F.lit("{"), "c_name")).alias("cluster_config"),
        value(F.to_json(mail), 9, F.to_json(odd)).alias("email_notifications"),
    )
    return R.validate(config, config_rules(), "c_custkey")
