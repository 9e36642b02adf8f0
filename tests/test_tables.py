from __future__ import annotations

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from lamella.operators.tables import change_feed, compact, profile, table_changes, write_balanced
from lamella.plans import gold
from lamella.plans.control import Operation, read_operations, run_group
from lamella.plans.steps import Step, run_steps
from lamella.sources.commits import CommitLog
from lamella.sources.files import FileSource
from lamella.sources.tables import (
    TableRef,
    _Parts,
    append_table,
    changed_rows,
    delete_rows,
    expire_parts,
    read_table,
    replace_table,
    stream_table,
    table_folders,
    table_versions,
)
from lamella.streaming.bronze import append_stream, bronze_schema, default_schema_dir, ingest, read_bronze
from lamella.streaming.landing import compact_bronze, landed_batches, landed_rows, live_files, vacuum_bronze

from .conftest import rows
from .test_sources import put


def test_full_refresh_from_itself_counts_rows_and_keeps_old_readers_working(spark, folder):
    path = f"{folder}/t"
    assert replace_table(spark.range(10), path) == 10
    old = read_table(spark, path)
    assert replace_table(read_table(spark, path).where("id < 4"), path) == 4
    assert read_table(spark, path).count() == 4
    assert old.count() == 10
    assert replace_table(spark.range(0), path) == 0
    assert read_table(spark, path).count() == 0


def test_delete_rewrites_only_the_parts_with_a_match(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.range(5), path)
    append_table(spark.range(5, 10), path)
    first = table_folders(spark, path)[0]
    assert delete_rows(spark, path, F.col("id") > 7) == 2
    assert table_folders(spark, path)[0] == first
    assert rows(read_table(spark, path)) == [(n,) for n in range(8)]
    assert delete_rows(spark, path, F.col("id") > 7) == 0


def test_table_names(spark):
    assert TableRef.parse("c.s.t").path("/root/") == "/root/s/t"
    with pytest.raises(ValueError):
        TableRef.parse("s.t")


def test_compaction_needs_no_shuffle_and_ends_in_one_file(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.range(1000).repartition(64), path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    assert compact(spark, path) == (64, 1)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert read_table(spark, path).agg(F.sum("id")).first()[0] == 499500


def test_a_stream_table_is_compacted_into_another(spark, folder):
    spark.range(100).repartition(20).write.parquet(f"{folder}/files")
    source = FileSource(f"{folder}/files", "parquet", schema=spark.range(1).schema, max_files=5)
    ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint")
    with pytest.raises(ValueError, match="stream"):
        compact(spark, f"{folder}/bronze")
    before, after = compact(spark, f"{folder}/bronze", into=f"{folder}/packed")
    assert before > after == 1
    assert read_table(spark, f"{folder}/packed").count() == 100


def test_large_files_are_not_touched_by_compaction(spark, folder):
    path = f"{folder}/t"
    append_table(spark.range(200_000).coalesce(1), path)
    for n in range(3):
        append_table(spark.range(n * 10, n * 10 + 10).repartition(4), path)
    large = [(n, size) for n, size in _Parts(spark, path).files() if size > 100_000]
    before, after = compact(spark, path, target_bytes=large[0][1])
    assert (before, after) == (13, 2) and large[0] in _Parts(spark, path).files()
    assert compact(spark, path, target_bytes=large[0][1]) == (2, 2)
    assert read_table(spark, path).count() == 200_030
    assert read_table(spark, path, version=3).count() == 200_030


def test_bronze_is_compacted_while_streams_go_on(spark, folder):
    source = FileSource(f"{folder}/files", "json", max_files=1)
    target = f"{folder}/bronze"

    def arrive(low, high):
        spark.range(low, high).coalesce(1).write.mode("append").json(f"{folder}/files")
        ingest(spark, source, target, f"{folder}/checkpoint")

    def copied():
        append_stream(stream_table(spark, target), f"{folder}/copy", f"{folder}/copy-checkpoint")
        return rows(spark.read.parquet(f"{folder}/copy"), "id")

    arrive(1000, 60_000)
    for n in range(4):
        arrive(n * 10, n * 10 + 10)
    schema = bronze_schema(spark, source, default_schema_dir(target))
    large = max(size for _, size in live_files(spark, target))
    everything = rows(spark.range(1000, 60_000).union(spark.range(40)))
    assert copied() == everything
    assert compact_bronze(spark, target, schema, large) == (5, 2)
    assert large in [size for name, size in live_files(spark, target) if "/" not in name]
    assert rows(read_bronze(spark, source, target), "id") == everything
    arrive(40, 50)
    arrive(50, 60)
    everything = rows(spark.range(1000, 60_000).union(spark.range(60)))
    assert compact_bronze(spark, target, schema, large) == (4, 2)
    assert rows(read_bronze(spark, source, target), "id") == copied() == everything
    assert vacuum_bronze(spark, target) == 7
    assert vacuum_bronze(spark, target) == 0
    assert rows(read_bronze(spark, source, target), "id") == everything
    ((stream, batches),) = landed_batches(spark, target).items()
    assert len(batches) == 7
    arrive(60, 70)
    assert rows(landed_rows(spark, target, schema, stream, after=batches[-1]), "id", "_change_type") == [(n, "insert") for n in range(60, 70)]
    assert landed_rows(spark, target, schema, stream, after=99).count() == 0


def test_a_plain_folder_is_not_changed_in_part(spark, folder):
    spark.range(5).write.parquet(f"{folder}/plain")
    with pytest.raises(ValueError, match="plain folder"):
        append_table(spark.range(5), f"{folder}/plain")
    with pytest.raises(ValueError, match="plain folder"):
        delete_rows(spark, f"{folder}/plain", F.col("id") > 1)
    assert read_table(spark, f"{folder}/plain").count() == 5


def test_expired_parts_are_deleted_and_live_ones_kept(spark, folder):
    path = f"{folder}/t"
    for n in range(4):
        replace_table(spark.range(n + 1), path)
    append_table(spark.range(10), path)
    assert expire_parts(spark, path, keep_commits=1) == 3
    assert expire_parts(spark, path, keep_commits=1) == 0
    assert read_table(spark, path).count() == 14


def test_balanced_write_ends_in_few_files(spark, folder):
    write_balanced(spark.range(1000).repartition(64), f"{folder}/t")
    (part,) = table_folders(spark, f"{folder}/t")
    assert len(CommitLog(spark, f"{folder}/t/_commits").sized_files(part)) == 1


def test_change_feed_kinds(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (5, "e")], "id int, v string")
    got = rows(change_feed(old, new, ["id"]))
    assert sorted(got) == [
        (2, "B", "update_postimage"), (2, "b", "update_preimage"), (4, "d", "delete"), (5, "e", "insert"),
    ]


def test_changes_between_versions_of_a_table(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), path)
    append_table(spark.createDataFrame([(3, "c")], "id int, v string"), path)
    delete_rows(spark, path, F.col("id") == 1)
    assert table_versions(spark, path) == [0, 1, 2]
    assert rows(table_changes(spark, path, ["id"], 0, 1)) == [(3, "c", "insert")]
    assert rows(table_changes(spark, path, ["id"], 0)) == [(1, "a", "delete"), (3, "c", "insert")]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, v string")
    assert rows(profile(df)) == [(0, "id", "int", 2, 0), (1, "v", "string", 2, 1)]


def test_gold_tables(spark):
    parts = spark.createDataFrame([(1, "x", 299.99, 50), (2, "x", 0.1, 3)], "id int, c string, price double, qty int")
    (row,) = gold.inventory_value(parts, ["c"], "price", "qty").collect()
    assert (row.products, row.stock_quantity, str(row.inventory_value)) == (2, 53, "14999.80")
    shipped = gold.product_analytics(parts, "id").first()
    assert tuple(shipped)[:5] == ("1", "Analytics Data", "2024", "Q1", 1000) and shipped.processed_at
    facts = spark.createDataFrame([(dt.date(2024, 4, 1), 1.1), (dt.date(2024, 6, 30), 2.2)], "d date, a double")
    assert [(r.year, r.quarter, str(r.amount)) for r in gold.by_quarter(facts, "d", "a").collect()] == [("2024", "Q2", "3.30")]


def test_enrich_keeps_facts_without_a_match(spark):
    facts, dim = spark.range(100).withColumn("k", F.col("id") % 7), spark.range(5).selectExpr("id as k", "id * 2 as d")
    got = gold.enrich(facts, dim, ["k"])
    assert got.count() == 100
    assert got.where("d is null").count() == facts.where("k >= 5").count()


def test_steps_run_by_order_and_stop_at_the_first_failure(spark, folder, caplog):
    seen = []

    def body(name, fail=False):
        def run(spark, tables, params):
            if fail:
                raise RuntimeError("broken step")
            seen.append((name, params.operation_index, params.total_operations, sorted(tables)))
            return spark.range(1)

        return run

    steps = [Step("c", body("c"), 2), Step("a", body("a"), 1), Step("skipped", None, 1), Step("b", body("b"), 1)]
    with caplog.at_level(logging.WARNING):
        run_steps(spark, "g", steps, {}, f"{folder}/1")
    assert "skipped" in caplog.text
    assert seen == [("a", 0, 4, []), ("b", 2, 4, ["a"]), ("c", 3, 4, ["a", "b"])]

    seen.clear()
    with pytest.raises(RuntimeError, match="broken step"):
        run_steps(spark, "g", [Step("a", body("a")), Step("b", body("b", fail=True)), Step("c", body("c"))], {}, f"{folder}/2")
    assert [s[0] for s in seen] == ["a"]
    assert read_table(spark, f"{folder}/2/a").count() == 1

    with pytest.raises(ValueError, match="no step"):
        run_steps(spark, "g", [Step("a", None)], {}, folder)
    with pytest.raises(ValueError, match="same table"):
        run_steps(spark, "g", [Step("a", None), Step("a", None)], {}, folder)


HEADER = "operation_type\tpipeline_group\tsource_type\tfile_format\tsource_path\ttarget_table\ttrigger_type\tschedule\tpipeline_config\tcluster_size\tnotifications\n"


def test_control_table_runs_a_group_twice(spark, folder):
    silver = (
        '{"keys": ["customer_id"], "track_history_except_column_list": ["zip_code", "update_ts"],'
        ' "stored_as_scd_type": "2", "sequence_by": "update_ts"}'
    )
    put(
        folder,
        "control.tsv",
        HEADER
        + f'bronze\tcustomers\tfile\tcsv\t{folder}/csv\tm.bronze.customers\ttime\t0 0 6 * * ?\t{{"header": "true", "inferSchema": "true", "cloudFiles.maxFilesPerTrigger": "100"}}\tmedium\t{{}}\n'
        + f"silver\tcustomers\ttable\t\tm.bronze.customers\tm.silver.customers\ttime\t0 0 6 * * ?\t{silver}\tmedium\t\n"
        + 'gold\tcustomers\tnotebook\t\tby_city\tm.gold.by_city\ttime\t0 0 6 * * ?\t{"notebook_path": "by_city"}\tmedium\t\n'
        + "bronze\tothers\tfile\tjson\tx\tm.bronze.others\ttime\t\t{}\tsmall\t\n",
    )

    def by_city(spark, tables, params):
        return tables["silver.customers"].groupBy("city").agg(F.count(F.lit(1)).alias("versions"))

    operations = read_operations(spark, f"{folder}/control.tsv")
    assert [o.kind for o in operations] == ["bronze", "silver", "gold", "bronze"]
    header = "customer_id,city,zip_code,update_ts\n"
    put(folder, "csv/1.csv", header + "C1,Rome,1,2024-01-15 10:30:00\nC2,Oslo,2,2024-01-15 10:31:00\n")
    run_group(spark, operations, "customers", f"{folder}/lake", {"by_city": by_city})
    put(folder, "csv/2.csv", header + "C1,Rome,9,2024-01-16 00:00:00\nC2,Rome,2,2024-01-17 00:00:00\n")
    tables = run_group(spark, operations, "customers", f"{folder}/lake", {"by_city": by_city})
    got = rows(tables["silver.customers"], "customer_id", "city", "zip_code", "_is_current")
    assert got == [("C1", "Rome", 9, True), ("C2", "Oslo", 2, False), ("C2", "Rome", 2, True)]
    assert rows(tables["gold.by_city"]) == [("Oslo", 1), ("Rome", 2)]
    with pytest.raises(ValueError, match="no operation"):
        run_group(spark, operations, "nobody", folder)


def test_control_table_errors_are_not_swallowed(spark, folder):
    row = {
        "operation_type": "silver", "pipeline_group": "g", "file_format": None, "source_path": "a.b.c",
        "target_table": "a.s.t", "pipeline_config": "{}",
    }
    with pytest.raises(ValueError, match="needs keys"):
        Operation.of(row)
    with pytest.raises(ValueError, match="operation_type"):
        Operation.of({**row, "operation_type": "tin"})
    with pytest.raises(ValueError):
        Operation.of({**row, "pipeline_config": "{bad"})
    line = "bronze\tg\tfile\tcsv\tx\tm.b.t\ttime\t\t{}\tsmall\t\n"
    put(folder, "twice.tsv", HEADER + line + line)
    with pytest.raises(ValueError, match="two operations"):
        read_operations(spark, f"{folder}/twice.tsv")
    put(folder, "short.tsv", "operation_type\nbronze\n")
    with pytest.raises(ValueError, match="missing required columns"):
        read_operations(spark, f"{folder}/short.tsv")


def test_appended_columns_widen_the_table_and_its_versions_do_not_change(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.createDataFrame([(1, "a")], "id int, x string"), path)
    append_table(spark.createDataFrame([(2, 5)], "id long, y int"), path)
    append_table(spark.createDataFrame([(3,)], "id int"), path)
    assert rows(read_table(spark, path), "id", "x", "y") == [(1, "a", None), (2, None, 5), (3, None, None)]
    assert read_table(spark, path, version=0).columns == ["id", "x"]
    with pytest.raises(ValueError):
        append_table(spark.createDataFrame([(True,)], "id boolean"), path)
    assert read_table(spark, path).count() == 3


def test_rows_that_fail_their_check_leave_nothing(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.createDataFrame([(1,)], "id int"), path)

    def refuse(new):
        raise RuntimeError(new.count())

    with pytest.raises(RuntimeError, match="2"):
        append_table(spark.createDataFrame([(2,), (3,)], "id int"), path, refuse)
    assert rows(read_table(spark, path)) == [(1,)]
    assert len(spark.read.option("recursiveFileLookup", "true").parquet(path).inputFiles()) == len(read_table(spark, path).inputFiles())


def test_changes_of_a_table_that_was_widened(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), path)
    append_table(spark.createDataFrame([(3, "c", 5)], "id int, x string, y int"), path)
    changes = table_changes(spark, path, ["id"], 0)
    assert rows(changes, "id", "x", "y", "_change_type") == [(3, "c", 5, "insert")]


def files_read(df):
    return {f.rsplit("/", 1)[1] for f in df.inputFiles()}


def test_changes_read_only_files_that_differ(spark, folder):
    path = f"{folder}/t"
    replace_table(spark.range(1000).withColumn("v", F.col("id") % 3).repartition(10), path)
    first = {n.split("/")[1] for n, _ in _Parts(spark, path).files()}
    assert delete_rows(spark, path, F.col("id") == 77) == 1
    after = {n.split("/")[1] for n, _ in _Parts(spark, path).files()}
    assert len(first & after) == 9 and len(after) == 10  # one file of ten was rewritten
    append_table(spark.range(2000, 2005).selectExpr("id", "id as v", "'x' as more").coalesce(1), path)
    before, now = changed_rows(spark, path, 0)
    assert files_read(before) == first - after and not files_read(now) & first
    got = rows(table_changes(spark, path, ["id"], 0), "id", "more", "_change_type")
    assert sorted(got) == [(77, None, "delete")] + [(n, "x", "insert") for n in range(2000, 2005)]
    assert table_changes(spark, path, ["id"], 2).count() == 0
    assert delete_rows(spark, path, F.col("id") < 1500) == 999 and read_table(spark, path).count() == 5
    assert expire_parts(spark, path, keep_commits=1) == 2 and read_table(spark, path).count() == 5


def test_change_feed_of_null_keys_maps_and_other_types(spark):
    old = spark.sql("select * from values (cast(null as int), 1, map('a', 1)), (2, 2, map('b', 2)), (3, 3, null) as t(id, v, m)")
    new = spark.sql("select * from values (cast(null as bigint), 1L, map('a', 1)), (2L, 2L, map('b', 3)), (4L, 4L, null) as t(id, v, m)")
    got = change_feed(old.drop("m"), new.drop("m"), ["id"])
    assert rows(got) == [(3, 3, "delete"), (4, 4, "insert")]
