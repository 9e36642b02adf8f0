from __future__ import annotations

import datetime as dt
import os
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.changed_files import changed_runs, ingest_changed_files, read_changed_files
from lamella.sources.commits import CommitLog
from lamella.sources.export import convert, write_files
from lamella.sources.files import FileSource, infer_schema, read_control_table, read_files, split_corrupt
from lamella.sources.schemas import SchemaConflict, SchemaStore, merge_schemas, resolve, resolve_schema
from lamella.streaming.bronze import ingest, read_bronze

from .conftest import rows


def put(folder: str, name: str, text: str) -> None:
    path = Path(urlparse(folder).path) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def bronze(spark, folder, source, **more):
    ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint", **more)
    return spark.read.parquet(f"{folder}/bronze").drop("_ingestion_timestamp", "_unmatched")


def test_csv_with_header_and_explicit_schema_keeps_leading_zeros(spark, folder):
    put(folder, "files/a.csv", "id,zip,at\n1,01001,2024-01-15 10:30:00\n")
    source = FileSource(f"{folder}/files", "csv", schema=schema("id int, zip string, at timestamp_ntz"))
    assert rows(bronze(spark, folder, source)) == [(1, "01001", dt.datetime(2024, 1, 15, 10, 30))]


def test_inferred_types_and_inference_turned_off(spark, folder):
    put(folder, "files/a.csv", "id,zip,price\n1,01001,2.5\n")
    found = infer_schema(spark, FileSource(f"{folder}/files", "csv"))
    assert found.simpleString() == "struct<id:int,zip:int,price:double>"
    found = infer_schema(spark, FileSource(f"{folder}/files", "csv", infer=False))
    assert found.simpleString() == "struct<id:string,zip:string,price:string>"


def test_csv_without_header(spark, folder):
    put(folder, "files/a.csv", "1,x\n2,y\n")
    source = FileSource(f"{folder}/files", "csv", header=False, schema=schema("id int, v string"))
    assert rows(bronze(spark, folder, source)) == [(1, "x"), (2, "y")]


def test_json_lines_and_multi_line_documents(spark, folder):
    put(folder, "lines/a.json", '{"id": 1}\n{"id": 2}\n')
    put(folder, "documents/a.json", '[\n  {"id": 1},\n  {"id": 2}\n]\n')
    wanted = schema("id bigint")
    lines = FileSource(f"{folder}/lines", "json", schema=wanted)
    documents = FileSource(f"{folder}/documents", "json", schema=wanted, multi_line=True)
    assert rows(bronze(spark, f"{folder}/1", lines)) == [(1,), (2,)]
    assert rows(bronze(spark, f"{folder}/2", documents)) == [(1,), (2,)]


@pytest.mark.parametrize("format", ["csv", "json", "parquet", "orc"])
def test_microseconds_and_json_text_survive_a_round_trip(spark, folder, format):
    df = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 2, 3, 4, 5, 123456), '{"k": "a,\\"b"}'), (2, None, None)],
        "id int, at timestamp_ntz, props string",
    )
    write_files(df, f"{folder}/files", format)
    source = FileSource(f"{folder}/files", format, schema=df.schema)
    assert rows(bronze(spark, folder, source)) == rows(df)


def test_nested_json_round_trip(spark, folder):
    df = spark.sql("select 1 as id, named_struct('a', 2, 'b', array('x', 'y')) as s, map('k', 1.5D) as m")
    write_files(df, f"{folder}/files", "json")
    source = FileSource(f"{folder}/files", "json", schema=df.schema)
    assert bronze(spark, folder, source).collect() == df.collect()


@pytest.mark.parametrize("format", ["csv", "json"])
def test_corrupt_rows_are_split_off_with_their_text(spark, folder, format):
    good = {"csv": "id,n\n1,2\n", "json": '{"id": 1, "n": 2}\n'}[format]
    bad = {"csv": "7\n", "json": '{"id": 1, "n"\n'}[format]
    put(folder, f"files/a.{format}", good + bad)
    source = FileSource(f"{folder}/files", format, schema=schema("id int, n int"), keep_corrupt=True)
    kept, corrupt = split_corrupt(bronze(spark, folder, source))
    assert rows(kept) == [(1, 2)]
    assert rows(corrupt, "_corrupt_record") == [(bad.strip(),)]


def test_each_file_is_taken_once_in_bounded_batches(spark, folder):
    source = FileSource(f"{folder}/files", "json", schema=schema("id int"), max_files=2)
    for n in range(5):
        put(folder, f"files/{n}.json", f'{{"id": {n}}}\n')
    query = ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint")
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [2, 2, 1]
    put(folder, "files/5.json", '{"id": 5}\n')
    for _ in range(2):
        got = bronze(spark, folder, source)
        assert rows(got) == [(n,) for n in range(6)]
    stamps = spark.read.parquet(f"{folder}/bronze").select("_ingestion_timestamp").distinct().count()
    assert stamps == 4


def test_an_interval_query_keeps_running(spark, folder):
    source = FileSource(f"{folder}/files", "json", schema=schema("id int"))
    put(folder, "files/0.json", '{"id": 0}\n')
    query = ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint", interval="1 second")
    try:
        query.processAllAvailable()
        assert query.isActive
        put(folder, "files/1.json", '{"id": 1}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(spark.read.parquet(f"{folder}/bronze"), "id") == [(0,), (1,)]


def test_a_rewritten_file_is_ignored_or_taken_again(spark, folder):
    wanted = schema("id int, v string")
    once = FileSource(f"{folder}/files", "json", schema=wanted)
    again = FileSource(f"{folder}/files", "json", schema=wanted, allow_overwrites=True, max_files=1)
    put(folder, "files/a.json", '{"id": 1, "v": "old"}\n')
    put(folder, "files/b.json", '{"id": 2, "v": "same"}\n')
    bronze(spark, folder, once)
    assert ingest(spark, again, f"{folder}/changed", "") == 2
    assert ingest(spark, again, f"{folder}/changed", "") == 0
    put(folder, "files/a.json", '{"id": 1, "v": "newer"}\n')
    assert rows(bronze(spark, folder, once), "v") == [("old",), ("same",)]
    assert ingest(spark, again, f"{folder}/changed", "") == 1
    assert rows(read_changed_files(spark, f"{folder}/changed"), "v") == [("newer",), ("old",), ("same",)]


def test_the_ledger_is_folded_and_forgets_nothing(spark, folder, monkeypatch):
    monkeypatch.setattr("lamella.sources.changed_files.LEDGERS", 2)
    monkeypatch.setattr("lamella.sources.changed_files.RUNS", 2)
    monkeypatch.setattr("lamella.sources.changed_files.AHEAD", 2)
    source = FileSource(f"{folder}/files", "json", schema=schema("id int"), allow_overwrites=True, max_files=1)
    for n in range(5):
        put(folder, f"files/{n}.json", f'{{"id": {n}}}\n')
    assert ingest_changed_files(spark, source, source.schema, f"{folder}/bronze") == 5
    assert ingest_changed_files(spark, source, source.schema, f"{folder}/bronze") == 0
    state = CommitLog(spark, f"{folder}/bronze/_commits").latest()[1]
    assert len(state["ledgers"]) < 3 and len(state["runs"]) <= 2 and len(changed_runs(spark, f"{folder}/bronze")) == 5
    assert rows(read_changed_files(spark, f"{folder}/bronze"), "id") == [(n,) for n in range(5)]


def test_a_run_that_fails_before_its_commit_is_not_seen(spark, folder, monkeypatch):
    put(folder, "files/a.json", '{"id": 1}\n')
    source = FileSource(f"{folder}/files", "json", schema=schema("id int"), allow_overwrites=True)
    with monkeypatch.context() as m:
        m.setattr(CommitLog, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest_changed_files(spark, source, source.schema, f"{folder}/bronze")
    assert ingest_changed_files(spark, source, source.schema, f"{folder}/bronze") == 1
    assert rows(read_changed_files(spark, f"{folder}/bronze"), "id") == [(1,)]


def test_empty_folder_gives_nothing_or_an_empty_table(spark, folder):
    put(folder, "files/_ignored", "")
    assert ingest(spark, FileSource(f"{folder}/files", "json"), f"{folder}/b", f"{folder}/c") is None
    source = FileSource(f"{folder}/files", "json", schema=schema("id int"))
    assert read_files(spark, source, source.schema).count() == 0


def test_added_columns_are_null_in_older_rows(spark, folder):
    source = FileSource(f"{folder}/files", "json")
    put(folder, "files/a.json", '{"id": 1}\n')
    bronze(spark, folder, source, schema_dir=f"{folder}/schemas")
    put(folder, "files/b.json", '{"extra": "x", "id": 2}\n')
    bronze(spark, folder, source, schema_dir=f"{folder}/schemas")
    store = SchemaStore(spark, f"{folder}/schemas")
    assert store.versions() == 2
    got = spark.read.schema(store.latest()).parquet(f"{folder}/bronze")
    assert rows(got, "id", "extra") == [(1, None), (2, "x")]


def test_new_columns_are_found_in_any_session_time_zone(spark, folder):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for n, spark_zone in enumerate(("America/Los_Angeles", "Asia/Tokyo")):
            spark.conf.set("spark.sql.session.timeZone", spark_zone)
            source = FileSource(f"{folder}/{n}/files", "json")
            for m, line in enumerate(('{"id": 1}', '{"id": 2, "extra": 1}')):
                put(folder, f"{n}/files/{m}.json", line + "\n")
                found = resolve_schema(spark, source, SchemaStore(spark, f"{folder}/{n}/schemas"))
            assert found.names == ["id", "extra"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_integers_widen_and_old_files_still_read(spark, folder):
    source = FileSource(f"{folder}/files", "csv")
    store = SchemaStore(spark, f"{folder}/schemas")
    for name, value in (("a", "1"), ("b", "3000000000"), ("c", "7")):
        put(folder, f"files/{name}.csv", f"id\n{value}\n")
        bronze(spark, folder, source, schema_dir=f"{folder}/schemas")
    assert store.latest().simpleString() == "struct<id:bigint>"
    got = spark.read.schema(store.latest()).parquet(f"{folder}/bronze")
    assert rows(got) == [(1,), (3000000000,), (7,)]


def test_a_type_that_cannot_widen_stops_with_an_error(spark, folder):
    with pytest.raises(SchemaConflict, match="x is int"):
        merge_schemas(schema("id int, x int"), schema("id int, x string"))
    merged = merge_schemas(schema("a int, s struct<x:int>"), schema("s struct<x:bigint,y:string>, b date"))
    assert merged.simpleString() == "struct<a:int,s:struct<x:bigint,y:string>,b:date>"
    assert merge_schemas(schema("id int, x int"), schema("id bigint, x string"), keep=True) == schema("id bigint, x int")
    spark.sql("select 1 as x").write.parquet(f"{folder}/typed/a")
    spark.sql("select 'x' as x").write.parquet(f"{folder}/typed/b")
    store = SchemaStore(spark, f"{folder}/schemas")
    resolve_schema(spark, FileSource(f"{folder}/typed/a", "parquet"), store)
    with pytest.raises(SchemaConflict, match="x is int"):
        resolve_schema(spark, FileSource(f"{folder}/typed/b", "parquet"), store)
    put(folder, "files/a.json", '{"s": {"x": 1}}\n')
    assert resolve(spark, FileSource(f"{folder}/files", "json"), None).all_known
    store.save(schema("s struct<x:string>, x int"))
    assert not resolve(spark, FileSource(f"{folder}/files", "json"), store).all_known


def test_csv_columns_are_matched_by_the_header_of_each_file(spark, folder):
    put(folder, "files/a.csv", "a,b\n1,2\n")
    put(folder, "files/b.csv", "b,a\n20,10\n")
    put(folder, "files/c.csv", "a\n100\n")
    put(folder, "files/d.csv", '"A",,b,b\n5,x,y,z\n')
    put(folder, "files/empty.csv", "")
    source = FileSource(f"{folder}/files", "csv", schema=schema("a int, b int"))
    wanted = [(1, 2), (5, None), (10, 20), (100, None)]
    assert rows(read_files(spark, source, source.schema), "a", "b") == sorted(wanted, key=str)
    assert rows(bronze(spark, folder, source)) == sorted(wanted, key=str)
    rest = read_files(spark, source, source.schema).where("_unmatched is not null")
    assert rest.first()._unmatched == {"_c1": "x", "b2": "y", "b3": "z"}


def test_csv_files_may_gain_lose_and_move_columns_from_run_to_run(spark, folder):
    source = FileSource(f"{folder}/files", "csv")
    for name, text in {"a": "a,b\n1,x\n", "b": "a,b,c\n2,y,2.5\n", "c": "a\n3\n", "d": "c,a\n4.5,4\n"}.items():
        put(folder, f"files/{name}.csv", text)
        bronze(spark, folder, source)
    got = read_bronze(spark, source, f"{folder}/bronze")
    assert rows(got, "a", "b", "c") == [(1, "x", None), (2, "y", 2.5), (3, None, None), (4, None, 4.5)]
    both = FileSource(source.path, "csv", max_files=100)
    ingest(spark, both, f"{folder}/at-once", f"{folder}/at-once-checkpoint")
    assert rows(read_bronze(spark, both, f"{folder}/at-once"), "a", "b", "c") == rows(got, "a", "b", "c")
    assert rows(got.where("_unmatched is not null")) == []


def test_compressed_csv_and_other_separators(spark, folder):
    df = spark.createDataFrame([(1, "x;y"), (2, None)], "id int, v string")
    df.coalesce(1).write.option("header", "true").option("sep", ";").option("compression", "gzip").csv(f"{folder}/files")
    source = FileSource(f"{folder}/files", "csv", options={"sep": ";"})
    assert rows(bronze(spark, folder, source)) == rows(df)


def test_json_that_does_not_fit_is_kept_beside_what_does(spark, folder):
    source = FileSource(f"{folder}/files", "json")
    put(folder, "files/a.json", '{"a": 1, "s": {"x": 1}, "l": [1]}\n')
    bronze(spark, folder, source)
    lines = ['{"a": "x", "s": {"x": 1, "y": 2}, "l": [1, "z"], "new": true}', "not json", '{"a": 1.5, "s": 3}', '{"a": 3000000000}', "[1]"]
    put(folder, "files/b.json", "\n".join(lines) + "\n\n")
    bronze(spark, folder, source)
    got = read_bronze(spark, source, f"{folder}/bronze")
    assert dict(got.dtypes)["a"] == "bigint" and dict(got.dtypes)["s"] == "struct<x:bigint>"
    wanted = [
        (1, (1,), None, None), (None, (1,), True, {"a": '"x"', "l": '[1,"z"]', "s": '{"x":1,"y":2}'}), (None, None, None, {"_corrupt_record": "not json"}),
        (None, None, None, {"a": "1.5", "s": "3"}), (3000000000, None, None, None), (None, None, None, {"_corrupt_record": "1"}),
    ]
    plain = [(r.a, r.s and tuple(r.s), r.new, r._unmatched) for r in got.collect()]
    assert sorted(plain, key=str) == sorted(wanted, key=str)


def test_fields_unknown_to_a_given_schema_are_kept(spark, folder):
    put(folder, "files/a.json", '{"id": 1, "s": {"x": 1, "y": 2}, "more": [1]}\n{"id": 2, "s": {"x": 1}}\n{"id": 3, "more": null}\n')
    put(folder, "files/b.json", '{"id": 4, "l": [{"x": 1, "z": 0}]}\n')
    wanted = schema("id int, s struct<x:int>, l array<struct<x:int>>")
    source = FileSource(f"{folder}/files", "json", schema=wanted)
    got = {r.id: r for r in read_files(spark, source, wanted).collect()}
    assert got[1]._unmatched == {"s": '{"x":1,"y":2}', "more": "[1]"} and got[1].s.x == 1
    assert got[2]._unmatched is None and got[3]._unmatched == {"more": "null"}
    assert got[4]._unmatched == {"l": '[{"x":1,"z":0}]'} and got[4].l[0].x == 1
    documents = FileSource(source.path, "json", schema=wanted, multi_line=True, max_files=1)
    put(folder, "files/a.json", '[{"id": 1,\n "more": 2},\n {"id": 2}]')
    assert rows(read_files(spark, documents, wanted, [f"{folder}/files/a.json"]), "id", "_unmatched") == [(1, {"more": "2"}), (2, None)]
    off = FileSource(source.path, "json", schema=wanted, keep_unmatched=False)
    assert read_files(spark, off, wanted).columns == wanted.names


def test_csv_values_that_do_not_fit_are_kept(spark, folder):
    put(folder, "files/a.csv", "id,day,n\n1,2024-01-15,5\nx,soon,6\n3,,\n4\n")
    wanted = schema("id int, day date, n int")
    source = FileSource(f"{folder}/files", "csv", schema=wanted, keep_corrupt=True)
    got = [(r.id, r.day, r.n, r._unmatched, r._corrupt_record) for r in read_files(spark, source, wanted).collect()]
    day = dt.date(2024, 1, 15)
    assert sorted(got, key=str) == sorted([
        (1, day, 5, None, None), (None, None, 6, {"id": "x", "day": "soon"}, "x,soon,6"), (3, None, None, None, None),
        (4, None, None, {"_corrupt_record": "4"}, "4"),
    ], key=str)


def test_columns_that_come_while_an_interval_query_runs(spark, folder):
    source = FileSource(f"{folder}/files", "json")
    put(folder, "files/0.json", '{"id": 0}\n')
    query = ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint", interval="1 second")
    try:
        query.processAllAvailable()
        put(folder, "files/1.json", '{"id": 1, "extra": "x"}\n')
        query.processAllAvailable()
        put(folder, "files/2.json", '{"id": 3000000000, "extra": "y", "third": 0.5}\n')
        query.processAllAvailable()
    finally:
        query.stop()
    put(folder, "files/3.json", '{"id": 3}\n')
    ingest(spark, source, f"{folder}/bronze", f"{folder}/checkpoint")
    got = read_bronze(spark, source, f"{folder}/bronze")
    assert rows(got, "id", "extra", "third") == [(0, None, None), (1, "x", None), (3, None, None), (3000000000, "y", 0.5)]
    assert got.where("_unmatched is not null").count() == 0


@pytest.mark.parametrize("broken", ["move", "commit", "delete_folder"])
def test_a_batch_that_fails_half_way_is_there_once_in_the_end(spark, folder, monkeypatch, broken):
    spark.range(30).repartition(3).write.json(f"{folder}/files")
    source = FileSource(f"{folder}/files", "json")
    plain, calls = getattr(CommitLog, broken), []

    def failing(log, *args):
        calls.append(args)
        if len(calls) == 2 - (broken == "commit"):
            raise OSError("lost")
        return plain(log, *args)

    with monkeypatch.context() as m, pytest.raises(Exception):
        m.setattr(CommitLog, broken, failing)
        bronze(spark, folder, source, schema_dir=f"{folder}/schemas")
    assert len(calls) > 0
    assert rows(bronze(spark, folder, source, schema_dir=f"{folder}/schemas")) == rows(spark.range(30))


def test_files_with_an_old_modification_time_are_taken(spark, folder):
    source = FileSource(f"{folder}/files", "json")
    for n, age in enumerate((0, 400 * 86400, 20 * 365 * 86400)):
        put(folder, f"files/{n}.json", f'{{"id": {n}, "c{n}": 1}}\n')
        where = Path(urlparse(folder).path) / f"files/{n}.json"
        os.utime(where, (where.stat().st_mtime - age,) * 2)
        bronze(spark, folder, source)
    got = read_bronze(spark, source, f"{folder}/bronze")
    assert rows(got, "id") == [(0,), (1,), (2,)] and {"c0", "c1", "c2"} < set(got.columns)


def test_folder_columns_and_odd_file_names(spark, folder):
    put(folder, "files/day=2024-01-15/a [1].json", '{"id": 1}\n')
    put(folder, "files/day=2024-01-16/b.json", '{"id": 2}\n')
    source = FileSource(f"{folder}/files", "json")
    got = bronze(spark, folder, source)
    assert rows(got, "id", "day") == [(1, dt.date(2024, 1, 15)), (2, dt.date(2024, 1, 16))]


def test_stored_schema_is_used_as_is_when_it_may_not_evolve(spark, folder):
    store = SchemaStore(spark, f"{folder}/schemas")
    store.save(schema("id string"))
    put(folder, "files/a.json", '{"id": 1, "more": 2}\n')
    assert resolve_schema(spark, FileSource(f"{folder}/files", "json"), store, evolve=False) == schema("id string")


def test_unknown_format_and_missing_avro_package_are_clear_errors(spark, folder):
    with pytest.raises(ValueError, match="format"):
        FileSource("x", "xml")
    put(folder, "files/a.avro", "")
    with pytest.raises(RuntimeError, match="spark-avro"):
        ingest(spark, FileSource(f"{folder}/files", "avro", schema=schema("id int")), f"{folder}/b", f"{folder}/c")


def test_control_table_reads_bare_and_quoted_json(spark, folder):
    put(folder, "t.tsv", 'name\tconfig\na\t{"k": 1, "l": ["x"]}\nb\t"{""k"": 2, ""l"": []}"\nc\t\n')
    got = read_control_table(spark, f"{folder}/t.tsv")
    parsed = got.select("name", F.from_json("config", "k int, l array<string>").alias("p")).select("name", "p.k", "p.l")
    assert rows(parsed, "name", "k") == [("a", 1), ("b", 2), ("c", None)]


def test_conversion_types_dates_and_nulls_bad_text(spark, folder):
    lines = '{"id": "a", "day": "2024-01-15", "at": "2024-01-15 10:30:00", "n": "5"}\n{"id": "b", "day": "soon", "at": "x"}\n'
    put(folder, "files/a.json", lines)
    typed = schema("id string, day date, at timestamp_ntz, n int")
    convert(spark, FileSource(f"{folder}/files", "json"), typed, f"{folder}/out")
    got = spark.read.parquet(f"{folder}/out")
    assert got.schema.simpleString() == typed.simpleString()
    assert rows(got) == [("a", dt.date(2024, 1, 15), dt.datetime(2024, 1, 15, 10, 30), 5), ("b", None, None, None)]


def test_a_commit_number_is_never_written_twice(spark, folder):
    log = CommitLog(spark, f"{folder}/_commits")
    log.commit(0, {"a": 1})
    with pytest.raises(FileExistsError):
        log.commit(0, {"a": 2})
    assert log.latest() == (0, {"a": 1})


def test_changed_files_are_listed_once_per_call(spark, folder, monkeypatch):
    from lamella.sources import changed_files

    for n in range(5):
        spark.range(n, n + 1).coalesce(1).write.mode("append").parquet(f"{folder}/files")
    listed = []
    monkeypatch.setattr(changed_files, "list_files", lambda *a, f=changed_files.list_files: listed.append(a) or f(*a))
    source = FileSource(f"{folder}/files", "parquet", schema=spark.range(1).schema, max_files=2, allow_overwrites=True)
    assert ingest_changed_files(spark, source, source.schema, f"{folder}/bronze") == 5
    assert len(listed) == 1 and len(changed_files.changed_runs(spark, f"{folder}/bronze")) == 3
    assert rows(read_changed_files(spark, f"{folder}/bronze"), "id") == [(n,) for n in range(5)]
