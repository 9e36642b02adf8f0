"""Runs registered queries next to their SQL in DuckDB: ``python tests/check.py [names]``."""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TESTDATA = "/root/testdata"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, Decimal):
        return str(value.normalize())
    return repr(value)


def rows_by_name(table) -> tuple[list[str], list[tuple]]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(map(_cell, row)) for row in zip(*columns))


def compare(spark, con, body, sql: str | None, sf_dir: str) -> str:
    """Empty when the rows agree, else what differs."""
    mine = body(spark, sf_dir).toArrow()
    if sql is None:
        return "" if mine.num_rows else "no rows"
    theirs = con.sql(sql).to_arrow_table()
    (names, rows), (want_names, want_rows) = rows_by_name(mine), rows_by_name(theirs)
    if names != want_names:
        return f"columns {names} != {want_names}"
    for name in names:
        a, b = mine.schema.field(name).type, theirs.schema.field(name).type
        if str(a).replace("large_", "") != str(b).replace("large_", ""):
            return f"type of {name}: {a} != {b}"
    if len(rows) != len(want_rows):
        return f"{len(rows)} rows != {len(want_rows)}"
    different = [(a, b) for a, b in zip(rows, want_rows) if a != b]
    return f"{len(different)} rows differ, first {different[0]}" if different else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from lamella.session import local_session

    spark = local_session()
    sf_dir = f"{TESTDATA}/sf{os.environ.get('CHECK_SF', '0.01')}"
    con = connect(sf_dir)
    wanted, failed = sys.argv[1:], 0
    for name, body in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, body, entry.oracle_sql().get(name), sf_dir)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{time.time() - start:6.2f}s {name} {problem}", flush=True)
    sys.exit(1 if failed else 0)
