"""Nulls, white space, overlapping columns and the shared folder."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lamella.functions.text import is_blank
from lamella.operators.groups import first_by_priority, group_min_by
from lamella.operators.history import HistorySpec
from lamella.session import runs_in_one_process

from .conftest import rows


def test_null_priority_and_null_derived_come_last(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", 3), (2, "z", None)], "g int, v string, p int")
    assert rows(first_by_priority(df, ["g"], "v", ["p"])) == [(1, "y"), (2, "z")]
    assert rows(group_min_by(df, ["g"], "v", F.col("p"))) == [(1, "y"), (2, None)]


def test_white_space_is_blank(spark):
    df = spark.createDataFrame([("\t\n",), (" ",), ("",), (None,), ("\u2003",), (" a",)], "s string")
    assert [r[0] for r in df.select(is_blank("s")).collect()] == [True] * 5 + [False]


def test_tracked_columns_are_not_dropped():
    for other in ({"drop": ["v"]}, {"untracked": ["v"]}):
        with pytest.raises(ValueError, match="tracked"):
            HistorySpec.of(["k", "s", "v"], ["k"], "s", tracked=["v"], **other)


def test_only_one_process_may_use_its_own_folder():
    assert [runs_in_one_process(m) for m in ("local", "local[8]", "local-cluster[3,2,1000]", "yarn")] == [True, True, False, False]
