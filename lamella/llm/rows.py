"""Python over whole rows in Arrow batches, words of texts, and tables in the shared folder."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lamella.session import work_dir
from lamella.sources.commits import CommitLog

SLICE = 256
WORDS_KEPT = 400_000

_UPPER = bytes(range(65, 91))
_OUTSIDE = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_FOLD = bytes.maketrans(_OUTSIDE + _UPPER, b" " * len(_OUTSIDE) + _UPPER.lower())


def spaced_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased, as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "replace").lower().split()


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_FOLD).split()


class WordHashes(dict):
    """Word to 64-bit hash. Words already met are looked up; memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class LocalWords(dict):
    """Word to a small number, the same for this object's life, with the hash of each.

    The number 0 is the end token, written as one blank, which no word is.
    """

    END = b" "

    def __init__(self, end: int):
        super().__init__({self.END: 0})
        self._hashes = array("Q", [end])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self._hashes)
        self._hashes.append(xxhash.xxh3_64_intdigest(word))
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, since: int = 0) -> np.ndarray:
        return np.array(self._hashes[since:], np.uint64)  # a copy, as the array grows


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all their bits depend on each other."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def map_rows(df: DataFrame, start: Callable[[], Callable[..., Iterable[tuple]]], schema: str) -> DataFrame:
    """Rows that a Python function makes of each row.

    ``start`` runs once per task and returns the function, which takes the row's values
    and returns the rows to emit. Batches are small, so memory does not follow the input.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        body = start()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(at, SLICE).columns)):
                    out.extend(body(*row))
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), arrow.types)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def hold(df: DataFrame, purpose: str) -> DataFrame:
    """Write to a new table in the shared folder and read it from there.

    Cuts the lineage and survives the loss of executors.
    """
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._held_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables of ``hold`` that nothing reads any more: all that was made of them is written."""
    for table in tables:
        CommitLog(table.sparkSession, table._held_at).delete_folder(table._held_at)
