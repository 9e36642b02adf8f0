"""Numbered commit files: atomic visibility for tables kept as plain folders.

Data is always written to folders no reader knows yet; a commit is one small JSON file
whose appearance makes them visible. It goes through the Hadoop file system interface,
so the same code serves ``file:``, ``hdfs:``, ``s3a:`` and ``abfss:`` paths. One writer
at a time is assumed; a second one fails on the existing number instead of overwriting.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


LANDED = "_landed"  # records of the batches of a bronze table


class CommitLog:
    def __init__(self, spark: SparkSession, folder: str):
        self._spark = spark
        self._folder = folder.rstrip("/")

    def _at(self, path: str):
        """The file system of a path, and the path; tables and checkpoints may lie on two."""
        where = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self._spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def children(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def sized_files(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of the data files directly below ``path``, or of the file that it is."""
        fs, where = self._at(path)
        found = [(s.getPath().getName(), s.getLen()) for s in fs.listStatus(where) if s.isFile()] if fs.exists(where) else []
        return sorted((name, size) for name, size in found if not name.startswith(("_", ".")))

    def read_text(self, path: str) -> str:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def first_line(self, path: str, encoding: str = "UTF-8") -> str | None:
        """The first line that is not blank, of a plain or compressed text file; None when there is none."""
        fs, where = self._at(path)
        jvm = self._spark._jvm
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self._spark._jsc.hadoopConfiguration()).getCodec(where)
        stream = fs.open(where)
        try:
            plain = codec.createInputStream(stream) if codec else stream
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(plain, encoding))
            line = lines.readLine()
            while line is not None and not line.strip("\ufeff \t"):
                line = lines.readLine()
            return None if line is None else line.removeprefix("\ufeff")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write to a hidden file, then rename: readers see all of it or nothing."""
        parent, name = path.rsplit("/", 1)
        fs, hidden = self._at(f"{parent}/.{name}.{uuid.uuid4().hex}")
        stream = fs.create(hidden, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if self.exists(path) or not fs.rename(hidden, self._at(path)[1]):
            raise FileExistsError(f"{path} was written by someone else")

    def replace_file(self, new: str, old: str) -> None:
        """Put the file ``new`` in the place of the file ``old``."""
        fs, where = self._at(old)
        fs.delete(where, False)
        if not fs.rename(self._at(new)[1], where):
            raise OSError(f"could not move {new} to {old}")

    def move(self, path: str, to: str) -> None:
        fs, where = self._at(path)
        if not fs.rename(where, self._at(to)[1]):
            raise OSError(f"could not move {path} to {to}")

    def delete_folder(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)

    def numbers(self) -> list[int]:
        names = self.children(self._folder)
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> tuple[int, dict[str, Any]] | None:
        numbers = self.numbers()
        if not numbers:
            return None
        return numbers[-1], self.get(numbers[-1])

    def get(self, number: int) -> dict[str, Any]:
        return json.loads(self.read_text(f"{self._folder}/{number:010d}.json"))

    def committed(self, number: int) -> bool:
        return self.exists(f"{self._folder}/{number:010d}.json")

    def commit(self, number: int, content: dict[str, Any]) -> None:
        self.write_text(f"{self._folder}/{number:010d}.json", json.dumps(content))
