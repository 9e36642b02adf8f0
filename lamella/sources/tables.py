"""Tables kept as folders of Parquet: full refresh, batch read, stream read."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterable
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.commits import CommitLog
from lamella.sources.schemas import merge_schemas


@dataclass(frozen=True)
class TableRef:
    """A ``catalog.schema.table`` name and the folder it stands for."""

    catalog: str
    schema: str
    table: str

    @staticmethod
    def parse(name: str) -> TableRef:
        parts = name.split(".")
        if len(parts) != 3 or not all(parts):
            raise ValueError(f"expected catalog.schema.table, got {name!r}")
        return TableRef(*parts)

    def path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.schema}/{self.table}"


def observed_rows(counted: Observation) -> int:
    """The count observed as ``rows``. Spark drops the observation from a plan it finds empty."""
    try:
        return int(counted.get["rows"])
    except (Py4JJavaError, PySparkException):
        return 0


class _Parts:
    """The live folders of a table; each write adds one, each commit names the live ones.

    Of a folder of which some files were rewritten the others are named one by one, as
    folder/file. A commit holds the schema too, so that columns of any part are read from
    all of them, and what a writer notes besides.
    """

    PATTERN = r"/(part-[0-9a-f]{32}/[^/]+)$"

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/_commits")
        last = self.log.latest() if version is None else (version, self.log.get(version))
        self.number = last[0] + 1 if last else 0
        self.live: list[str] = last[1]["parts"] if last else []
        self._stored = last[1].get("schema") if last else None
        self.notes: dict[str, str] = last[1].get("notes", {}) if last else {}

    def require_commits(self) -> None:
        """Changing a plain folder in part would hide the rest of it from readers."""
        if self.number == 0 and self.log.children(self.path):
            raise ValueError(f"{self.path} is a plain folder; bring it into a table with replace_table first")

    def folders(self) -> list[str]:
        return [f"{self.path}/{p}" for p in self.live]

    def schema(self) -> T.StructType:
        """The committed schema. Plain folders have none; the footers of all files give it."""
        if self._stored:
            return T.StructType.fromJson(json.loads(self._stored))
        return self.spark.read.option("mergeSchema", "true").parquet(*self.folders() or [self.path]).schema

    def files(self) -> list[tuple[str, int]]:
        """Live files as folder/file, with their sizes."""
        found = []
        for entry in self.live:
            at = f"{self.path}/{entry}"
            for name, size in self.log.sized_files(at):
                found.append((entry if "/" in entry else f"{entry}/{name}", size))
        return found

    def without(self, gone: set[str]) -> list[str]:
        """The live entries less these files; folders that lose none of theirs stay as they are."""
        touched, kept = {file.split("/")[0] for file in gone}, []
        for entry in self.live:
            if "/" not in entry and entry in touched:
                kept += [f"{entry}/{n}" for n, _ in self.log.sized_files(f"{self.path}/{entry}") if f"{entry}/{n}" not in gone]
            elif entry not in gone:
                kept.append(entry)
        return kept

    def read(self, entries: Iterable[str]) -> DataFrame:
        """Rows of some entries, with the table's schema."""
        paths = [f"{self.path}/{e}" for e in entries]
        reader = self.spark.read.schema(self.schema())
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema())

    def add(
        self,
        df: DataFrame,
        keep: list[str],
        schema: T.StructType,
        check: Callable[[DataFrame], None] | None = None,
        notes: dict[str, str] | None = None,
    ) -> int:
        """Write a part, have ``check`` look at what was written, and commit it."""
        part = f"part-{uuid.uuid4().hex}"
        counted = Observation()
        df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").parquet(f"{self.path}/{part}")
        rows = observed_rows(counted)
        if check:
            try:
                check(self.spark.read.schema(df.schema).parquet(f"{self.path}/{part}"))
            except Exception:
                self.log.delete_folder(f"{self.path}/{part}")
                raise
        content = {"parts": [*keep, part], "schema": schema.json(), "rows_written": rows}
        self.log.commit(self.number, {**content, "notes": notes} if notes else content)
        return rows


def replace_table(df: DataFrame, path: str) -> int:
    """Full refresh: write the new content next to the old, then switch readers to it.

    The result may be computed from the table being replaced. Returns the row count, which
    is observed during the write, so nothing is scanned a second time.
    """
    return _Parts(df.sparkSession, path).add(df, [], merge_schemas(T.StructType(), df.schema))


def append_table(
    df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None, notes: dict[str, str] | None = None
) -> int:
    """Add rows; what is there already is not touched. Returns the rows added.

    Columns that the table lacks widen it and are null in older rows. ``check`` is given
    the rows as they were written; when it raises, nothing is added. ``notes`` are kept
    with the commit; deletes and compaction hand them on, other writes do not.
    """
    parts = _Parts(df.sparkSession, path)
    parts.require_commits()
    before = parts.schema() if parts.live else T.StructType()
    return parts.add(df, parts.live, merge_schemas(before, df.schema), check, notes)


def table_notes(spark: SparkSession, path: str) -> dict[str, str]:
    """What the writer of the last commit noted."""
    return _Parts(spark, path).notes


def delete_rows(spark: SparkSession, path: str, matches: Column) -> int:
    """Delete matching rows; rows where the condition is null stay. Returns the rows deleted.

    Only the files that hold a match are rewritten, and none when there is no match.
    """
    parts = _Parts(spark, path)
    parts.require_commits()
    file = F.regexp_extract("_metadata.file_path", parts.PATTERN, 1).alias("file")
    hits = read_table(spark, path).where(matches).groupBy(file).agg(F.count(F.lit(1)).alias("rows")).collect()
    if not hits:
        return 0
    touched, schema = {h.file for h in hits}, parts.schema()
    rest = parts.read(sorted(touched)).where(~F.coalesce(matches, F.lit(False)))
    parts.add(rest, parts.without(touched), schema, notes=parts.notes)
    return sum(h.rows for h in hits)


def compact_table(spark: SparkSession, path: str, target_bytes: int) -> tuple[int, int]:
    """Merge the small files of a table, those below half the target; larger ones are not touched.

    Small files are packed in the scan, so nothing is shuffled. Returns files before and
    after. Nothing is written where no two small files would become one.
    """
    parts = _Parts(spark, path)
    parts.require_commits()
    files = parts.files()
    small = {name: size for name, size in files if size < target_bytes / 2}
    merged = math.ceil(sum(small.values()) / target_bytes)
    if len(small) <= max(1, merged):
        return len(files), len(files)
    with packed_scans(spark, target_bytes):
        parts.add(parts.read(sorted(small)), parts.without(set(small)), parts.schema(), notes=parts.notes)
    return len(files), len(_Parts(spark, path).files())


@contextmanager
def packed_scans(spark: SparkSession, target_bytes: int):
    """Let one task read as many small files as come to ``target_bytes``."""
    values = {"maxPartitionBytes": str(target_bytes), "openCostInBytes": "0", "minPartitionNum": "1"}
    names = {f"spark.sql.files.{k}": v for k, v in values.items()}
    saved = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def changed_rows(spark: SparkSession, path: str, since: int, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that only the older version's files hold, those of the later one); files in both are not read."""
    old, new = _Parts(spark, path, since), _Parts(spark, path, until)
    whole = ({e for e in old.live if "/" not in e}, {e for e in new.live if "/" not in e})
    split = {e.split("/")[0] for e in [*old.live, *new.live] if "/" in e}
    sides = []
    for parts, own in ((old, whole[0]), (new, whole[1])):
        by_file = [f"{e}/{n}" for e in own & split for n, _ in parts.log.sized_files(f"{parts.path}/{e}")]
        sides.append({*(own - split), *by_file, *(e for e in parts.live if "/" in e)})
    return old.read(sorted(sides[0] - sides[1])), new.read(sorted(sides[1] - sides[0]))


def table_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the current content; the path itself for a plain folder."""
    return _Parts(spark, path).folders() or [path]


def table_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits of a table, oldest first; ``read_table`` reads any of them."""
    return _Parts(spark, path).log.numbers()


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, version: int | None = None
) -> DataFrame:
    """Batch read of the current content, or of an older version whose parts still exist.

    ``schema`` may be wider than the older files; they read as null there. Without one it
    is that of the commit, or for a plain folder that of all its files together.
    """
    parts = _Parts(spark, path, version)
    return spark.read.schema(schema or parts.schema()).parquet(*parts.folders() or [path])


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table with all its versions."""
    CommitLog(spark, path).delete_folder(path)


def expire_parts(spark: SparkSession, path: str, keep_commits: int = 2) -> int:
    """Delete parts that none of the last commits names; readers of older ones lose them."""
    table = _Parts(spark, path)
    used = {p.split("/")[0] for n in table.log.numbers()[-keep_commits:] for p in table.log.get(n)["parts"]}
    gone = [c for c in table.log.children(table.path) if c.startswith("part-") and c not in used]
    for name in gone if used else []:
        table.log.delete_folder(f"{table.path}/{name}")
    return len(gone) if used else 0


def stream_table(spark: SparkSession, path: str, schema: T.StructType | None = None, max_files: int = 100) -> DataFrame:
    """Stream read of an append-only table, such as one written by ``ingest``.

    Without ``schema`` the footers of all files are read for one; ``bronze_schema`` has it
    from the schema store instead.
    """
    schema = schema or spark.read.option("mergeSchema", "true").parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
