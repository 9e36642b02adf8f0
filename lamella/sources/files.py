"""File sources: format options, schema inference, batch and stream readers."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.operators.history import INGESTED
from lamella.sources.commits import CommitLog
from lamella.sources.records import CORRUPT, UNMATCHED, UNMATCHED_TYPE, split_csv, split_json

# The format names of the configuration.
FORMATS = ("json", "parquet", "csv", "avro", "orc")
TEXT = ("csv", "json")
LISTED = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass(frozen=True)
class FileSource:
    """Files of one format below one path, of any Hadoop file system.

    ``infer`` off means every CSV column is a string. ``multi_line`` is for JSON documents
    that span lines; JSON Lines, the default, must not set it.

    CSV columns are matched by the names in the header of each file, so files may differ in
    the order and number of their columns. Without ``header`` they are matched by position.

    What CSV and JSON texts hold beyond the schema, or what does not fit it, is kept in the
    map column ``_unmatched`` unless ``keep_unmatched`` is off. ``keep_corrupt`` adds the
    column ``_corrupt_record`` with the whole text of such rows.
    """

    path: str
    format: str
    schema: T.StructType | None = None
    header: bool = True
    infer: bool = True
    multi_line: bool = False
    max_files: int = 100
    allow_overwrites: bool = False
    keep_unmatched: bool = True
    keep_corrupt: bool = False
    options: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.format not in FORMATS:
            raise ValueError(f"format must be one of {FORMATS}, not {self.format!r}")
        if self.max_files < 1:
            raise ValueError("max_files must be at least 1")

    def reader_options(self) -> dict[str, str]:
        chosen: dict[str, str] = {}
        if self.format == "csv":
            chosen = {"header": str(self.header).lower(), "escape": '"'}
        if self.format in TEXT:
            chosen["multiLine"] = str(self.multi_line).lower()
        return {**chosen, **self.options}

    def read_schema(self, schema: T.StructType) -> T.StructType:
        """The schema with the columns that this source adds to it."""
        added = [T.StructField(UNMATCHED, UNMATCHED_TYPE)] if self.keep_unmatched else []
        added += [T.StructField(CORRUPT, T.StringType())] if self.keep_corrupt else []
        return T.StructType([*schema.fields, *(f for f in added if self.format in TEXT and f.name not in schema.names)])


def _reader(spark: SparkSession, source: FileSource, paths: list[str] | None, format: str | None = None):
    """Reader and what it loads: the whole source, or some of its files with the columns of their folders."""
    reader = spark.read.format(format or source.format).options(**source.reader_options())
    if paths is None:
        return reader, source.path
    if not re.search(r"[\\{}\[\]*?]", source.path) and source.options.get("recursiveFileLookup", "").lower() != "true":
        reader = reader.option("basePath", source.path)
    return reader, [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in paths]


def infer_schema(
    spark: SparkSession, source: FileSource, paths: list[str] | None = None, *, sampling: float = 1.0
) -> T.StructType | None:
    """Schema of the files, or of those in ``paths``; None when there is no file to look at.

    Parquet, ORC and Avro read footers. CSV and JSON read the text once more, or a share
    ``sampling`` of it; give ``FileSource.schema`` where that pass is too dear. CSV files
    need the same columns here; ``found_schema`` looks at each header.
    """
    reader, where = _reader(spark, source, paths)
    if source.format == "csv":
        reader = reader.option("inferSchema", str(source.infer).lower())
    if source.format in TEXT:
        reader = reader.option("samplingRatio", sampling).option("columnNameOfCorruptRecord", CORRUPT)
    elif source.format == "parquet":
        reader = reader.option("mergeSchema", "true")
    try:
        found = reader.load(where).schema
    except AnalysisException as failure:
        if failure.getCondition() in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
            return None
        raise
    return T.StructType([f for f in found.fields if f.name != CORRUPT]) if found.fields else None


def by_header(spark: SparkSession, source: FileSource, paths: list[str]) -> dict[tuple[str, ...], list[str]]:
    """CSV files by the column names in their first line, which alone is read. Empty files are left out.

    A name that is missing or stands there twice, in any case, gets its position.
    """
    log, found = CommitLog(spark, source.path), {}
    options = {k.lower(): v for k, v in source.options.items()}
    dialect = {"delimiter": options.get("sep", options.get("delimiter", ",")), "quotechar": options.get("quote") or '"'}
    for path in paths:
        line = log.first_line(path, options.get("encoding", options.get("charset", "UTF-8")))
        if line is None:
            continue
        names = next(csv.reader([line], **dialect))
        lower = [n.lower() for n in names]
        names = [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]
        found.setdefault(tuple(names), []).append(path)
    return found


def read_files(
    spark: SparkSession, source: FileSource, schema: T.StructType, paths: list[str] | None = None, all_known: bool = False
) -> DataFrame:
    """The rows of the files with ``schema`` and the columns that the source adds.

    ``paths`` are files of the source; without them all of it is listed. ``all_known`` says
    that the schema was inferred from these files, so that JSON has no unknown fields.
    """
    if source.format not in TEXT:
        reader, where = _reader(spark, source, paths)
        return reader.schema(source.read_schema(schema)).load(where)
    rows = _read_json(spark, source, schema, paths, all_known) if source.format == "json" else _read_csv(spark, source, schema, paths)
    return rows.select(*(F.col(f"`{n}`") for n in source.read_schema(schema).names))


def _read_json(spark: SparkSession, source: FileSource, schema: T.StructType, paths: list[str] | None, all_known: bool) -> DataFrame:
    reader, where = _reader(spark, source, paths, "text")
    texts = reader.option("wholetext", str(source.multi_line).lower()).load(where)
    return split_json(texts, schema, source.reader_options(), source.keep_corrupt, all_known or not source.keep_unmatched)


def _read_csv(spark: SparkSession, source: FileSource, schema: T.StructType, paths: list[str] | None) -> DataFrame:
    """Each group of files with one header is read by that header, as text, and fitted to the schema."""
    if paths is None:
        paths = list_paths(spark, source)
    if source.header:
        groups = by_header(spark, source, paths)
    else:
        groups = {tuple(n for n in schema.names): paths} if paths else {}
    known, parts = {n.lower(): n for n in schema.names}, []
    for header, files in groups.items():
        fields = [known.get(n.lower(), n) for n in header]
        raw = T.StructType([T.StructField(n, T.StringType()) for n in [*fields, CORRUPT]])
        reader, where = _reader(spark, source, files)
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true")
        parts.append(split_csv(reader.schema(raw).load(where), schema, source.options, fields, source.keep_corrupt))
    if not parts:
        return spark.createDataFrame([], FileSource(source.path, "csv", keep_corrupt=source.keep_corrupt).read_schema(schema))
    return reduce(DataFrame.unionByName, parts)


def stream_paths(spark: SparkSession, source: FileSource) -> DataFrame:
    """Stream of the paths of new files, at most ``max_files`` per micro-batch; contents are not read.

    A file is known by its path: once taken, rewriting it adds nothing. Files older than the
    option ``maxFileAge`` before the newest are neither looked at nor remembered, which bounds
    what the driver remembers; by default none is that old.
    """
    files = spark.readStream.format("binaryFile").schema(LISTED).options(**{"maxFileAge": "36500d", **source.options})
    files = files.option("maxFilesPerTrigger", source.max_files)
    return files.load(source.path).select("path")


def list_files(spark: SparkSession, path: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Path, modification time and length of the files, those in folders below too; contents are not read."""
    return spark.read.format("binaryFile").options(**(options or {"recursiveFileLookup": "true"})).load(path).select("path", "modificationTime", "length")


def list_paths(spark: SparkSession, source: FileSource) -> list[str]:
    return [r.path for r in list_files(spark, source.path, source.options).select("path").orderBy("path").toLocalIterator()]


def has_files(spark: SparkSession, source: FileSource) -> bool:
    try:
        return not list_files(spark, source.path, source.options).isEmpty()
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def require_avro(spark: SparkSession) -> None:
    try:
        spark.read.format("avro").schema("a int").load([])
    except AnalysisException as failure:
        raise RuntimeError("reading Avro needs the spark-avro package on the class path") from failure


def with_audit(df: DataFrame) -> DataFrame:
    """Add the ingestion time, the same for all rows of a micro-batch."""
    return df.withColumn(INGESTED, F.current_timestamp())


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit the schema, rows that do not); for sources with ``keep_corrupt``."""
    corrupt = F.col(CORRUPT).isNotNull()
    return df.where(~corrupt).drop(CORRUPT), df.where(corrupt)


def read_control_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Tab-separated table with JSON cells, bare or quoted; all columns are strings."""
    reader = spark.read.option("sep", "\t").option("header", "true").option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)
