"""Writing files in the source formats, and converting between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.sources.files import FileSource, read_files

# Fixed value: keeps all six digits, where the default of the text writers keeps three.
MICROSECONDS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def write_files(df: DataFrame, path: str, format: str, *, header: bool = True, mode: str = "append") -> None:
    """Write files that ``FileSource`` of the same format reads back unchanged."""
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.options(header=str(header).lower(), escape='"', timestampNTZFormat=MICROSECONDS)
    elif format == "json":
        writer = writer.option("timestampNTZFormat", MICROSECONDS)
    writer.save(path)


def write_control_table(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header and quoted cells, for ``read_control_table``."""
    df.write.options(sep="\t", header="true", escape='"').csv(path)


def _documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({"value": ["[\n" + ",\n".join(batch["row"]) + "\n]"]})


def write_json_documents(df: DataFrame, path: str) -> None:
    """JSON documents, each an array over several lines in a file of its own.

    A document holds one Arrow batch, so it is bounded by
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows, and nothing is shuffled.
    """
    rows = df.select(F.to_json(F.struct(*df.columns), {"timestampNTZFormat": MICROSECONDS}).alias("row"))
    documents = rows.mapInPandas(_documents, "value string")
    documents.write.option("maxRecordsPerFile", 1).text(path)


def convert(spark: SparkSession, source: FileSource, schema: T.StructType, target: str) -> None:
    """Read CSV or JSON as text and write Parquet with the types of ``schema``.

    Dates and timestamps are parsed leniently: text that is neither becomes null.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])

    def typed(f: T.StructField):
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.try_to_timestamp(F.col(f.name)).cast("timestamp_ntz")
        return F.col(f.name).try_cast(f.dataType)

    read_files(spark, source, text).select(*[typed(f).alias(f.name) for f in schema.fields]).write.parquet(target)
