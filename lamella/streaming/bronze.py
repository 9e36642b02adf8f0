"""Incremental ingestion of files into append-only bronze tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lamella.operators.history import INGESTED
from lamella.sources.changed_files import ingest_changed_files, read_changed_files
from lamella.sources.files import FileSource, has_files, read_files, require_avro, stream_paths, with_audit
from lamella.sources.schemas import Resolved, SchemaStore, resolve
from lamella.streaming.landing import land, read_landed, stream_name


def append_stream(df: DataFrame, target: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append a stream to a Parquet table.

    Without ``interval`` it takes all that is there in bounded micro-batches and stops;
    with one, such as ``"10 minutes"``, the running query is returned.
    """
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start(target)
    query = writer.trigger(availableNow=True).start(target)
    query.awaitTermination()
    return query


def ingest(
    spark: SparkSession,
    source: FileSource,
    target: str,
    checkpoint: str,
    *,
    schema_dir: str | None = None,
    evolve: bool = True,
    sampling: float = 1.0,
    interval: str | None = None,
) -> StreamingQuery | int | None:
    """Bring new files of ``source`` into ``target`` exactly once, with an audit column.

    The stream is one of file names, and the checkpoint remembers those taken; run again
    with the same one and only new files are read. Each micro-batch reads its files with
    the schema known so far, widened by what they have themselves, so columns that come
    while an interval query runs are there with the batch that brings them. The schema is
    kept below ``schema_dir``, by default a hidden folder of the target; ``source.schema``
    takes the place of inference. With ``evolve`` off the stored schema stays. With
    ``allow_overwrites`` rewritten files are read again, and the count of files is returned.
    None is returned where there is nothing to read and no schema.
    """
    store = SchemaStore(spark, schema_dir or default_schema_dir(target))

    def known(paths: list[str]) -> Resolved:
        return resolve(spark, source, store, paths, evolve=evolve, sampling=sampling)

    if source.allow_overwrites:
        if interval:
            raise ValueError("sources that allow overwrites are run on demand, not on an interval")
        if source.schema is None and store.latest() is None and not has_files(spark, source):
            return None
        return ingest_changed_files(spark, source, known, target)

    if source.format == "avro":
        require_avro(spark)
    if source.schema is None and store.latest() is None and not interval and not has_files(spark, source):
        return None
    stream = stream_name(spark, checkpoint)

    def take(files: DataFrame, number: int) -> None:
        paths = [r.path for r in files.collect()]  # at most max_files
        resolved = known(paths)
        rows = read_files(spark, source, resolved.schema or T.StructType(), paths, resolved.all_known)
        land(with_audit(rows), target, stream, number)

    writer = stream_paths(spark, source).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    if interval:
        return writer.trigger(processingTime=interval).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def default_schema_dir(target: str) -> str:
    return f"{target.rstrip('/')}/_schemas"


def bronze_schema(spark: SparkSession, source: FileSource, schema_dir: str) -> T.StructType | None:
    """All columns that files of the target may have; None before the first ingestion."""
    stored = SchemaStore(spark, schema_dir).latest()
    return stored and T.StructType([*source.read_schema(stored).fields, T.StructField(INGESTED, T.TimestampType())])


def read_bronze(spark: SparkSession, source: FileSource, target: str, schema_dir: str | None = None) -> DataFrame:
    """Batch read of what ``ingest`` wrote, in either layout, with all columns of the stored schema."""
    schema = bronze_schema(spark, source, schema_dir or default_schema_dir(target))
    if source.allow_overwrites:
        return read_changed_files(spark, target, schema)
    return read_landed(spark, target, schema)
