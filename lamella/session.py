"""Session settings and the shared working folder."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import SparkSession

MIB = 1 << 20


def session_options(input_bytes: int, cores: int, partition_bytes: int = 128 * MIB) -> dict[str, str]:
    """Settings for a job that shuffles about ``input_bytes``.

    One shuffle partition per ``partition_bytes``, never fewer than the cores, and AQE
    left on to merge the small ones and split the skewed ones.
    """
    partitions = max(cores, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.session.timeZone": "UTC",
    }


def local_session(cores: int = 8, app: str = "lamella") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in session_options(cores * 128 * MIB, cores).items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def runs_in_one_process(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for ``checkpoint()`` and working tables.

    The cluster names it in ``spark.checkpoint.dir``. A temporary folder is made only
    where that is unset and all runs in one process, as in tests; elsewhere executors could
    not see it, so an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named and context.getCheckpointDir() is None and not runs_in_one_process(context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lamella-"))
    return named or context.getCheckpointDir()


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new, empty folder name below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/lamella/{purpose}-{uuid.uuid4().hex}"
