"""Shared folder, lineage cuts and Arrow batch sizes for the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of text handed to Python at once, so that long texts stay within a worker's memory.
TEXT_ROWS = 1000
TEXT_BYTES = 16 << 20
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only in local mode, as in tests, an unset one is made: a temporary folder. On a cluster
    such a folder would not be shared, so there the setting is required.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if there:
        if current is None:
            sc.setCheckpointDir(there)
        return there
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back; this cuts the lineage. It has a folder for each value of the columns ``by``.

    The table goes with the driver, or sooner by ``dropped``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete the table of a ``written`` DataFrame of which nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, each query's shuffle files go when the query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS, size: int = TEXT_BYTES) -> None:
    """Hand at most ``rows`` rows, and about ``size`` bytes, at once to Python; the session keeps the setting, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
