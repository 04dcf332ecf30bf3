"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, deleted with the driver.

    Only in local mode, as in tests, an unset folder is made.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not there and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(there or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    path = f"{there or sc.getCheckpointDir()}/factloom-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and written as a Parquet table in the shared folder; lost executors don't lose it."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
