"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; in local mode alone one of this machine where that is unset.  It goes when the session ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="factloom-stream-")
    name = f"{folder}/run-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return name


def saved(rows: DataFrame) -> DataFrame:
    """``rows`` written once and read from there, so that several uses don't compute them again."""
    name = f"{shared_folder(rows.sparkSession)}/rows"
    rows.write.parquet(name)
    return rows.sparkSession.read.schema(rows.schema).parquet(name)
