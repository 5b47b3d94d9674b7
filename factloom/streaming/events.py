"""The event log as a stream: counters by key and the latest state of each key.

Both run over what is there (``availableNow``) and stop, or go on where their checkpoint
ends.  A batch that is run again after a failure overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.decisions import last_by
from ..storage import shared_folder

__all__ = ["latest_state", "read_stream", "running_counts", "shared_folder"]


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """``path`` is one file or a folder; as a glob, since a stream's plain path has to be a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    def save(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k).cast("long")).write.mode("overwrite").parquet(f"{folder}/out/k={k}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/out/*")


def running_counts(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """n by key: each batch writes the keys that it changed, and the last batch of a key holds."""
    return last_by(_run(stream.groupBy(*keys).agg(F.count("*").alias("n")), "update", folder), keys, "batch").drop("batch")


def latest_state(stream: DataFrame, key: str, order: str, columns: list[str], folder: str) -> DataFrame:
    """``columns`` of the row of the largest ``order`` of each key."""
    last = stream.groupBy(key).agg(F.max(F.struct(order, *columns)).alias("__last"))
    return last_by(_run(last, "update", folder), [key], "batch").select(key, "__last.*")
