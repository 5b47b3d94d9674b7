"""Shared plumbing: tables, scratch storage, bounded samples, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

SEED = 20240917


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a folder of this machine only in local mode."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context._jsc.sc().getCheckpointDir()
    if found is not None and not isinstance(found, str):  # a Scala Option
        found = found.get() if found.isDefined() else None
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found


class Scratch:
    """Intermediate tables as Parquet files in the shared folder.

    Writing and rereading cuts the lineage, so a lost executor costs only the tasks
    that it ran.  ``drop`` deletes a table once nothing reads it; what is left goes
    when the session ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        path, files = self._at(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame) -> DataFrame:
        name = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(name)
        out = self.spark.read.schema(df.schema).parquet(name)
        self.paths[id(out)] = name
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            name = self.paths.pop(id(df), None)
            if name:
                path, files = self._at(name)
                files.delete(path, True)
        if tables:
            self.spark._jvm.System.gc()  # Spark deletes shuffle files of plans that are gone


def no_clash(kept: Iterable[str], made: Iterable[str]) -> None:
    """An error if a column to be kept has the name of one that is made."""
    both = sorted(set(kept) & set(made))
    if both:
        raise ValueError(f"the input has a column {both[0]} already")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id has remainder null."""
    return F.crc32(F.col(column).cast("string")) % F.lit(modulus)


def id_fraction(*columns: str, seed: int = SEED) -> Column:
    """A reproducible number in [0, 1) from the columns' values."""
    return (F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows by a hash of ``key`` (all rows if there are no more than that)."""
    n = df.count()
    return df if n <= most else df.filter(id_fraction(key) < F.lit(most / n))


def labelled(docs: DataFrame, labels: DataFrame, column: str, training: Column, most: int) -> DataFrame:
    """doc_id, text and __label (0 or 1) of about ``most`` documents whose labels agree; one row for each doc_id.

    Of rows that repeat a doc_id that of the smallest text is taken.
    """
    known = labels.filter(training & F.col(column).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.min(column).cast("int").alias("__label"), F.max(column).alias("__most")).filter("__label = __most").drop("__most")
    sample = F.broadcast(bounded_sample(known, "doc_id", most))
    return docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__label").alias("__label"))


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge, component being its smallest reachable node.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the edges are
    stars round their smallest node.  Groups are only aggregated (min) and joined to one row
    each, so the edges of a hub pass through a task as a stream (several, where adaptive
    execution splits them) and are never held; only counts come to the driver.
    """
    pairs = scratch.save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: every larger neighbour of u moves to u's smallest neighbour
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = scratch.save(small)
        stars = now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count() == 0 and now.groupBy("u").count().filter("count > 1").limit(1).count() == 0
        scratch.drop(pairs)
        pairs = now
        if stars:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: A Bloom filter has at most this many words of 64 bits, each a row of some 40 bytes where it is broadcast.
MOST_WORDS = 1 << 21
_IDS_A_WORD = 4


def split_by_ids(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``column`` may be among ``ids``, rows whose ``column`` surely isn't), so that only the former need a shuffle.

    The ids' Bloom filter (two bits for each in one word of 64) is made by a groupBy and
    broadcast as at most ``MOST_WORDS`` rows; with more ids than it has room for, more rows
    count as possible and nothing else changes.  Rows whose column is null aren't among ids.
    """
    no_clash(rows.columns, ("__bloom_hash", "__bloom_bits", "__bloom_at", "__bloom_word", "__bloom_held"))
    words = 1 << max(4, min(MOST_WORDS, ids.count() // _IDS_A_WORD + 1).bit_length())
    place = lambda h: F.pmod(h, F.lit(words))
    bits = lambda h: F.expr("shiftleft(1L, cast(shiftright({0}, 40) & 63 as int)) | shiftleft(1L, cast(shiftright({0}, 48) & 63 as int))".format(h))
    table = ids.select(F.xxhash64(F.lit(SEED), F.col(id_column)).alias("__bloom_hash")).select(place(F.col("__bloom_hash")).alias("__bloom_word"), bits("__bloom_hash").alias("__bloom_bits"))
    table = F.broadcast(table.groupBy("__bloom_word").agg(F.bit_or("__bloom_bits").alias("__bloom_held")))
    hashed = rows.withColumn("__bloom_hash", F.xxhash64(F.lit(SEED), F.col(column)))
    marked = hashed.withColumn("__bloom_bits", bits("__bloom_hash")).withColumn("__bloom_at", place(F.col("__bloom_hash"))).join(table, F.col("__bloom_at") == F.col("__bloom_word"), "left")
    maybe = F.col(column).isNotNull() & F.coalesce(F.col("__bloom_held").bitwiseAND(F.col("__bloom_bits")) == F.col("__bloom_bits"), F.lit(False))
    return marked.filter(maybe).select(*rows.columns), marked.filter(~maybe).select(*rows.columns)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with this package on the workers' path."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def sliced(batch: pa.RecordBatch, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """A large batch in smaller ones, as the JVM holds each of them outside its heap."""
    for lo in range(0, batch.num_rows, rows):
        yield batch.slice(lo, rows)


def sorted_groups(batches, key: tuple[str, ...]):
    """Runs of rows with equal ``key`` from Arrow batches that are sorted by it, as tables."""
    carry: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        part = pa.concat_tables([carry, part]) if carry is not None else part
        cuts = np.zeros(part.num_rows - 1, dtype=bool)
        for name in key:
            values = part.column(name).to_numpy()
            cuts |= values[1:] != values[:-1]
        starts = [0, *(np.flatnonzero(cuts) + 1)]
        for lo, hi in zip(starts, starts[1:], strict=False):
            yield part.slice(lo, hi - lo)
        carry = part.slice(starts[-1])
    if carry is not None:
        yield carry
