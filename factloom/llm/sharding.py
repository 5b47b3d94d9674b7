"""Sharding by a uniform shuffle with exact shard sizes: a hypergeometric communication matrix.

1. Rows are saved with their place: the part (a piece of at most ``PART`` rows of an input
   partition) and the position in it.
2. A random permutation of all rows would send to each shard, from each part, numbers of rows
   that follow the multivariate hypergeometric law given the parts' and the shards' sizes.
   That matrix is drawn exactly, by groups of parts in the driver (at most ``GROUPS`` rows of
   it) and by parts within each group in tasks.
3. Each part permutes its rows and deals them out by its row of the matrix.
4. Rows are exchanged to cells, random slices of their shard of some ``CELL`` rows, and each
   cell permutes what it got; a row's slot is its place there after the cells before it.

So shards differ by one row at most, every order is equally likely, and no task holds more
than a part or a cell.  The first ``n mod shards`` of a random order of the shards take the rows
left over.

Defined results: rows are dealt out whatever they hold: nulls, empty or very long texts, rows that
repeat others and equal texts each get a place of their own and equal texts aren't kept
together; with fewer rows than shards some shards have none; an empty table gives no rows; columns
of the input that are called ``shard`` or ``slot`` are an error, others are kept.  The draw
hangs on the seed and on how the input is partitioned; lost tasks are rerun on what was saved
and give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SEED, Scratch, arrow_map

PART = 1 << 20
CELL = 1 << 18
GROUPS = 1 << 10
LAW = "rows"
_NUMPY_MOST = 10**9  # NumPy draws from urns of fewer balls than this


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` balls from an urn of ``good`` and ``bad`` ones are good, for urns of any size.

    Large urns: inversion of the law's cumulated terms within 40 deviations of the mean.
    """
    total = good + bad
    if drawn == 0 or good == 0:
        return 0
    if bad == 0 or drawn == total:
        return min(good, drawn)
    if max(good, bad) < _NUMPY_MOST and total < _NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, drawn))
    low, high = max(0, drawn - bad), min(good, drawn)
    mean = drawn * (good / total)
    spread = 40 * (mean * (bad / total) * ((total - drawn) / max(total - 1, 1))) ** 0.5 + 40
    first, last = max(low, int(mean - spread)), min(high, int(mean + spread) + 1)
    k = np.arange(first, last, dtype=np.float64)
    # logarithms of the ratios of one term to the one before
    ratio = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    terms = np.concatenate([[0.0], np.cumsum(ratio)])
    weights = np.cumsum(np.exp(terms - terms.max()))
    return first + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(rng: np.random.Generator, rows: list[int], columns: list[int]) -> np.ndarray:
    """Numbers with these sums of rows and of columns, as a uniform shuffle of all of them would give."""
    left = [int(c) for c in columns]
    out = np.zeros((len(rows), len(left)), dtype=np.int64)
    for i, need in enumerate(int(r) for r in rows):
        urn = sum(left)
        for j, here in enumerate(left):
            got = hypergeometric(rng, here, urn - here, need)
            out[i, j], left[j] = got, here - got
            urn, need = urn - here, need - got
    return out


def shard_sizes(n: int, shards: int, seed: int = SEED) -> list[int]:
    order = np.random.default_rng([seed, 1]).permutation(shards)
    sizes = np.full(shards, n // shards, dtype=np.int64)
    sizes[order[: n % shards]] += 1
    return sizes.tolist()


def matrix_of(parts: DataFrame, scratch: Scratch, shards: int, seed: int) -> DataFrame:
    """__part and __sent, its rows for each shard; ``parts`` has __part and __n."""
    group = F.pmod(F.xxhash64(F.lit(seed), "__part"), F.lit(GROUPS)).cast("int").alias("__group")
    grouped = parts.select("__part", "__n", group)
    sums = sorted(tuple(r) for r in grouped.groupBy("__group").agg(F.sum("__n")).collect())  # at most GROUPS rows
    sizes = shard_sizes(sum(n for _, n in sums), shards, seed)
    drawn = communication_matrix(np.random.default_rng([seed, 2]), [n for _, n in sums], sizes)
    known = scratch.spark.createDataFrame([(g, row) for (g, _), row in zip(sums, drawn.tolist(), strict=True)], "__group int, __columns array<long>")

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__part")
        rng = np.random.default_rng([seed, 3, int(frame["__group"].iloc[0])])
        sent = communication_matrix(rng, frame["__n"].tolist(), list(frame["__columns"].iloc[0]))
        return pd.DataFrame({"__part": frame["__part"].to_numpy(), "__sent": list(sent)})

    return grouped.join(F.broadcast(known), "__group").groupBy("__group").applyInPandas(deal, "__part long, __sent array<long>")


def _dealer(seed: int):
    """Adds __shard and __key (a random number) to rows that have __part, __at and __sent."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=16)
        def places(part: int, sent: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
            rng = np.random.default_rng([seed, 4, part])
            shard = rng.permutation(np.repeat(np.arange(len(sent), dtype=np.int32), sent))
            return shard, rng.integers(0, 1 << 62, len(shard))

        for batch in batches:
            if not batch.num_rows:
                continue
            part, at = batch.column("__part").to_numpy(), batch.column("__at").to_numpy()
            shard, key = np.empty(len(at), np.int32), np.empty(len(at), np.int64)
            sent = batch.column("__sent")
            for p in np.unique(part):
                here = np.flatnonzero(part == p)
                to, random = places(int(p), tuple(sent[int(here[0])].as_py()))
                shard[here], key[here] = to[at[here]], random[at[here]]
            kept = [batch.column(c) for c in batch.schema.names if c != "__sent"]
            names = [c for c in batch.schema.names if c != "__sent"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(shard), pa.array(key)], names=[*names, "__shard", "__key"])

    return deal


def shuffled(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, shard (0 to ``shards`` - 1) and slot (0, 1, ... in each shard)."""
    taken = {"shard", "slot"} & set(docs.columns)
    if taken:
        raise ValueError(f"the input has a column {min(taken)} already")
    if shards < 1:
        raise ValueError("at least one shard is needed")
    scratch = Scratch(docs.sparkSession)
    place = F.monotonically_increasing_id()
    piece = F.shiftright("__place", PART.bit_length() - 1)
    placed = docs.withColumn("__place", place).withColumn("__part", piece).withColumn("__at", F.col("__place").bitwiseAND(F.lit(PART - 1))).drop("__place")
    rows = scratch.save(placed)
    plan = scratch.save(matrix_of(rows.groupBy("__part").agg(F.count("*").alias("__n")), scratch, shards, seed))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = arrow_map(rows.join(plan, "__part").select(*rows.columns, "__sent"), _dealer(seed), f"{fields}, __shard int, __key long")
    cells = max(1, -(-rows.count() // (shards * CELL)))
    dealt = scratch.save(dealt.withColumn("__cell", F.pmod("__key", F.lit(cells))))
    scratch.drop(rows)
    sizes = dealt.groupBy("__shard", "__cell").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__shard").orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = scratch.save(sizes.select(F.col("__shard").alias("__s"), F.col("__cell").alias("__c"), before.alias("__before")))
    rank = F.row_number().over(W.partitionBy("__shard", "__cell").orderBy("__key", "__part", "__at")) - 1
    ranked = dealt.withColumn("__rank", rank)
    out = ranked.join(offsets, (F.col("__shard") == F.col("__s")) & (F.col("__cell") == F.col("__c")))
    return out.select(*docs.columns, F.col("__shard").alias("shard"), (F.col("__before") + F.col("__rank")).alias("slot"))


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = SEED, rows_a_file: int = 1 << 20) -> None:
    """The shards as Parquet folders ``shard=0`` ... under ``path``, each file a run of at most ``rows_a_file`` slots in order."""
    placed = shuffled(docs, shards, seed)
    run = F.floor(F.col("slot") / F.lit(rows_a_file))
    placed.withColumn("__run", run).repartition("shard", "__run").sortWithinPartitions("shard", "slot").drop("__run").write.option("maxRecordsPerFile", rows_a_file).partitionBy("shard").parquet(path)


def placed(docs: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where ``shuffled`` puts each document, without its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shuffled(narrow, shards, seed).select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
