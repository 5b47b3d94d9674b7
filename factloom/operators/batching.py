"""Batches under a token budget where a key may hold any number of rows.

A batch takes rows in order until the next would pass the budget.  Rows are dealt out by
ranges of key and order, so a large key spreads over pieces.  What a piece does depends on one number,
the tokens of the batch that is open when it begins: they decide at which of the first rows a new
batch begins, and from there on all is known.  So each piece gives, for each such row, what
comes of it, for its first and last key alone, as all others are whole in it; one task a key goes
from piece to piece (a row each, not the pieces' rows); then the pieces number their rows side by side.

Defined results: rows of a null key are one key; tokens that are null count 0; a row above the budget is a batch of its own; of rows
that tie in order any may be first; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from ..storage import saved


def piece_outcomes(tokens: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int]]:
    """(running sums, batches begun, tokens open at the end) for each row at which the piece's first new batch can begin.

    The first row that makes a sum of more than what the open batch has left begins one; that is among the rows
    before which no more than ``budget`` tokens stand.
    """
    sums = np.cumsum(tokens)
    before = sums - tokens
    following = np.maximum(np.searchsorted(sums, before + budget, side="right"), np.arange(1, len(tokens) + 1)).tolist()
    n, start = len(tokens), before.tolist()
    begun, left = [0] * (n + 1), [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        j = following[i]
        begun[i], left[i] = (1, int(sums[-1]) - start[i]) if j >= n else (begun[j] + 1, left[j])
    most = int(np.searchsorted(before, budget, side="right"))
    return sums[:most].tolist(), begun[:most], left[:most]


def chained(pieces: list[tuple[list[int], list[int], list[int], int]], budget: int) -> list[tuple[int, int]]:
    """(tokens open, number of the open batch) as each piece begins; -1 tokens before the first row of a key.  A piece ends with its total."""
    out, used, number = [], -1, -1
    for sums, begun, left, total in pieces:
        out.append((used, number))
        at = 0 if used < 0 else int(np.searchsorted(sums, budget - used, side="right"))
        if at < len(sums):
            used, number = left[at], number + begun[at]
        else:
            used += total
    return out


def numbered(tokens: np.ndarray, used: int, number: int, budget: int) -> np.ndarray:
    """The batch of each row of a piece that begins with ``used`` tokens in batch ``number``."""
    sums = np.cumsum(tokens)
    at, out = 0 if used < 0 else int(np.searchsorted(sums, budget - used, side="right")), np.empty(len(tokens), np.int64)
    out[:at] = number
    while at < len(tokens):
        number += 1
        end = max(int(np.searchsorted(sums, sums[at] - tokens[at] + budget, side="right")), at + 1)
        out[at:end], at = number, end
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))


def batch_tokens(rows: DataFrame, per: str, order: list[str], budget: int, pieces: int | None = None) -> DataFrame:
    """``rows`` (with tokens) with batch, from 0 in each ``per``."""
    ship(rows.sparkSession)
    given = saved(rows)  # what rows come from is computed once: to deal out ranges takes two passes
    ordered = given.repartitionByRange(pieces, per, *order) if pieces else given.repartitionByRange(per, *order)
    ordered = ordered.sortWithinPartitions(per, *order).withColumns({"__piece": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = saved(ordered)  # the ranges are sampled: saved, they are the same for all that follows
    narrow = placed.select("__piece", F.col(per).alias("__key"), "__at", F.coalesce("tokens", F.lit(0)).cast("long").alias("__n"))
    key = narrow.schema["__key"].dataType
    long, longs = T.LongType(), T.ArrayType(T.LongType())
    ends = T.StructType([narrow.schema["__piece"], T.StructField("__key", key), *[T.StructField(c, longs) for c in ("sums", "begun", "left")], T.StructField("total", long)])
    kinds = to_arrow_schema(ends)

    def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a piece's first and last key, which alone can be in other pieces too."""

        def outcome(run: tuple) -> pa.RecordBatch:
            piece, name, tokens = run
            sums, begun, left = piece_outcomes(np.array(tokens, np.int64), budget)
            return pa.RecordBatch.from_pylist([{"__piece": piece, "__key": name, "sums": sums, "begun": begun, "left": left, "total": sum(tokens)}], kinds)

        for _, piece in groupby(_rows(batches), key=itemgetter(0)):
            first = last = None
            for _, run in groupby(piece, key=lambda row: repr(row[1])):
                kept = list(run)
                last = (kept[0][0], kept[0][1], [row[3] for row in kept])
                if first is None:
                    first = last
                    yield outcome(first)
            if last is not first:
                yield outcome(last)

    found = narrow.repartition("__piece").sortWithinPartitions("__piece", "__at").mapInArrow(outcomes, ends)

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__piece")
        began = chained(list(zip(frame["sums"], frame["begun"], frame["left"], frame["total"], strict=True)), budget)
        return pd.DataFrame({"__p": frame["__piece"].to_numpy(), "__k": frame["__key"].to_numpy(), "__used": [u for u, _ in began], "__number": [b for _, b in began]})

    began = found.groupBy("__key").applyInPandas(chain, T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__k", key), T.StructField("__used", long), T.StructField("__number", long)]))
    same = (F.col("__piece") == F.col("__p")) & F.col(per).eqNullSafe(F.col("__k"))
    started = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("__used", "__number")]
    known = placed.join(F.broadcast(began), same, "left").select(*rows.columns, "__piece", "__at", F.col(per).alias("__key"), F.coalesce("tokens", F.lit(0)).cast("long").alias("__n"), *started)
    width = len(rows.columns)

    def number_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, number = None, -1, -1
        for b in batches:
            out: list[np.ndarray] = []
            marks = zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("__piece", "__key", "__n", "__used", "__number")), strict=True)
            for name, run in groupby(marks, key=lambda row: (row[0], repr(row[1]))):
                kept = list(run)
                if name != at:
                    at, used, number = name, kept[0][3], kept[0][4]
                tokens = np.array([row[2] for row in kept], np.int64)
                found = numbered(tokens, used, number, budget)
                used, number = int(tokens[found == found[-1]].sum()) + (used if found[-1] == number else 0), int(found[-1])
                out.append(found)
            columns = [*b.columns[:width], pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:width], "batch"])

    schema = T.StructType([*rows.schema.fields, T.StructField("batch", long)])
    return known.repartition("__piece").sortWithinPartitions("__piece", "__at").mapInArrow(number_rows, schema)
