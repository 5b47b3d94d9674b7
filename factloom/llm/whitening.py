"""Embedding whitening: exactly centred rows, RowMatrix's Gramian, eigenvectors in the driver.

Each entry c becomes the integer x = floor(64 c) + 1,000,000.  Sums of x by dimension are
exact integers, so n x - S is exact too, and the centred row (n x - S) / n is rounded once:
the offset costs no digits.  ``RowMatrix.computeGramianMatrix`` over the centred rows, divided
by n, is their covariance (dimensions x dimensions, in the driver); its eigenvectors are
broadcast and rows are whitened in batches.  The whitened rows are saved, and their own
covariance is measured, not derived.

Rows spread over tasks as they are read, nothing is gathered by key; what comes to the driver
is one number for each dimension and two matrices of that many rows.

Defined results: a vector that is null, empty or holds null, NaN or infinite entries takes no
part, nor does one whose length isn't that of most vectors (of equally frequent lengths the
longest); rows that repeat an id or a vector count each; components whose variance is zero to
double precision have no unit variance to be brought to and are left out, so a table of no rows,
one row or equal rows gives no rows; ``deviation`` that exceeds a long is an error in the query, while the
operator has it as a decimal; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import Scratch, arrow_map

SCALE, OFFSET = 64, 1_000_000
MOST_COMPONENTS = 32


class Whitening(NamedTuple):
    n: int
    sums: np.ndarray  # of x by dimension, exact
    directions: np.ndarray  # a column for each component
    values: np.ndarray  # eigenvalues, falling
    trace: float


def integers(vectors: DataFrame, scratch: Scratch, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """(id and x, the vectors that take part as integers; their length)."""
    entries = F.col(column).cast("array<double>")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    usable = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(F.exists(entries, odd), F.lit(True)))
    x = F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    rows = scratch.save(usable.select(F.col(id_column).alias("id"), x.alias("x")))
    widths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = widths[0]["d"] if widths else 0
    return rows.filter(F.size("x") == width), width


def sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """The number of rows and exact sums by dimension: each task adds up its own rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, np.int64)
        for batch in (b for b in batches if b.num_rows):
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(-1, width, dtype=np.int32), "part": np.concatenate([[n], total])})

    found = arrow_map(rows.select("x"), add, "at int, part long").groupBy("at").agg(F.sum("part").alias("total")).collect()  # a row for each dimension
    by = {r["at"]: r["total"] for r in found}
    return by.get(-1, 0), np.array([by.get(i, 0) for i in range(width)], dtype=np.int64)


def gramian(rows: DataFrame, column: str) -> np.ndarray:
    """The sum of outer products of the rows' vectors, by MLlib's RowMatrix, which reads the column in the JVM."""
    vectors = rows.select(array_to_vector(F.col(column)).alias("v"))
    return np.asarray(RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray())


def fit(rows: DataFrame, width: int, most: int = MOST_COMPONENTS) -> Whitening:
    n, total = sums(rows, width)
    if not n:
        return Whitening(0, total, np.zeros((width, 0)), np.zeros(0), 0.0)
    means = F.array(*[F.lit(int(s)) for s in total])
    centred = F.zip_with("x", means, lambda x, s: (x * F.lit(n) - s).cast("double") / F.lit(float(n)))
    covariance = gramian(rows.select(centred.alias("c")), "c") / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    trace = float(np.trace(covariance))
    kept = int(np.count_nonzero(values[:most] > trace * width * np.finfo(float).eps))
    return Whitening(n, total, directions[:, :kept].copy(), values[:kept].copy(), trace)


def exact_squares(d: np.ndarray) -> list[int]:
    """Sums of squares of each row of integers, exact however large."""
    largest = int(np.abs(d).max(initial=0))
    if largest * largest * max(1, d.shape[1]) < 1 << 63:
        return (d * d).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in d.tolist()]


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """id, deviation (decimal) and w, the whitened vector, of every row."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.directions / np.sqrt(model.values)))

    def whiten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from decimal import Decimal

        n, total, projection = sent.value
        for frame in frames:
            if len(frame):
                d = np.stack(frame["x"].to_numpy()).astype(np.int64) * n - total
                yield pd.DataFrame({"id": frame["id"], "deviation": [Decimal(v) for v in exact_squares(d)], "w": list((d / n) @ projection)})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInPandas(whiten, f"id {kind}, deviation decimal(38,0), w array<double>")


def whiten(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = MOST_COMPONENTS) -> tuple[DataFrame, Whitening, float]:
    """(id, deviation and w of each vector that takes part; the model; the largest entry of w's covariance minus the identity)."""
    scratch = Scratch(vectors.sparkSession)
    rows, width = integers(vectors, scratch, id_column, column)
    model = fit(rows, width, most)
    if not len(model.values):
        return rows.limit(0).select("id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("w")), model, 0.0
    out = scratch.save(apply(rows, model))
    total = out.select(F.posexplode("w").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()  # a row for each component
    means = np.array([r["s"] for r in sorted(total)]) / model.n
    covariance = gramian(out, "w") / model.n - np.outer(means, means)
    return out, model, float(np.abs(covariance - np.eye(len(means))).max())


def components(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", most: int = MOST_COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    out, model, error = whiten(vectors, id_column, column, most)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values]) if len(model.values) else F.array().cast("array<double>")
    each = out.select("id", "deviation", F.posexplode("w").alias("__at", "whitened"))
    return each.select(
        F.col("id").alias("vec_id"), (F.col("__at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"),
        "whitened", F.element_at(explained, F.col("__at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
