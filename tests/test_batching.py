"""Batches by pieces against a plain fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import batching


def fold(tokens, budget):
    out, used, number = [], 0, 0
    for k, n in enumerate(tokens):
        if k and used + n > budget:
            used, number = 0, number + 1
        used += n
        out.append(number)
    return out


def test_pieces_equal_a_fold():
    draw = random.Random(2)
    for _ in range(400):
        tokens = [draw.choice([0, 1, 2, 3, 7, 12, 30]) for _ in range(draw.randrange(1, 40))]
        budget, cuts = draw.randrange(1, 25), sorted({0, *(draw.randrange(40) for _ in range(draw.randrange(5)))})
        parts = [np.array(p) for a, b in zip(cuts, [*cuts[1:], None], strict=True) if (p := tokens[a:b])]
        began = batching.chained([(*batching.piece_outcomes(p, budget), int(p.sum())) for p in parts], budget)
        found = np.concatenate([batching.numbered(p, u, n, budget) for p, (u, n) in zip(parts, began, strict=True)])
        assert found.tolist() == fold(tokens, budget)


@pytest.mark.parametrize("pieces", [1, 7])
def test_large_and_small_keys(spark, pieces):
    draw = random.Random(4)
    rows = [(f"k{draw.randrange(5)}" if draw.random() < 0.3 else "hot", i, draw.randrange(1, 60), "x") for i in range(1500)] + [(None, 1, 5, "x"), (None, 2, None, "y")]
    data = spark.createDataFrame(rows, "name string, at int, tokens int, used string").repartition(6)
    found = batching.batch_tokens(data, "name", ["at"], 100, pieces)
    assert found.columns == ["name", "at", "tokens", "used", "batch"]
    got = {}
    for r in found.collect():
        got.setdefault(r["name"], []).append((r["at"], r["batch"]))
    for name in {r[0] for r in rows}:
        mine = sorted((r[1], r[2] or 0) for r in rows if r[0] == name)
        assert sorted(got[name]) == list(zip([a for a, _ in mine], fold([n for _, n in mine], 100), strict=True))


def test_a_hot_key_is_in_several_pieces(spark):
    rows = spark.range(4000).select(F.lit("one").alias("name"), F.col("id").alias("at"), F.lit(10).alias("tokens"))
    found = batching.batch_tokens(rows, "name", ["at"], 95, 8)
    assert found.groupBy("batch").count().filter("count <> 9").count() <= 1 and found.agg(F.max("batch")).collect()[0][0] == 444
    assert batching.batch_tokens(rows.limit(0), "name", ["at"], 95).count() == 0
