"""Paraphrases by the latent path alone, one answer at any block size, and benchmarks whose items begin alike."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import decontaminate

from .test_operators import frame, lcs


def drawn(draw):
    return f"w{int(draw.paretovariate(0.6)) % 4000}"


def benchmark(spark, items, answers):
    return spark.createDataFrame([(i, " ".join(x), " ".join(a)) for i, (x, a) in enumerate(zip(items, answers, strict=True))], "item_id long, text string, answer string")


@pytest.mark.parametrize("every", [4, 3])
def test_paraphrases_without_equal_runs(spark, every):
    """One word in four, or in three, is another, so no five in a row are equal; of 400 wanted pairs 0.9 or more are found."""
    draw = random.Random(every)
    items = [[drawn(draw) for _ in range(draw.randrange(12, 41))] for _ in range(1999)]
    answers, rows = [], []
    for i, item in enumerate(items):
        near = [f"x{draw.randrange(10**6)}" if j % every == every - 1 else w for j, w in enumerate(item)]
        answers.append([near[j] for j in range(len(near)) if j % every != every - 1][:2])
        if i < 400:
            rows.append((i, " ".join([*(drawn(draw) for _ in range(40 + draw.randrange(8))), *near, *(drawn(draw) for _ in range(40))])))
            assert not {tuple(item[k : k + 5]) for k in range(len(item) - 4)} & {tuple(near[k : k + 5]) for k in range(len(near) - 4)}
    wanted = [i for i, text in rows if lcs(items[i], text.split()) >= 0.55 * len(items[i])]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame(spark, rows).repartition(4), benchmark(spark, items, answers)).collect()}
    recall = sum((i, i) in found for i in wanted) / len(wanted)
    assert len(wanted) > 380 and recall >= 0.9, recall
    short = [i for i in wanted if len(items[i]) < 20]
    assert sum((i, i) in found for i in short) >= 0.85 * len(short)


def test_one_answer_at_any_block_size(spark, monkeypatch):
    draw = random.Random(6)
    items = [[drawn(draw) for _ in range(draw.randrange(8, 90))] for _ in range(120)]
    answers = [x[:2] for x in items]
    rows = []
    for i in range(80):
        near = [w if draw.random() > 0.25 else drawn(draw) for w in items[i]]
        rows.append((i, " ".join([*(drawn(draw) for _ in range(30)), *near, *(drawn(draw) for _ in range(30))])))
    docs, bench = frame(spark, rows), benchmark(spark, items, answers)
    results = []
    for size, most in ((2000, decontaminate.MOST_BYTES), (50, decontaminate.MOST_BYTES), (8, 1)):
        monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", size)
        monkeypatch.setattr(decontaminate, "MOST_BYTES", most)
        results.append({(r["doc_id"], r["item_id"], r["kind"], r["overlap"]) for r in decontaminate.find(docs, bench).collect()})
    assert results[0] and results[0] == results[1] == results[2]


def test_items_that_begin_alike(spark):
    """1,600 items with one opening: documents that say it often take little longer, and copies among them are found."""
    draw = random.Random(9)
    drawn = lambda draw: f"w{draw.randrange(4000)}"
    opening = "which of the following is".split()
    items = [[*opening, *(drawn(draw) for _ in range(draw.randrange(6, 20)))] for _ in range(1600)]
    bench = benchmark(spark, items, [x[-2:] for x in items])
    body = lambda: [drawn(draw) for _ in range(300)]
    plain = [(i, " ".join(body())) for i in range(200)]
    often = []
    for i in range(200):
        words = body()
        for k in range(20):
            words[k * 15 : k * 15] = opening
        often.append((i, " ".join([*words, *items[i]])))
    docs = frame(spark, plain)
    parts = decontaminate.blocks(bench)
    space = decontaminate.latent_space(parts, docs)
    index = decontaminate.index_block(parts[0], space, 0.8, copy_share=0.75, paraphrase_share=0.55, answer_share=0.6)

    def seconds(rows):
        began, out = time.process_time(), []
        for first, words, bounds in decontaminate._documents(pa.array([t for _, t in rows])):
            out += [(first + d, k) for d, k, *_ in index.matches(words, bounds)]
        return time.process_time() - began, out

    seconds(plain[:20])
    without, _ = seconds(plain)
    hot, found = seconds(often)
    assert {(i, i) for i in range(200)} <= set(found)
    assert hot < 4 * without + 1.0, (hot, without)


def test_counts_of_words_that_are_there():
    bounds, places = np.array([0, 3, 3, 5]), np.array([0, 1, 0, 2, 1])
    held = lambda there, items: [x.tolist() for x in decontaminate._held(np.array(there, dtype=bool), np.array(items, dtype=int), bounds, places)]
    assert held([1, 0, 1], [0, 1, 2]) == [[2, 0, 1], [3, 0, 2]] and held([1, 1, 0], [2]) == [[1], [2]] and held([1, 1, 1], []) == [[], []]


def test_answers_decide(spark):
    words = [f"q{i}" for i in range(20)]
    near = " ".join(w if i % 3 else f"z{i}" for i, w in enumerate(words))
    bench = spark.createDataFrame([(1, " ".join(words), "q1 q2"), (2, " ".join(words), "not here")], "item_id long, text string, answer string")
    rows = [(1, near), (2, None), (3, "")]
    assert [(r["doc_id"], r["item_id"]) for r in decontaminate.find(frame(spark, rows), bench).collect()] == [(1, 1)]
    assert decontaminate.clean(frame(spark, rows), bench).filter(F.col("doc_id") == 1).count() == 0
