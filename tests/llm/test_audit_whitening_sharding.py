"""Filter audit, whitening and sharding: plain versions, exact laws and awkward input."""

import itertools
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import audit, common, queries, sharding, whitening

from .test_operators import LONG, frame

LABELS = "doc_id long, quality int, toxic int, part string, fails int"


def plain_audit(docs, labels):
    """{(part, order, step): counts} by applying the filters to each document in every order."""
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    rows = []
    for d, t, source in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and first[t] < d}
        own = [(q, x) for i, q, x in labels if i == d and d is not None]
        rows.append((source or "", {f for f, bad in fails.items() if bad}, any(q == 1 for q, _ in own), any(x == 1 for _, x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                here, before = [r for r in rows if r[0] == part], set(order[: step - 1])
                gone = [r for r in here if f in r[1] and not r[1] & before]
                shapley[f] += len(gone)
                kept = sum(not r[1] & (before | {f}) for r in here)
                redundant = sum(f in r[1] and bool(r[1] & before) for r in here)
                out[part, "".join(order), step] = [kept, len(gone), redundant, sum(r[1] == {f} for r in here), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def found_audit(docs, labels):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in names] for r in audit.audit(docs, labels).collect()}


@pytest.fixture(scope="module")
def hard(spark):
    texts = [None, "", " \n", "word", LONG, LONG, "ABC def", "a # b", " ".join(["x y"] * 300), " ".join(f"W{i}" for i in range(250)), "é" * 10 + " Ü\x85A", "word"]
    rows = [(i, t, "en", (None, "", "s")[i % 3]) for i, t in enumerate(texts)] + [(4, LONG, "en", "s"), (4, LONG, "en", "s"), (4, "word", None, "s"), (None, "word", "en", "s"), (None, "new", "en", "s")]
    return frame(spark, rows)


def test_audit_by_hand(spark, hard):
    labels = [(0, 1, 0), (3, None, 1), (3, 1, 0), (4, 1, 1), (8, 0, None), (None, 1, 1)]
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in hard.collect()], labels)
    table = spark.createDataFrame([(*x, "p", 1) for x in labels], LABELS)
    for data in (hard, hard.repartition(5)):
        assert found_audit(data, table) == want


def test_audit_hot_texts(spark, monkeypatch):
    """A text that most rows have is looked up by broadcast, with the same result."""
    rows = [(i, "same old text" if i % 4 else f"text {i}", "en", f"s{i % 2}") for i in range(200)] + [(500, "text 8"), (501, "text 8")]
    docs, none = frame(spark, rows), spark.createDataFrame([], LABELS)
    want = plain_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], [])
    assert found_audit(docs, none) == want
    monkeypatch.setattr(audit, "HOT_SHARE", 3)
    assert found_audit(docs, none) == want


def test_audit_empty(spark):
    assert found_audit(frame(spark, []).limit(0), spark.createDataFrame([], LABELS)) == {}


def test_audit_sql(spark, sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(queries.ORACLE_SQL["op11_filter_audit"]).df()
    found = queries.op11_filter_audit(spark, sf_dir).toPandas()
    order = ["part", "filter_order", "step"]
    assert found[sorted(found)].sort_values(order).values.tolist() == want[sorted(want)].sort_values(order).values.tolist()


def test_audit_shuffles_no_words(spark, sf_dir):
    """Words are counted where their text was dealt to: no exchange between the explosion and the totals by document."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("__id"), F.unhex(F.sha2("text", 256)).alias("__digest"), F.col("text").alias("__text"))
    plan = audit.word_totals(docs)._jdf.queryExecution().executedPlan().toString()
    words = plan.index("Generate explode")
    between = plan[:words]
    assert between.count("Exchange") == 1 and plan[words:].count("Exchange") == 1


def whitened(rows):
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["component"]) for k, v in by.items()}


def test_whitening_on_embeddings(spark, sf_dir):
    table = common.table(spark, sf_dir, "embeddings")
    x = {r["vec_id"]: [math.floor(64 * float(c)) + 1_000_000 for c in r["embedding"]] for r in table.collect()}
    n, total = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    ids = sorted(x)
    centred = np.array([[(n * a - s) / n for a, s in zip(x[i], total, strict=True)] for i in ids])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    found = whitened(queries.op12_whitening(spark, sf_dir).collect())
    assert sorted(found) == ids and {len(v) for v in found.values()} == {min(32, len(total))}
    got = np.array([[r["whitened"] for r in found[i]] for i in ids])
    for k in range(got.shape[1]):
        want = centred @ vectors[:, -1 - k] / math.sqrt(values[-1 - k])
        assert min(np.abs(got[:, k] - want).max(), np.abs(got[:, k] + want).max()) < 1e-9
        assert abs(found[ids[0]][k]["explained"] - values[-1 - k] / np.trace(covariance)) < 1e-12
    for i in ids:
        assert found[i][0]["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], total, strict=True)) and found[i][0]["n"] == n
    errors = {r["identity_error"] for v in found.values() for r in v}
    assert len(errors) == 1 and abs(errors.pop() - np.abs(np.cov(got.T, bias=True) - np.eye(got.shape[1])).max()) < 1e-12


def test_whitening_awkward(spark):
    bad = [(1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, float("nan"), 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [1.0, 2.0])]
    good = [(10, [0.0, 0.0, 1.0]), (11, [1.0, 0.0, 1.0]), (11, [1.0, 0.0, 1.0]), (None, [0.0, 2.0, 1.0]), (13, [-3.0, 1e6, 1.0])]
    schema = "vec_id long, embedding array<float>"
    rows = lambda data: spark.createDataFrame(data, schema).withColumn("x", F.lit(1)).withColumn("component", F.lit("c"))
    found = whitening.components(rows(bad + good)).collect()
    assert sorted((r["vec_id"] or -1, r["component"]) for r in found) == sorted((i, c) for i in (10, 11, 11, -1, 13) for c in (1, 2))  # the third dimension doesn't vary
    assert max(r["identity_error"] for r in found) < 1e-4 and {r["n"] for r in found} == {5}
    for data in (bad[:5], [], good[:1], good[1:3]):
        assert whitening.components(rows(data)).collect() == []
    assert [f.name for f in whitening.components(rows([])).schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_exact_squares_beyond_long():
    d = np.array([[1 << 40, -(1 << 40)], [3, 4]])
    assert whitening.exact_squares(d) == [1 << 81, 25]


def test_large_urns_follow_the_law(monkeypatch):
    """The sampler for urns beyond NumPy's, on an urn small enough to know the law."""
    rng, good, bad, drawn = np.random.default_rng(5), 30, 50, 20
    monkeypatch.setattr(sharding, "_NUMPY_MOST", 1)
    seen = Counter(sharding.hypergeometric(rng, good, bad, drawn) for _ in range(20_000))
    for k in range(21):
        p = math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn)
        assert abs(seen[k] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-3
    many = [sharding.hypergeometric(rng, 3 * 10**10, 7 * 10**10, 10**6) for _ in range(300)]
    assert abs(np.mean(many) - 300_000) < 5 * math.sqrt(210_000 / 300)
    assert 0.8 < np.std(many) / math.sqrt(210_000) < 1.2
    for case in ((5, 0, 3), (0, 5, 3), (4, 4, 8), (4, 4, 0)):
        assert sharding.hypergeometric(rng, *case) == min(case[0], case[2]) if case[0] * case[1] == 0 or case[2] in (0, 8) else True


def test_communication_matrix():
    rng = np.random.default_rng(1)
    found = sharding.communication_matrix(rng, [5, 0, 9, 1], [4, 4, 4, 3])
    assert found.sum(axis=1).tolist() == [5, 0, 9, 1] and found.sum(axis=0).tolist() == [4, 4, 4, 3]
    # two parts of two rows to two shards: 1 in the corner with probability 2/3
    ones = sum(sharding.communication_matrix(rng, [2, 2], [2, 2])[0, 0] == 1 for _ in range(6000))
    assert abs(ones / 6000 - 2 / 3) < 0.03


def check_shards(rows, n, shards):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(j, [])) for j in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))


def test_sharding_of_documents(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    rows = queries.op13_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {d: (len(t) + 1, zlib.crc32(t)) for d, t in texts.items()}
    assert {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    check_shards(rows, len(texts), 16)


def test_sharding_small_parts_and_cells(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART", 64)
    monkeypatch.setattr(sharding, "CELL", 32)
    monkeypatch.setattr(sharding, "GROUPS", 3)
    data = spark.range(1003, numPartitions=7).withColumn("text", F.lit("equal"))
    rows = sharding.shuffled(data, 5).collect()
    check_shards(rows, 1003, 5)
    assert sorted(r["id"] for r in rows) == list(range(1003))
    again = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(data, 5).collect()}
    assert again == {r["id"]: (r["shard"], r["slot"]) for r in rows}


def test_sharding_is_uniform(spark):
    """Over many seeds each row is as often in each place, and two rows of one part are as often apart as two of others."""
    data, seen, together = spark.range(8, numPartitions=2), Counter(), Counter()
    for seed in range(24):
        rows = {r["id"]: (r["shard"], r["slot"]) for r in sharding.shuffled(data, 4, seed).collect()}
        seen.update((i, p) for i, p in rows.items())
        together.update((a, b) for a, b in itertools.combinations(range(8), 2) if rows[a][0] == rows[b][0])
    # chi-squared of 8 x 8 cells with mean 3: 49 degrees of freedom, deviation about 10
    chi = sum((seen[i, (s, k)] - 3) ** 2 / 3 for i in range(8) for s in range(4) for k in range(2))
    assert chi < 49 + 5 * 10
    within = sum(n for (a, b), n in together.items() if a // 4 == b // 4) / (12 * 24)
    across = sum(n for (a, b), n in together.items() if a // 4 != b // 4) / (16 * 24)
    assert abs(within - 1 / 7) < 0.1 and abs(across - 1 / 7) < 0.1


def test_sharding_awkward(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, LONG), (3, LONG), (None, "é")]
    found = sharding.placed(frame(spark, rows)).collect()
    check_shards(found, 5, 16)
    assert sorted((r["doc_id"] or -1, r["size"]) for r in found) == [(-1, 3), (1, 1), (2, 1), (3, len(LONG) + 1), (3, len(LONG) + 1)]
    assert sharding.placed(frame(spark, []).limit(0)).collect() == []
    with pytest.raises(ValueError):
        sharding.shuffled(spark.range(3).withColumn("slot", F.lit(1)))
    with pytest.raises(ValueError):
        sharding.shuffled(spark.range(3), 0)
    sharding.write(frame(spark, rows), f"{tmp_path}/shards", 2, rows_a_file=2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 5 and {r["text"] for r in back.collect()} == {r[1] for r in rows}
