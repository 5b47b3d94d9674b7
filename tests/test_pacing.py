"""Admission and key scheduling against plain loops, in pieces, and across a stream's restart."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import pacing
from factloom.streaming import events as E
from factloom.streaming import pacing as streamed

SECOND = 1_000_000


def plain_admission(requests, target):
    """{id: (admitted_at, wait, used)} by scanning all earlier admissions each time."""
    out, last, done = {}, {}, {}
    for key, at, i, tokens in sorted(requests, key=lambda r: (r[1], r[2])):
        if tokens > target:
            out[i] = (None, None, None)
            continue
        now = max(at, last.get(key, at))
        inside = lambda now: sum(n for t, n in done.get(key, []) if now - t < 60 * SECOND)  # noqa: B023, E731
        while inside(now) + tokens > target:
            over, freed = inside(now) + tokens - target, 0
            for t, n in [x for x in done[key] if now - x[0] < 60 * SECOND]:
                freed += n
                if freed >= over:
                    now = max(now + SECOND // 10, t + 60 * SECOND)
                    break
        out[i] = (now, now - at, inside(now))
        done.setdefault(key, []).append((now, tokens))
        last[key] = now
    return out


def plain_schedule(calls, keys, gap, cap):
    out, state = {}, {}
    for pool, at, i in sorted(calls, key=lambda r: (r[1], r[2])):
        free, used = state.setdefault(pool, ({k: 0 for k in range(keys)}, {}))
        day = at // pacing.DAY
        left = [k for k in free if not cap or used.get((k, day), 0) < cap]
        if not left:
            out[i] = (None, None, None)
            continue
        k = min(left, key=lambda k: (max(free[k], at), k))
        when = max(free[k], at)
        free[k], used[k, day] = when + gap, used.get((k, day), 0) + 1
        out[i] = (k, when, used[k, day])
    return out


def some_requests(seed, n=900):
    draw, out = random.Random(seed), []
    for key, pace in (("idle", 90), ("busy", 6), ("mixed", 25)):
        at = 1_700_000_000 * SECOND
        for _ in range(n // 3):
            at += int(draw.expovariate(1 / pace) * SECOND) if draw.random() < 0.9 else 0
            if key == "mixed" and draw.random() < 0.02:
                at += 1200 * SECOND
            out.append((key, at, len(out), draw.choice([50, 200, 400, 700, 1000, 1001])))
    return out


def test_admission_equals_a_plain_loop(spark):
    rows = some_requests(1)
    data = spark.createDataFrame([*rows, ("idle", None, -1, 5)], "key string, at long, id long, tokens long").withColumn("wait", F.lit("x")).drop("wait").repartition(5)
    want = plain_admission(rows, 1000)
    found = pacing.admitted(data, "key", "at", "id", 1000).collect()
    assert {r["id"]: (r["admitted_at"], r["wait"], r["used"]) for r in found} == want
    assert sum(w[1] or 0 for w in want.values()) > 0 and any(w[0] is None for w in want.values())


def test_busy_periods_split_keys(spark):
    """Idle stretches divide a key's rows, the busy key has few divisions, and pieces of time of any length give the same ones."""
    data = spark.createDataFrame(some_requests(2), "key string, at long, id long, tokens long")
    cut = lambda piece: {(r["id"], r["__segment"]) for r in pacing.busy_periods(data, "key", "at", "id", F.col("tokens") * F.lit(12_000.0), 240 * SECOND, piece=piece).collect()}
    found = cut(3600 * SECOND)
    assert found == cut(60 * SECOND) == cut(10**15)
    rows = {r["id"]: r["key"] for r in data.collect()}
    n = {k: len({s for i, s in found if rows[i] == k}) for k in ("idle", "busy", "mixed")}
    assert n["busy"] < n["mixed"] and n["mixed"] > 3


def test_schedule_equals_a_plain_loop(spark):
    draw, calls = random.Random(5), []
    for pool, pace in (("a", 4), ("b", 900), ("c", 6000)):
        at = 1_700_000_000 * SECOND
        for _ in range(400):
            at += int(draw.expovariate(1 / pace) * SECOND) if draw.random() < 0.95 else 0
            calls.append((pool, at, len(calls)))
    data = spark.createDataFrame(calls, "pool string, at long, id long").repartition(4)
    for keys, rate, cap in ((3, 5, 20), (1, 5, 0), (2, 0, 7)):
        gap = 0 if not rate else 60 * SECOND // rate + SECOND
        found = pacing.scheduled(data, "pool", "at", "id", keys, rate, cap).collect()
        assert {r["id"]: (r["slot"], r["call_at"], r["nth"]) for r in found} == plain_schedule(calls, keys, gap, cap)


def test_default_gap_and_cap():
    pool = pacing.KeyPool(1, 13 * SECOND, 2)
    assert pool.call(0) == (0, 0, 1) and pool.call(0) == (0, 13 * SECOND, 2) and pool.call(10**9) == (None, None, None)
    assert pool.call(pacing.DAY) == (0, pacing.DAY, 1)


def test_empty(spark):
    none = spark.createDataFrame([], "key string, at long, id long, tokens long")
    assert pacing.admitted(none, "key", "at", "id", 10).columns == ["key", "at", "id", "tokens", "admitted_at", "wait", "used"]
    assert pacing.admitted(none, "key", "at", "id", 10).count() == 0 and pacing.scheduled(none, "key", "at", "id", 2).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    rows = sorted(some_requests(3, 300), key=lambda r: (r[1], r[2]))
    schema, folder, source = "key string, at long, id long, tokens long", f"{tmp_path}/q", f"{tmp_path}/in"
    want = plain_admission(rows, 1000)
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        found = {r["id"]: (r["admitted_at"], r["wait"], r["used"]) for r in streamed.admitted(stream, "key", "at", "id", 1000, folder).collect()}
        assert found == {r[2]: want[r[2]] for r in rows[: (k + 1) * 100]}
    assert E.shared_folder(spark) != E.shared_folder(spark)


@pytest.mark.parametrize("tokens", [[10, 10, 10], [30, 30, 30], [31, 1]])
def test_window_by_hand(tokens):
    window = pacing.TokenWindow(30)
    found = [window.ask(k, n, n)[0] for k, n in enumerate(tokens)]
    assert found == {3: [0, 1, 2] if tokens[0] == 10 else [0, 60 * SECOND, 120 * SECOND], 2: [None, 1]}[len(tokens)]
