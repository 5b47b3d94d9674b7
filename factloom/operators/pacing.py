"""Admission under a token budget, and calls dealt to rate-limited keys: each decision needs the ones before.

A key's requests are a chain, but not an endless one: once all that came before has surely
run off, the next request starts afresh.  :func:`busy_periods` finds such places from
running sums and maxima, taken by pieces of time and of those pieces, so that not a key
but one of its busy periods is folded in order; its rows pass through a task as a
stream, with a state of what a window holds.

Times are microseconds (long).  Rows whose time is null take no part.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship

WINDOW = 60_000_000
LEAST_WAIT = 100_000
DAY = 86_400_000_000
ADMISSION = "admitted_at long, wait long, used long"
ASSIGNMENT = "slot long, call_at long, nth long"


class TokenWindow:
    """What a key has used in the last 60 seconds, and when its next request may go."""

    def __init__(self, target: int, last: int | None = None, events: list[tuple[int, int]] = ()) -> None:
        self.target, self.last, self.events = target, last, deque(events)
        self.held = sum(n for _, n in self.events)

    def _expire(self, now: int) -> None:
        while self.events and now - self.events[0][0] >= WINDOW:
            self.held -= self.events.popleft()[1]

    def ask(self, at: int, asked: int, spent: int) -> tuple[int | None, int | None, int | None]:
        """(time of admission, wait, tokens used in the window then); nothing for a request above the target, which changes nothing."""
        if asked > self.target:
            return None, None, None
        now = at if self.last is None else max(at, self.last)
        self._expire(now)
        while self.held + asked > self.target:
            needed, freed, reset = self.held + asked - self.target, 0, now
            for began, n in self.events:
                freed, reset = freed + n, began + WINDOW
                if freed >= needed:
                    break
            now += max(LEAST_WAIT, reset - now)
            self._expire(now)
        used = self.held
        self.events.append((now, spent))
        self.held += spent
        self.last = now
        return now, now - at, used


class KeyPool:
    """Keys with a gap between calls and a daily cap: heaps of those that are free, by number, and of others, by when they will be."""

    def __init__(self, keys: int, gap: int, cap: int) -> None:
        self.keys, self.gap, self.cap, self.day = keys, gap, cap, None
        self.busy: list[tuple[int, int]] = []
        self.idle, self.spent, self.calls = list(range(keys)), [], [0] * keys

    def call(self, at: int) -> tuple[int | None, int | None, int | None]:
        """(key, time of the call, its number of the key's day); nothing if all keys have had their day's calls."""
        if self.day != at // DAY:
            self.day, self.calls = at // DAY, [0] * self.keys
            for x in self.spent:
                heapq.heappush(self.busy, x)
            self.spent = []
        while self.busy and self.busy[0][0] <= at:
            heapq.heappush(self.idle, heapq.heappop(self.busy)[1])
        if self.idle:
            when, k = at, heapq.heappop(self.idle)
        elif self.busy:
            when, k = heapq.heappop(self.busy)
        else:
            return None, None, None
        self.calls[k] += 1
        full = 0 < self.cap <= self.calls[k]
        heapq.heappush(self.busy, (when + self.gap, k)) if not full else self.spent.append((when + self.gap, k))
        return k, when, self.calls[k]


def busy_periods(rows: DataFrame, key: str, at: str, order: str, cost: Column, slack: int, fresh: Column | None = None, piece: int = 3_600_000_000) -> DataFrame:
    """``rows`` with __piece and __segment, the time at which the row's busy period began.

    A row begins one if all work before it, each row costing ``cost`` from when the last was
    done, was done ``slack`` before (and ``fresh`` holds, a condition on the row and __before, the time of
    the key's last row).  Done after a row is the largest, over rows j up to it, of j's time plus
    the costs from j on: a running sum and a running maximum, by pieces of time, then over pieces.
    """
    rows = rows.filter(F.col(at).isNotNull()).withColumn("__piece", F.floor(F.col(at) / F.lit(piece))).withColumn("__cost", cost.cast("double"))
    here = W.partitionBy(key, "__piece").orderBy(at, order)
    upto, earlier = here.rowsBetween(W.unboundedPreceding, 0), here.rowsBetween(W.unboundedPreceding, -1)
    led = rows.withColumn("__sum", F.sum("__cost").over(upto) - F.col("__cost")).withColumn("__lead", F.col(at) - F.col("__sum"))
    pieces = led.groupBy(key, "__piece").agg(F.sum("__cost").alias("s"), F.max("__lead").alias("m"), F.max(at).alias("t"))
    before = W.partitionBy(key).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("__off", F.coalesce(F.sum("s").over(before), F.lit(0.0)))
    pieces = pieces.select(key, "__piece", "__off", F.max(F.col("m") - F.col("__off")).over(before).alias("__most"), F.max("t").over(before).alias("__last"))
    known = led.join(pieces, [key, "__piece"])
    most = F.greatest(F.col("__most"), F.max("__lead").over(earlier) - F.col("__off"))
    done = F.col("__off") + F.col("__sum") + most
    known = known.withColumn("__before", F.greatest(F.col("__last"), F.max(at).over(earlier))).withColumn("__done", done)
    begins = F.col("__done").isNull() | ((F.col(at) >= F.col("__done") + F.lit(slack)) & (F.lit(True) if fresh is None else fresh))
    known = known.withColumn("__own", F.max(F.when(begins, F.col(at))).over(upto))
    carried = known.groupBy(key, "__piece").agg(F.max("__own").alias("own"))
    carried = carried.select(key, "__piece", F.max("own").over(before).alias("__carried"))
    return known.join(carried, [key, "__piece"]).withColumn("__segment", F.coalesce("__own", "__carried")).select(*rows.columns, "__segment")


def _folded(rows: DataFrame, key: str, at: str, order: str, made: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Rows of each busy period in order through ``step(state, row)``, which gives the values of ``made``."""
    ship(rows.sparkSession)
    names = [x.split()[0] for x in made.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = None, None
        for frame in frames:
            found = []
            for row in frame.itertuples(index=False):
                here = (row[0], row[1])
                if here != held:
                    held, state = here, start()
                found.append(step(state, row))
            for i, name in enumerate(names):
                frame[name] = pd.array([f[i] for f in found], dtype="Int64")
            yield frame

    first = [key, "__segment"]
    dealt = rows.select(*first, *[c for c in rows.columns if c not in first])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.repartition(*first).sortWithinPartitions(*first, at, order).mapInPandas(run, f"{fields}, {made}")


def admitted(requests: DataFrame, key: str, at: str, order: str, target: int, asked: str = "tokens", spent: str | None = None) -> DataFrame:
    """Each request with admitted_at, wait and used: a key's requests in order, one at a time.

    A request goes once what the key used in the 60 seconds before and what it asks for fit
    ``target``; else it waits until enough has expired, at least a tenth of a second.  One that asks for more than
    ``target`` is refused: all three are null.  What it used (``spent``, or what it asked for)
    counts from its admission.  A key's rows that share a time go by ``order``.

    While a request waits, 120 seconds never pass without ``target`` tokens, so each token
    is done 120 / ``target`` seconds after those before it; 240 seconds more cover the windows at both ends.
    """
    asks, uses = F.col(asked), F.col(spent or asked)
    costs = F.when(asks > target, 0).otherwise(F.greatest(asks, uses)) * F.lit(2.0 * WINDOW / target)
    rows = busy_periods(requests.withColumn("__asked", asks.cast("long")).withColumn("__spent", uses.cast("long")), key, at, order, costs, 4 * WINDOW)
    rows = rows.select(key, "__segment", *[c for c in rows.columns if c not in (key, "__segment")])
    i, j, k = (rows.columns.index(c) for c in (at, "__asked", "__spent"))
    out = _folded(rows, key, at, order, ADMISSION, lambda: TokenWindow(target), lambda window, row: window.ask(int(row[i]), int(row[j]), int(row[k])))
    return out.select(*requests.columns, "admitted_at", "wait", "used")


def scheduled(calls: DataFrame, pool: str, at: str, order: str, keys: int, per_minute: int = 5, per_day: int = 20, slack: int = 1_000_000) -> DataFrame:
    """Each call with slot (the key of the pool that takes it), call_at and nth (its number of the key's day).

    A key is free a minute's share and ``slack`` after its last call and takes at most ``per_day`` calls that came in on
    one day (UTC); 0 lifts either limit.  Of keys with calls left the first that is free takes the call,
    if none is the one that will be first; if none has calls left, all three are null.

    A pool starts afresh on a new day when all its calls, as if one key had them, are done.
    """
    gap = 0 if per_minute <= 0 else 60_000_000 // per_minute + slack
    fresh = F.floor(F.col(at) / F.lit(DAY)) > F.floor(F.col("__before") / F.lit(DAY))
    rows = busy_periods(calls, pool, at, order, F.lit(gap), 0, fresh)
    rows = rows.select(pool, "__segment", *[c for c in rows.columns if c not in (pool, "__segment")])
    i = rows.columns.index(at)
    out = _folded(rows, pool, at, order, ASSIGNMENT, lambda: KeyPool(keys, gap, per_day), lambda keys, row: keys.call(int(row[i])))
    return out.select(*calls.columns, "slot", "call_at", "nth")
