"""Repeated passages by a sparse suffix array.

Suffixes are kept only where content selects them: at the smallest of every 31 hashes of
20-word runs in a row, so any passage of 50 words holds a kept place, the same in each of
its copies.

1. One pass counts each kept place's key, the hash of its 20 words, by documents.  Keys of
   one document alone are out: a bitmap of the others, sized by their number, goes to all tasks.
2. One pass gives each other suffix the ``least_words`` - 20 words to its right and to its
   left, three bytes each, and deals them out by key.  In each task suffixes are sorted by key
   and right context, then by key and left context, and each is compared with its neighbours:
   the longest common beginnings on both sides bound what any match of it can reach, so most
   are out.
3. What is left is extended to both sides exactly: a match of ``least_words`` round a key is
   one of the cuts of that length which hold the key, and equal cuts of different documents,
   neighbours or not, mark a span in each.
4. Spans that overlap in a document are merged, which gives the whole passage however long.

A key of more than ``HOT`` suffixes isn't gathered: its cuts are counted by a groupBy that
combines before it shuffles, and those of several documents are joined back.  No pairs are made.

Words are compared by 24 bits of their hashes next to a 64-bit key: an end that differs passes
for equal in one of 16 million cases.

Defined results: words are compared with A-Z in lower case; null, empty and short texts have
no span; repeats within one document alone don't count, rows that repeat a doc_id are one
document; a null doc_id takes no part; an empty table gives no rows; other columns are
ignored by :func:`find` and kept by :func:`strip`.  A text takes some 40 bytes of memory for each byte.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .wordhash import mix64, ngram_hashes, text_buffers, word_chunks

KEY_WORDS, WINDOW = 20, 31
LEAST_WORDS = 50
HOT = 1 << 16  # suffixes of a key that one task compares: some 13 MB, and 60 MB while it does
ROWS = 1 << 15  # suffixes that a task looks at together
MOST_BITS = 1 << 30
_BITS_A_KEY = 16
_PART_BITS = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WIDTH = 3  # bytes of a word in a context
_MOST_BROADCAST = 20_000
_VIEWS = 1 << 14
_SUFFIX = "key long, doc_id long, pos int, context binary"
_SPAN = "doc_id long, start int, end int, other long"
_CUT = "cut long, doc_id long, start int"


def minimisers(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the smallest of every ``window`` hashes in a row, the first of equal ones."""
    if len(grams) < window:
        return np.zeros(0, dtype=np.int64)
    views, out = np.lib.stride_tricks.sliding_window_view(grams, window), []
    for lo in range(0, len(views), _VIEWS):  # argmin copies its input
        some = views[lo : lo + _VIEWS]
        out.append(np.unique(some.argmin(axis=1) + np.arange(lo, lo + len(some))))
    return np.unique(np.concatenate(out)) if len(out) > 1 else out[0]


class KeySet:
    """A bitmap of keys: every key that was added is in it, few others are."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def __contains__(self, _: object) -> bool:
        raise TypeError("use holds")

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def key_set(keys: DataFrame, n: int) -> KeySet:
    """The set of column ``key``: a power of two of bits, 16 for each of ``n`` keys, no more than MOST_BITS; made part by part where the keys are."""
    size = max(_PART_BITS, min(MOST_BITS, 1 << (_BITS_A_KEY * max(1, n) - 1).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) & np.uint64(size - 1)
            part = (at // np.uint64(_PART_BITS)).astype(np.int64)
            names, out = np.unique(part), []
            for name in names:
                flags = np.zeros(_PART_BITS, dtype=np.uint8)
                flags[(at[part == name] % np.uint64(_PART_BITS)).astype(np.int64)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"part": pa.array(names.astype(np.int32)), "bits": pa.array(out, pa.binary())})

    def either(frame: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in frame["bits"]])
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "bits": [bits.tobytes()]})

    held = np.zeros(size // 8, dtype=np.uint8)
    parts = size // _PART_BITS
    dealt = keys.select("key").repartitionByRange(F.pmod("key", F.lit(parts * _PART_BITS))) if parts > 1 else keys.select("key")
    for r in common.arrow_map(dealt, gather, "part int, bits binary").groupBy("part").applyInPandas(either, "part int, bits binary").toLocalIterator():
        held[r["part"] * (_PART_BITS // 8) : (r["part"] + 1) * (_PART_BITS // 8)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return KeySet(held)


def _kept(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(document, its word hashes, kept places, their keys)."""
    for c in word_chunks(*text_buffers(column)):
        for i in range(len(c.bounds) - 1):
            words = c.hashes[c.bounds[i] : c.bounds[i + 1]]
            if len(words) >= KEY_WORDS + WINDOW - 1:
                grams = ngram_hashes(words, KEY_WORDS)
                at = minimisers(grams)
                yield c.first + i, words, at, grams[at]


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("__text")).filter("doc_id is not null")


def keys(docs: DataFrame) -> DataFrame:
    """key and n, the number of kept places, of keys that two documents have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found, names = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
            for i, _, at, grams in _kept(batch.column(1)):
                found.append(grams)
                names.append(np.full(len(at), ids[i]))
            yield from common.sliced(pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(names))], names=["key", "doc_id"]), 10_000)

    counted = common.arrow_map(_source(docs), run, "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n"))
    return counted.filter("a <> b").select("key", "n")


def _contexts(words: np.ndarray, at: np.ndarray, side: int) -> np.ndarray:
    """For each place the ``side`` words after its key and then those before it, the nearest first; 0 beyond the text.  (n, 2 side) of 24 bits."""
    small = np.zeros(len(words) + 2, dtype=np.uint32)  # a zero before the first and after the last word
    small[1:-1] = (words >> np.uint64(20)).astype(np.uint32) % np.uint32((1 << 24) - 1) + np.uint32(1)
    steps = np.arange(side)
    right = small[np.minimum(at[:, None] + 1 + KEY_WORDS + steps, len(words) + 1)]
    return np.concatenate([right, small[np.maximum(at[:, None] - steps, 0)]], axis=1)


def _packed(contexts: np.ndarray) -> pa.Array:
    """24-bit numbers as bytes, the highest first, so that bytes sort as the words do."""
    n, width = len(contexts), _WIDTH * contexts.shape[1]
    raw = np.ascontiguousarray(contexts.astype(">u4")).view(np.uint8).reshape(n, -1, 4)[:, :, 4 - _WIDTH :]
    offsets = np.arange(0, n * width + 1, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw).reshape(-1))])


def _unpacked(column: pa.Array, side: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), 2 * side, _WIDTH)
    return (raw[:, :, 0].astype(np.uint32) << np.uint32(16)) | (raw[:, :, 1].astype(np.uint32) << np.uint32(8)) | raw[:, :, 2]


def cuts(key: np.ndarray, contexts: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """((n, side + 1) hashes, whether they lie within the text) of the cuts round each key, the r-th with r words to its right."""
    sums = []
    for half in (contexts[:, :side], contexts[:, side:]):
        out = np.zeros((len(key), side + 1), dtype=np.uint64)
        for k in range(side):
            out[:, k + 1] = (out[:, k] + half[:, k]) * _BASE + np.uint64(k + 1)
        sums.append(out)
    inside = [(half != 0).sum(axis=1) for half in (contexts[:, :side], contexts[:, side:])]
    r = np.arange(side + 1)
    names = mix64(mix64(sums[0] + key[:, None]) + sums[1][:, ::-1] * np.uint64(0xD6E8FEB86659FD93) + r.astype(np.uint64))
    return names, (r <= inside[0][:, None]) & (side - r <= inside[1][:, None])


def _longest(key: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The longest beginning of each row that a neighbour of its key shares, in order of key and context."""
    n, side = half.shape
    text = np.ascontiguousarray(half.astype(">u4")).view(f"S{4 * side}").ravel()
    order = np.lexsort((text, key))
    a, b = half[order[:-1]], half[order[1:]]
    differ = (a != b) | (a == 0)
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), side) if n > 1 else np.zeros(0, dtype=np.int64)
    shared[key[order[:-1]] != key[order[1:]]] = -1
    best = np.full(n, -1)
    best[order[1:]] = shared
    best[order[:-1]] = np.maximum(best[order[:-1]], shared)
    return best


def matches(key: np.ndarray, doc: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, words to the left, words to the right, other document) of suffixes of whole keys that another document's suffix matches.

    The other document is the smallest one that shares a cut, or the largest for that itself.
    """
    side = contexts.shape[1] // 2
    right, left = _longest(key, contexts[:, :side]), _longest(key, contexts[:, side:])
    rows = np.flatnonzero((right >= 0) & (left >= 0) & (right + left >= side))
    key, doc = key[rows], doc[rows]
    names, inside = cuts(key, contexts[rows], side)
    none = np.iinfo(np.int64).max
    reach = np.full((2, len(rows)), -1)
    first, last = np.full(len(rows), none), np.full(len(rows), -none)
    for r in range(side + 1):
        at = np.flatnonzero(inside[:, r])
        if len(at) < 2:
            continue
        order = at[np.argsort(names[at, r], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], names[order[1:], r] != names[order[:-1], r]]))
        low, high = np.minimum.reduceat(doc[order], starts), np.maximum.reduceat(doc[order], starts)
        sizes = np.diff(np.append(starts, len(order)))
        several = np.repeat(low != high, sizes)
        hit = order[several]
        first[hit], last[hit] = np.minimum(first[hit], np.repeat(low, sizes)[several]), np.maximum(last[hit], np.repeat(high, sizes)[several])
        reach[0, hit] = np.maximum(reach[0, hit], side - r)
        reach[1, hit] = np.maximum(reach[1, hit], r)
    found = np.flatnonzero(reach[0] >= 0)
    other = np.where(first[found] != doc[found], first[found], last[found])
    return rows[found], reach[0, found], reach[1, found], other


def _suffixes(docs: DataFrame, wanted, hot, side: int) -> DataFrame:
    """Suffixes whose key is in ``wanted`` and not in ``hot``, with contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = []
            for i, words, at, grams in _kept(batch.column(1)):
                here = wanted.value.holds(grams)
                if hot is not None:
                    here &= ~hot.value.holds(grams)
                if here.any():
                    found.append((grams[here], np.full(int(here.sum()), ids[i]), at[here], _contexts(words, at[here], side)))
            if found:
                grams, names, at, contexts = (np.concatenate(x) for x in zip(*found, strict=True))
                yield from common.sliced(pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(names), pa.array(at.astype(np.int32)), _packed(contexts)], names=["key", "doc_id", "pos", "context"]))

    return common.arrow_map(_source(docs), run, _SUFFIX)


def _compared(side: int):
    """Reads suffixes sorted by key, some whole keys at a time, and gives spans."""

    def spans(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, pos = (np.concatenate([b.column(k).to_numpy() for b in part]) for k in range(3))
        contexts = np.concatenate([_unpacked(b.column(3), side) for b in part])
        rows, left, right, other = matches(key.view(np.uint64), doc, contexts)
        if len(rows):
            start, end = (pos[rows] - left).astype(np.int32), (pos[rows] + KEY_WORDS + right).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(start), pa.array(end), pa.array(other)], names=["doc_id", "start", "end", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                names = batch.column(0).to_numpy()
                if held[0].column(0)[0].as_py() == names[-1]:
                    continue  # all of one key so far
                cut = int(np.searchsorted(names, names[-1]))
                if not cut:  # the last key began before this batch
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    names, batch, held = whole.column(0).to_numpy(), whole, [whole]
                    cut = int(np.searchsorted(names, names[-1]))
                yield from spans([*held[:-1], batch.slice(0, cut)])
                held, n = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from spans(held)

    return run


def _hot_spans(docs: DataFrame, hot, side: int, scratch: common.Scratch) -> DataFrame:
    """Spans of the keys in ``hot``: cuts of several documents by a groupBy, joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = []
            for i, words, at, grams in _kept(batch.column(1)):
                here = hot.value.holds(grams)
                if here.any():
                    names, inside = cuts(grams[here], _contexts(words, at[here], side), side)
                    row, r = np.nonzero(inside)
                    found.append((names[row, r].view(np.int64), np.full(len(row), ids[i]), (at[here][row] - (side - r)).astype(np.int32)))
            if found:
                yield from common.sliced(pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["cut", "doc_id", "start"]), 10_000)

    every = scratch.save(common.arrow_map(_source(docs), run, _CUT))
    several = scratch.save(every.groupBy("cut").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).filter("a <> b"))
    # cuts that very many documents hold are few; they go to the rows, not the rows to them
    often, seldom = several.filter(F.col("n") > HOT), several.filter(F.col("n") <= HOT)
    many = often.limit(_MOST_BROADCAST + 1).count()
    if many <= _MOST_BROADCAST:
        common_ones = F.broadcast(often)
        found = every.join(common_ones, "cut").unionByName(every.join(F.broadcast(often.select("cut")), "cut", "left_anti").join(seldom, "cut"))
    else:
        found = every.join(several, "cut")
    other = F.when(F.col("a") != F.col("doc_id"), F.col("a")).otherwise(F.col("b"))
    found = found.select("doc_id", "start", (F.col("start") + F.lit(side + KEY_WORDS)).cast("int").alias("end"), other.alias("other"))
    return found.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))


def find(docs: DataFrame, least_words: int = LEAST_WORDS, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, start, end, n_words, other_doc, is_first for each repeated span (in words, end exclusive).

    other_doc is the smallest other id that a comparison of the span's parts gave; is_first tells that the
    document's own id is smaller than that.  Parts of one span may have other first holders; :func:`lost` goes by parts.
    """
    if least_words < KEY_WORDS + WINDOW - 1:
        raise ValueError(f"passages under {KEY_WORDS + WINDOW - 1} words may hold no kept place")
    scratch, side = scratch or common.Scratch(docs.sparkSession), least_words - KEY_WORDS
    context = docs.sparkSession.sparkContext
    shared = scratch.save(keys(docs))
    total, often = shared.agg(F.count("*"), F.count_if(F.col("n") > HOT)).collect()[0]
    wanted = context.broadcast(key_set(shared, total))
    hot = context.broadcast(key_set(shared.filter(F.col("n") > HOT), often)) if often else None
    kept = _suffixes(docs, wanted, hot, side).repartition("key").sortWithinPartitions("key")
    spans = scratch.save(kept.mapInArrow(_compared(side), _SPAN))
    scratch.drop(shared)
    if hot is not None:
        spans = spans.unionByName(scratch.save(_hot_spans(docs, hot, side, scratch)))
        hot.destroy()
    wanted.destroy()
    earlier = W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int")
    place = W.partitionBy("doc_id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)
    once = spans.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))
    merged = once.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(place)).groupBy("doc_id", "span")
    merged = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other_doc"))
    return merged.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other_doc", (F.col("other_doc") > F.col("doc_id")).alias("is_first"))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lost(docs: DataFrame, spans: DataFrame, least_words: int = LEAST_WORDS, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id and __repeats_spans, the (start, end) of words that repeat passages first held by documents of smaller id.

    Every run of ``least_words`` words inside the spans is counted by its 128-bit hash, so its
    first holder is known.  Words of runs that a document is the first to hold stay, so each
    passage stays whole in its first holder; words of other runs go.  The first holders join back
    by hash and id, so that runs which very many documents hold spread over tasks.
    """
    scratch = scratch or common.Scratch(docs.sparkSession)
    inside = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__repeats_spans")).withColumnRenamed("doc_id", "__repeats_id")
    held = docs.select("doc_id", F.col("text").alias("__text")).join(inside, F.col("doc_id") == F.col("__repeats_id")).drop("__repeats_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            offsets, data = text_buffers(batch.column(1))
            for c in word_chunks(offsets, data):
                for d, (lo, hi) in enumerate(zip(c.bounds, c.bounds[1:], strict=False)):
                    words = c.hashes[lo:hi]
                    for s in at[c.first + d]:
                        part = words[s["start"] : s["end"]]
                        if len(part) < least_words:
                            continue
                        whole, half = ngram_hashes(part, least_words), ngram_hashes(part, least_words // 2)[: len(part) - least_words + 1]
                        places = np.arange(s["start"], s["start"] + len(whole), dtype=np.int32)
                        rows = [pa.array(whole.view(np.int64)), pa.array(half.view(np.int64)), pa.array(np.full(len(whole), ids[c.first + d])), pa.array(places)]
                        yield from common.sliced(pa.RecordBatch.from_arrays(rows, names=["a", "b", "doc_id", "at"]), 10_000)

    runs = scratch.save(common.arrow_map(held, run, "a long, b long, doc_id long, at int"))
    first = runs.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") < F.max("doc_id")).alias("own"))  # not own: a run across passages that no other document holds
    marked = runs.join(first, ["a", "b", "doc_id"], "left").groupBy("doc_id")
    marked = marked.agg(*[F.sort_array(F.collect_list(F.when(which, F.col("at")))).alias(name) for name, which in (("stay", F.col("own")), ("go", F.col("own").isNull()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for stay, go in zip(batch.column("stay").to_pylist(), batch.column("go").to_pylist(), strict=True):
                gone = np.zeros(max(stay + go, default=0) + least_words + 1, dtype=np.int8)
                for at in go:
                    gone[at : at + least_words] = 1
                for at in stay:
                    gone[at : at + least_words] = 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
                found.append([{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "__repeats_spans"])

    return common.arrow_map(marked, cut, "doc_id long, __repeats_spans array<struct<start:int,end:int>>").filter(F.size("__repeats_spans") > 0)


def strip(docs: DataFrame, spans: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns, the text without words of passages that a document of smaller id holds first (:func:`lost`).  Rows that repeat an id lose what any of them loses; a null id loses nothing."""
    cut = lost(docs, spans, least_words).withColumnRenamed("doc_id", "__repeats_id")
    joined = docs.join(cut, F.col("doc_id") == F.col("__repeats_id"), "left").drop("__repeats_id")
    names, place = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, found in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if found and texts[i]:
                    at = [(m.start(), m.end()) for m in _WORD.finditer(texts[i])]
                    for s in reversed(found):
                        if s["start"] >= len(at):
                            continue
                        lo, hi = at[s["start"]][0], at[min(s["end"], len(at)) - 1][1]
                        texts[i] = texts[i][:lo] + texts[i][hi:]
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.arrow_map(joined, run, docs.schema)
