"""Vectorised word and shingle hashing over Arrow string columns.

Words are the maximal runs of ``[^\\x20\\x09-\\x0D]``; both classes are ASCII, so the
split is exact on UTF-8 bytes.  All functions work on whole texts and on chunks of
documents of bounded size, with no Python loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK_BYTES = 1 << 19

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        size = max(n, _CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            factors = np.full(size, base, dtype=np.uint64)
            factors[0] = 1
            _POWERS[name] = np.multiply.accumulate(factors)
    return _POWERS["up"], _POWERS["down"]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Words:
    """Words of a run of documents: hashes, byte starts and ends, and per-document bounds."""

    __slots__ = ("bounds", "ends", "first", "hashes", "starts")

    def __init__(self, first: int, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> None:
        self.first, self.hashes, self.starts, self.ends, self.bounds = first, hashes, starts, ends, bounds


def word_chunks(offsets: np.ndarray, data: np.ndarray, lower: bool = True, keep: np.ndarray | None = None) -> Iterator[Words]:
    """Words of every document, some documents at a time (about 0.5 MB, or one longer document).

    ``keep`` is an optional table of 256 flags; other bytes don't count towards a word's hash.
    """
    n, k = len(offsets) - 1, 0
    while k < n:
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + _CHUNK_BYTES, side="right")) - 1)
        yield _words(k, offsets[k : to + 1], data, lower, keep)
        k = to


def _words(first: int, offsets: np.ndarray, data: np.ndarray, lower: bool, keep: np.ndarray | None) -> Words:
    text = data[offsets[0] : offsets[-1]]
    local = offsets - offsets[0]
    if lower:
        text = _LOWER[text]
    inside = ~_IS_SPACE[text]
    before = np.empty(len(text) + 1, dtype=bool)  # whether a word is open before each byte
    before[0] = before[-1] = False
    np.copyto(before[1:-1], inside[:-1]) if len(text) else None
    cut = np.zeros(len(text) + 1, dtype=bool)
    cut[local] = True
    opens = inside & (~before[:-1] | cut[:-1])
    starts = np.flatnonzero(opens)
    after = np.empty(len(text), dtype=bool)
    if len(text):
        after[:-1] = inside[1:]
        after[-1] = False
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    up, down = _powers(len(text) + 1)
    values = text.astype(np.uint64) + np.uint64(1)
    if keep is not None:
        values *= keep[text]
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(text)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts])
    bounds = np.searchsorted(starts, local)
    return Words(first, hashes, starts, ends, bounds)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of ``n`` words (empty when there are fewer)."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for i in range(n):
        out = (out + words[i : i + count]) * np.uint64(_BASE) + np.uint64(i + 1)
    return mix64(out)


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle, no words none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(ngram_hashes(words, min(n, len(words))) ^ np.uint64(len(words) if len(words) < n else 0))
