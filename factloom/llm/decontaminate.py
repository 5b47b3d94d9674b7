"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages, weighted by TF-IDF (document frequencies over all
documents) and reduced by a distributed randomised SVD, one latent space for the whole
benchmark.  Every document is read in windows that begin 8 words apart and are as long as the
passage and 7 words more, so that one holds the passage wherever it stands.  A window of n
words that holds a share s of a passage's L words has a cosine of about s sqrt(L / n) with it; windows
that reach ``closeness`` of that for ``paraphrase_share`` are candidates.  So is every place of
a document that holds five words in a row of an item, so that no copy hangs on the latent
space.  Candidates of whose words too few are in the document at all are out.  A candidate
counts as a ``copy`` when the longest common subsequence of words covers ``copy_share`` of the
item, and as a ``paraphrase`` when it covers ``paraphrase_share`` and the item's answer is
there too: the words of column ``answer`` where the benchmark has one, else the item's rarest
words.

Words in over a tenth of the documents, or of the items and in over 20 of them, serve for
subsequences but not for latent retrieval, unless over half of an item's words are such.  Case, punctuation and word breaks of any kind don't count.  Defined results: documents with
null or empty text match nothing; items with fewer than ``least_words`` words take no part;
repeated items and rows each count; a very long text is read whole, some 0.5 MB of documents or
one of them at a time; of equally long subsequences that of the larger answer share counts, then
the later one; an empty benchmark finds nothing; other columns are
ignored by :func:`find` and kept by :func:`clean`.

The benchmark goes round in blocks of about ``BLOCK_ITEMS`` items, as many of them in one
reading of the documents as ``MOST_BYTES`` hold: what is broadcast is bounded however large
the benchmark is, and what is found doesn't hang on the blocks.  The driver holds the
benchmark's word hashes, their document frequencies (counted once) and the latent space: for
each distinct word as many numbers as there are passages, ``MOST_RANK`` at most and fewer
(16 at least) where ``SPACE_BYTES`` wouldn't hold them all.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import mix64, ngram_hashes, text_buffers, word_chunks

BLOCK_ITEMS = 2000
MOST_BYTES = 200_000_000  # of indexes that a task holds at once
SPACE_BYTES = 200_000_000  # of word vectors, besides
STOP_SHARE, MANY_ITEMS = 0.1, 20  # words in more of the documents, or of the items and in so many, aren't retrieved by
SEED_WORDS = 5
STRIDE, LONGEST = 8, 8  # windows of up to LONGEST strides
PASSAGE = 32  # words of a passage of an item that is longer than the longest window
MOST_RANK = 160
_BITS = 20

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NOTHING = int(mix64(np.zeros(1, dtype=np.uint64))[0])


def _documents(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, word hashes, bounds) in chunks; lower case, letters and digits only, words without any left out."""
    offsets, data = text_buffers(pc.utf8_lower(pc.fill_null(column, "")))
    for c in word_chunks(offsets, data, lower=False, keep=_LETTERS):
        real = c.hashes != np.uint64(_NOTHING)
        upto = np.concatenate([[0], np.cumsum(real)])
        yield c.first, c.hashes[real], upto[c.bounds]


class Vocabulary:
    """Sorted word hashes, looked up through a bitmap first."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.unique(words)
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.words >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``words``, their index here) of the words that are known."""
        at = np.flatnonzero(self.bitmap[(words >> np.uint64(64 - _BITS)).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.words, words[at]), len(self.words) - 1)
        same = self.words[index] == words[at]
        return at[same], index[same]


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]
    counts: Counter[int] = field(default_factory=Counter)

    def __post_init__(self) -> None:
        self.counts.update(self.words)


@dataclass
class Index:
    """A block of benchmark items in the benchmark's latent space."""

    vocabulary: Vocabulary  # of the whole benchmark, as are its vectors: all blocks have the same ones
    vectors: np.ndarray  # of each word: its idf times its row of V; then a zero one
    items: list[Item]
    owner: np.ndarray  # item of each passage
    passages: np.ndarray  # unit latent vectors
    spans: np.ndarray  # strides of each passage's windows
    least_cosines: np.ndarray
    item_words: Vocabulary  # all words of the items and their answers
    item_bounds: np.ndarray  # of each item's stretch in the next one
    item_places: np.ndarray  # its words, as indexes of item_words
    answer_bounds: np.ndarray  # the same of its answer
    answer_places: np.ndarray
    seeds: Vocabulary  # runs of SEED_WORDS words of the items
    seed_bounds: np.ndarray  # of each seed's stretch in the next two
    seed_items: np.ndarray
    seed_places: np.ndarray  # words before the seed in its item
    copy_share: float
    paraphrase_share: float
    answer_share: float

    def blocks(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, sum of word vectors) of each stride."""
        lengths = np.diff(bounds)
        per = -(-lengths // STRIDE)
        base = np.concatenate([[0], np.cumsum(per)])
        document = np.repeat(np.arange(len(lengths)), per)
        first = (np.arange(base[-1]) - base[:-1][document]) * STRIDE
        at, index = self.vocabulary.find(words)
        owner = np.searchsorted(bounds, at, side="right") - 1
        places = np.full(base[-1] * STRIDE, len(self.vectors) - 1)  # the last vector is zero
        places[base[owner] * STRIDE + at - bounds[owner]] = index
        sums = np.zeros((base[-1], self.vectors.shape[1]), dtype=np.float32)
        for column in places.reshape(-1, STRIDE).T:
            sums += self.vectors[column]
        return document, first, sums

    def near(self, bounds: np.ndarray, document: np.ndarray, first: np.ndarray, sums: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(document, item, first word, cosine) of windows near a passage, in arrays; the last three arguments are what :meth:`blocks` gives."""
        lengths, total, done = np.diff(bounds), sums.copy(), 1
        for span in sorted(set(self.spans.tolist())):
            for k in range(done, span):
                total[:-k] += sums[k:]
                across = np.flatnonzero(document[k:] != document[:-k])  # few: taken back
                total[across] -= sums[across + k]
            done = max(done, span)
            useful = (first == 0) | (first + (span - 1) * STRIDE < lengths[document])  # later ones only hold the end once more
            norms, which = np.sqrt(np.einsum("ij,ij->i", total, total)), np.flatnonzero(self.spans == span)
            useful &= norms > 1e-6
            for lo in range(0, len(total), 8192):
                cosines = total[lo : lo + 8192] @ self.passages[which].T
                cosines /= np.maximum(norms[lo : lo + 8192, None], 1e-6)
                i, j = np.nonzero((cosines >= self.least_cosines[which]) & useful[lo : lo + 8192, None])
                yield document[lo + i], self.owner[which[j]], first[lo + i], cosines[i, j]

    def size(self) -> int:
        return sum(x.nbytes for x in (self.passages, self.seeds.words, self.seed_items, self.seed_places, self.item_places)) + 200 * sum(len(i.words) for i in self.items)

    def enough(self, there: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Which items can match where the words are that ``there`` flags: as many words as a copy needs, or as a paraphrase needs and the answer."""
        words, sizes = _held(there, items, self.item_bounds, self.item_places)
        answers, wanted = _held(there, items, self.answer_bounds, self.answer_places)
        return (words >= self.copy_share * sizes - 1e-9) | (words >= self.paraphrase_share * sizes - 1e-9) & (answers >= self.answer_share * np.maximum(wanted, 1) - 1e-9)

    def candidates(self, words: np.ndarray, bounds: np.ndarray, sums: tuple[np.ndarray, ...]) -> Iterator[tuple[int, int, list[tuple[float, int]]]]:
        """(document, item, (cosine or -1, first word) of each place to look at).

        Items of whose words too few are in the document are out; of those that hold a run of the document, those
        of whose words too few are near it, so a run that very many items hold costs a count of their words.
        """
        near = [np.concatenate(x) for x in zip(*self.near(bounds, *sums), strict=True)] if len(self.passages) else []
        document, item, first, cosine = near or [np.zeros(0, dtype=np.int64)] * 4
        order = np.argsort(document, kind="stable")
        document, item, first, cosine = document[order], item[order], first[order], cosine[order]
        at, run = self.seeds.find(ngram_hashes(words, SEED_WORDS))
        owner = np.searchsorted(bounds, at, side="right") - 1
        inside = at + SEED_WORDS <= bounds[owner + 1]
        at, run, owner = at[inside], run[inside], owner[inside]
        known, index = self.item_words.find(words)
        flags = np.zeros(len(self.item_words), dtype=bool)

        def among(items: np.ndarray, lo: int, hi: int) -> np.ndarray:
            mine = index[slice(*np.searchsorted(known, [lo, hi]))]
            flags[mine] = True
            found = self.enough(flags, items)
            flags[mine] = False
            return found

        for d in np.union1d(document, owner).tolist():
            lo, hi = np.searchsorted(document, [d, d + 1])
            a, b = np.searchsorted(owner, [d, d + 1])
            stretches = {r: np.arange(self.seed_bounds[r], self.seed_bounds[r + 1]) for r in np.unique(run[a:b]).tolist()}
            items = np.unique(np.concatenate([item[lo:hi], *(self.seed_items[x] for x in stretches.values())]))
            kept = items[among(items, bounds[d], bounds[d + 1])]
            if not len(kept):
                continue
            places: dict[int, list[tuple[float, int]]] = {}
            for i in lo + np.flatnonzero(np.isin(item[lo:hi], kept)):
                places.setdefault(int(item[i]), []).append((float(cosine[i]), int(first[i])))
            stretches = {r: x[np.isin(self.seed_items[x], kept)] for r, x in stretches.items()}
            for s, r in zip((at[a:b] - bounds[d]).tolist(), run[a:b].tolist(), strict=True):
                some = stretches[r]
                if len(some) > 1:
                    longest = int((self.item_bounds[self.seed_items[some] + 1] - self.item_bounds[self.seed_items[some]]).max())
                    some = some[among(self.seed_items[some], max(bounds[d], bounds[d] + s - 2 * longest), min(bounds[d + 1], bounds[d] + s + 2 * longest + STRIDE * (LONGEST + 1)))]
                for k, before in zip(self.seed_items[some].tolist(), self.seed_places[some].tolist(), strict=True):
                    places.setdefault(k, []).append((-1.0, max(0, s - before)))
            yield from ((d, k, found) for k, found in places.items())

    def matches(self, words: np.ndarray, bounds: np.ndarray, sums: tuple[np.ndarray, ...] | None = None) -> list[tuple[int, int, float | None, float, float, int, int]]:
        """(document, item, cosine, overlap, answer share, first word, end) of what is found; without a cosine if only equal words led there."""
        out = []
        for d, k, found in self.candidates(words, bounds, self.blocks(words, bounds) if sums is None else sums):
            cosine, item = max(c for c, _ in found), self.items[k]
            window = STRIDE * strides(len(item.words))
            shares, tried_to = (0.0, 0.0, 0, 0), -1
            for start in sorted(s for _, s in found):  # each stretch of windows once
                if start < tried_to:
                    continue
                lo = max(bounds[d], bounds[d] + start - len(item.words))
                hi = min(bounds[d + 1], bounds[d] + start + window + len(item.words))
                tried_to = start + window
                region = words[lo:hi].tolist()
                inside = set(region)
                most = sum(map(item.counts.__getitem__, item.counts.keys() & inside)) / len(item.words)  # as long as a subsequence can get
                answer = sum(w in inside for w in item.answer) / max(1, len(item.answer))
                if most < self.copy_share and (most < self.paraphrase_share or answer < self.answer_share):
                    continue
                overlap, a, b = common_subsequence(item.words, region)
                shares = max(shares, (overlap / len(item.words), answer, int(lo - bounds[d]) + a, int(lo - bounds[d]) + b))
            if shares[0] >= self.copy_share or shares[0] >= self.paraphrase_share and shares[1] >= self.answer_share:
                out.append((d, k, cosine if cosine >= 0 else None, *shares))
        return out


def _held(there: np.ndarray, items: np.ndarray, bounds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many of each item's words are ``there``, how many it has)."""
    sizes = bounds[items + 1] - bounds[items]
    ends = np.cumsum(sizes)
    at = np.repeat(bounds[items] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
    sums = np.concatenate([[0], np.cumsum(there[places[at]])])
    return sums[ends] - sums[ends - sizes], sizes


def strides(words: int) -> int:
    """Strides of a window that holds so many words wherever they stand; of a long item's passages, if it is cut into these."""
    return -(-((words if words <= STRIDE * LONGEST - STRIDE + 1 else PASSAGE) + STRIDE - 1) // STRIDE)


def common_subsequence(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """(length of the longest common subsequence, first and end place in ``b`` of words of ``a``'s span); bit-parallel."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, first, end, length = full, 0, 0, 0
    for j, w in enumerate(b):
        hit = places.get(w, 0)
        if hit:
            row = (row + (row & hit) | row & ~hit) & full
            now = len(a) - row.bit_count()
            if now > length:
                first, end, length = (j if not length else first), j + 1, now
    return length, first, end


def _idf(documents: DataFrame, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Inverse document frequencies of the vocabulary over all documents, and which are stop words; tasks send one sum for each word."""
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        sums, seen = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            seen += batch.num_rows
            for _, words, bounds in _documents(batch.column(0)):
                at, index = vocabulary.find(words)
                owner = np.searchsorted(bounds, at, side="right") - 1
                pairs = np.unique(owner * len(vocabulary) + index)
                sums += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some], pa.int64()), pa.array([seen, *sums[some]], pa.int64())], names=["word", "n"])

    found = common.arrow_map(documents.select("text"), count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    n = dict(zip(found["word"], found["n"], strict=True))
    counts = np.array([n.get(i, 0) for i in range(len(vocabulary))], dtype=float)
    return np.log((1.0 + n.get(-1, 0)) / (1.0 + counts)) + 0.05, counts > STOP_SHARE * n.get(-1, 0)


def randomised_svd(rows: DataFrame, width: int, rank: int, powers: int = 2, seed: int = common.SEED) -> np.ndarray:
    """The leading right singular vectors (width x rank) of a matrix whose sparse rows are (places array<int>, weights array<double>).

    Halko, Martinsson and Tropp's method on A'A: each pass multiplies row by row where the
    rows are and sums the (width x rank) matrix's rows that each batch touches.
    """
    spark = rows.sparkSession
    size = min(width, rank + 10)

    def passed(basis: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:  # the rows that a batch touches, some thousands
                flat = batch.column(0).flatten().to_numpy()
                touched, local = np.unique(flat, return_inverse=True)
                part, at = np.zeros((len(touched), basis.shape[1])), 0
                for weights in batch.column(1).to_pylist():
                    weights, mine = np.asarray(weights), local[at : at + len(weights)]
                    part[mine] += weights[:, None] * (weights @ held.value[touched[mine]])[None, :]
                    at += len(weights)
                yield pa.RecordBatch.from_pydict({"places": pa.array([touched.astype(np.int32).tobytes()], pa.binary()), "part": pa.array([part.tobytes()], pa.binary())})

        total = np.zeros_like(basis)
        for r in common.arrow_map(rows, multiply, "places binary, part binary").toLocalIterator():  # one partition at a time
            total[np.frombuffer(r["places"], dtype=np.int32)] += np.frombuffer(r["part"]).reshape(-1, basis.shape[1])
        held.destroy()
        return total

    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    for _ in range(powers):
        basis = np.linalg.qr(passed(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ passed(basis))
    order = np.argsort(values)[::-1][:rank]
    return basis @ turn[:, order[values[order] > 1e-9]]


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, words, bounds in _documents(pa.array(texts, pa.string())):
        out += [words[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
    return out


@dataclass
class Block:
    """Word hashes of some benchmark items, and of their answers."""

    ids: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]


def blocks(benchmark: DataFrame, least_words: int = 5) -> list[Block]:
    """The benchmark in parts by a hash of id and text, without items that are too short; the driver holds its words' hashes."""
    columns = [c for c in ("item_id", "text", "answer") if c in benchmark.columns]
    items = benchmark.select(*columns)
    n = items.count()
    parts = 1 if n <= BLOCK_ITEMS else -(-2 * n // BLOCK_ITEMS)
    out = []
    for k in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy(*columns).collect()
        words = _hashes([r["text"] for r in rows])
        answers = _hashes([r["answer"] for r in rows]) if "answer" in columns else [np.zeros(0, dtype=np.uint64)] * len(rows)
        kept = [i for i, w in enumerate(words) if len(w) >= least_words]
        if kept:
            out.append(Block([rows[i]["item_id"] for i in kept], [words[i] for i in kept], [answers[i] for i in kept]))
    return out


@dataclass
class Space:
    """The latent space of a benchmark: for each of its words the weight, whether passages leave it out, and its row of V."""

    words: Vocabulary
    idf: np.ndarray
    stop: np.ndarray
    leading: np.ndarray
    used: Vocabulary | None = None  # words of passages: without stop words, but for items that have few others
    vectors: np.ndarray | None = None

    def passages(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(words, weights to norm 1, length) of each passage of an item."""
        index = self.words.find(words)[1]
        telling = ~self.stop[index]
        index = index[telling] if 2 * int(telling.sum()) >= len(index) else index
        whole = len(words) <= STRIDE * LONGEST - STRIDE + 1
        for lo in [0] if whole or len(index) <= PASSAGE else range(0, max(1, len(index) - PASSAGE // 2), PASSAGE // 2):
            part = index if whole else index[lo : lo + PASSAGE]
            places, times = np.unique(part, return_counts=True)
            weights = times * self.idf[places]
            yield places, weights / np.linalg.norm(weights), len(words) if whole else PASSAGE


def latent_space(parts: list[Block], documents: DataFrame, rank: int | None = None) -> Space:
    """The space of all passages of all blocks: document frequencies over the documents, then a randomised SVD."""
    spark, known = documents.sparkSession, Vocabulary(np.unique(np.concatenate([w for b in parts for w in b.words])))
    idf, stop = _idf(documents, known)
    items = [np.unique(known.find(w)[1]) for b in parts for w in b.words]
    shared = np.bincount(np.concatenate(items), minlength=len(known))
    space = Space(known, idf, stop | (shared > max(MANY_ITEMS, STOP_SHARE * len(items))), np.zeros((len(known), 0)))
    rows = [(p, w) for b in parts for words in b.words for p, w, _ in space.passages(words)]
    matrix = spark.createDataFrame([(p.tolist(), w.tolist()) for p, w in rows], "places array<int>, weights array<double>").repartition(max(1, len(rows) // 100))
    used = np.unique(np.concatenate([p for p, _ in rows]))
    rank = rank or max(16, min(MOST_RANK, len(rows), SPACE_BYTES // (4 * len(used))))
    space.leading = randomised_svd(matrix, len(known), rank)
    space.used, space.vectors = Vocabulary(known.words[used]), np.concatenate([space.idf[used, None] * space.leading[used], np.zeros((1, space.leading.shape[1]))]).astype(np.float32)
    return space


def index_block(block: Block, space: Space, closeness: float, **limits: float) -> Index:
    """The index of one block in the benchmark's latent space."""
    items, owner, passages, spans, least, seeds = [], [], [], [], [], []
    for item_id, words, answer in zip(block.ids, block.words, block.answers, strict=True):
        index = space.words.find(words)[1]
        rare = [w for _, w in sorted({(-space.idf[i], int(w)) for i, w in zip(index, words, strict=True)})]
        items.append(Item(item_id, words.tolist(), answer.tolist() or rare[: max(3, len(rare) // 4)]))
        grams = ngram_hashes(words, SEED_WORDS)
        seeds.append(np.column_stack([grams, np.full(len(grams), len(items) - 1, dtype=np.uint64), np.arange(len(grams), dtype=np.uint64)]))
        for places, weights, length in space.passages(words):
            passages.append((places, weights))
            owner.append(len(items) - 1)
            spans.append(strides(len(words)))
            least.append(closeness * limits["paraphrase_share"] * (length / (STRIDE * spans[-1])) ** 0.5)
    latent = np.stack([w @ space.leading[p] for p, w in passages])
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    sown = np.concatenate(seeds)
    sown = sown[np.lexsort((sown[:, 2], sown[:, 1], sown[:, 0]))]
    runs = Vocabulary(sown[:, 0])
    answers = [np.array(i.answer, dtype=np.uint64) for i in items]
    held, bounds = Vocabulary(np.concatenate([*block.words, *answers])), lambda lists: np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return Index(
        space.used, space.vectors, items, np.array(owner), latent.astype(np.float32), np.array(spans), np.array(least, dtype=np.float32),
        held, bounds(block.words), np.concatenate([held.find(w)[1] for w in block.words]), bounds(answers), np.concatenate([held.find(w)[1] for w in answers]),
        runs, np.append(np.searchsorted(sown[:, 0], runs.words), len(sown)), sown[:, 1].astype(np.int64), sown[:, 2].astype(np.int64), **limits,
    )


def indexes(documents: DataFrame, benchmark: DataFrame, rank: int | None = None, least_words: int = 5, closeness: float = 0.8, copy_share: float = 0.75, paraphrase_share: float = 0.55, answer_share: float = 0.6) -> Iterator[list[Index]]:
    """Lists of indexes, each list for one reading of the documents."""
    some = blocks(benchmark, least_words)
    if not some:
        return
    space = latent_space(some, documents, rank)
    held: list[Index] = []
    for b in some:
        found = index_block(b, space, closeness, copy_share=copy_share, paraphrase_share=paraphrase_share, answer_share=answer_share)
        if held and sum(x.size() for x in held) + found.size() > MOST_BYTES:
            yield held
            held = []
        held.append(found)
    yield held


def find(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, kind, cosine, overlap, answer_share, start, end (words) for each document and item that match."""
    spark = documents.sparkSession
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, item_id long, kind string, cosine double, overlap double, answer_share double, start int, end int"
    source = documents.select("doc_id", F.col("text").alias("__text"))
    out = None
    for part in indexes(documents, benchmark, **options):
        held = spark.sparkContext.broadcast(part)  # at most MOST_BYTES, or one block

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = []
                for first, words, bounds in _documents(batch.column(1)):
                    sums = held.value[0].blocks(words, bounds)
                    for index in held.value:
                        found += [(first + d, index.items[k].item_id, *rest) for d, k, *rest in index.matches(words, bounds, sums)]
                taken = pa.array([f[0] for f in found], pa.int64())
                kinds = ["copy" if f[3] >= held.value[0].copy_share else "paraphrase" for f in found]
                columns = [batch.column(0).take(taken), pa.array([f[1] for f in found], pa.int64()), pa.array(kinds, pa.string())]
                columns += [pa.array([f[i] for f in found], pa.float64()) for i in (2, 3, 4)] + [pa.array([f[i] for f in found], pa.int32()) for i in (5, 6)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "kind", "cosine", "overlap", "answer_share", "start", "end"])

        rows = common.arrow_map(source, run, schema)
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], schema) if out is None else out


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    place = documents.columns.index("text")
    out = documents
    for part in indexes(documents, benchmark, **options):
        held = documents.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                for first, words, bounds in _documents(batch.column(place)):
                    sums = held.value[0].blocks(words, bounds)
                    for index in held.value:
                        for d, *_ in index.matches(words, bounds, sums):
                            keep[first + d] = False
                yield batch.filter(pa.array(keep))

        out = common.arrow_map(out, run, documents.schema)
    return out
