"""Language identification with hyperdimensional profiles.

Every letter owns a random bipolar vector.  A trigram binds its letters: the product of
the first letter's vector permuted twice, the second's permuted once and the third's.  A
text bundles (sums) its trigrams, a language prototype bundles the unit vectors of its
training texts, and a text goes to the language whose prototype has the largest cosine.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null
``lang`` isn't learned from; ties of cosines go to the smaller language name; an empty
table, or one with nothing to learn from, gives ``und`` rows; repeated rows are judged
alike; extra columns are kept by :func:`accepted` and ignored otherwise.  A text takes some 80
bytes of memory for each character, whatever its alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNDETERMINED = "und"
_SPACE = 32
_CHUNK_CHARS = 400_000
_CELLS = 3_000_000
_GRAMS = 16_384  # distinct trigrams whose vectors are held at once
_LETTERS: list[np.ndarray] = []
#: A text of very many letters needs the cosine ``CEILING``, one of ``HALF`` letters the square root of half of it.
CEILING, HALF = 0.16, 60.0


@dataclass(frozen=True)
class Encoder:
    """Random letter vectors and the encoding of texts."""

    dimensions: int = 1024
    seed: int = common.SEED
    cache: dict[int, np.ndarray] = field(default_factory=dict, compare=False, repr=False)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.cache:
            if len(self.cache) > 60_000:
                self.cache.clear()
            self.cache[code] = np.random.default_rng((self.seed, code)).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.cache[code]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(hypervectors, whether there is a letter) of some texts."""
        codes, owner, lettered = _letter_runs(texts)
        out = np.zeros((len(texts), self.dimensions), dtype=np.float32)
        if len(codes) < 3:
            return out, lettered
        present = np.zeros(int(codes.max()) + 1, dtype=bool)
        present[codes] = True
        alphabet = np.flatnonzero(present)
        small = (np.cumsum(present) - 1)[codes]
        a, b, c = small[:-2], small[1:-1], small[2:]
        whole = codes[1:-1] != _SPACE  # a gap in the middle would join two words
        size = np.int64(len(alphabet))
        keys = ((a * size + b) * size + c)[whole]
        owner = owner[1:-1][whole]
        if size**3 <= 20_000_000:
            seen = np.zeros(size**3, dtype=bool)
            seen[keys] = True
            grams = np.flatnonzero(seen)
            place = np.zeros(size**3, dtype=np.int64)
            place[grams] = np.arange(len(grams))
            index = place[keys]
        else:
            grams, index = np.unique(keys, return_inverse=True)
        vectors = np.stack([self.letter(int(x)) for x in alphabet])
        once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
        for g in range(0, len(grams), _GRAMS):  # the vectors of some distinct trigrams at a time
            some = grams[g : g + _GRAMS]
            bound = (twice[some // (size * size)] * once[some // size % size] * vectors[some % size]).astype(np.float32)
            mine = slice(None) if len(grams) <= _GRAMS else np.flatnonzero((index >= g) & (index < g + len(some)))
            at, place = owner[mine], index[mine] - g
            step = max(1, _CELLS // len(some))
            for k in range(0, len(texts), step):
                lo, hi = np.searchsorted(at, [k, k + step])
                rows = min(step, len(texts) - k)
                counts = np.bincount((at[lo:hi] - k) * len(some) + place[lo:hi], minlength=rows * len(some))
                out[k : k + rows] += counts.reshape(rows, len(some)).astype(np.float32) @ bound
        return out, lettered


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _letter_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of lower-case letters with one space round every word, their text's number, and which texts have a letter."""
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letters = _letter_table()[codes]
    owner = np.repeat(np.arange(len(texts)), lengths)
    lettered = np.bincount(owner, weights=letters, minlength=len(texts)) > 0
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # the gap after a word
    keep[:-1] |= letters[1:]  # and the one before it
    codes = np.where(letters, codes, _SPACE)
    return codes[keep], owner[keep], lettered


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    k, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= _CHUNK_CHARS:
            yield k, i + 1
            k, total = i + 1, 0
    if k < len(texts):
        yield k, len(texts)


@dataclass(frozen=True)
class Profiles:
    """Prototypes by language, in order of name."""

    encoder: Encoder
    languages: list[str]
    prototypes: np.ndarray

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, cosine) of each text; the score is the softmax share of the best cosine."""
        plain = [t or "" for t in texts]
        names, scores, cosines = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        for lo, hi in _chunks(plain):
            vectors, lettered = self.encoder.encode(plain[lo:hi])
            if not self.languages:
                continue
            norms = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
            found = (vectors / norms) @ self.prototypes.T
            best = found.argmax(axis=1)
            share = np.exp(20.0 * (found - found.max(axis=1, keepdims=True)))
            share = share.max(axis=1) / share.sum(axis=1)
            for i in np.flatnonzero(lettered):
                names[lo + i] = self.languages[best[i]]
            scores[lo:hi] = np.where(lettered, share, 0.0)
            cosines[lo:hi] = np.where(lettered, found.max(axis=1), 0.0)
        return names, np.clip(scores, 0.0, 1.0), np.clip(cosines, 0.0, 1.0)


def fit(docs: DataFrame, training: Column, dimensions: int = 1024, most_per_language: int = 4000, most_languages: int = 5000) -> Profiles:
    """Prototypes from the rows where ``training`` holds.

    Learns from about ``most_per_language`` rows of each language, chosen by a hash of
    text id; a table with more than ``most_languages`` languages is an error, none is left
    out.  The driver gets one count and one vector for each of these.
    """
    encoder = Encoder(dimensions)
    known = docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.groupBy("lang").count()
    n = counts.limit(most_languages + 1).count()
    if n > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not n:
        return Profiles(encoder, [], np.zeros((0, dimensions), dtype=np.float32))
    share = F.broadcast(counts.select("lang", (F.lit(float(most_per_language)) / F.col("count")).alias("__share")))  # at most ``most_languages`` rows
    sample = known.select("doc_id", "lang", "text").join(share, "lang").filter(common.id_fraction("doc_id") < F.col("__share")).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for lo, hi in _chunks(texts):
                vectors, lettered = encoder.encode(texts[lo:hi])
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
                part = np.array(langs[lo:hi], dtype=object)
                for name in set(langs[lo:hi]):
                    sums[name] = sums.get(name, 0.0) + vectors[(part == name) & lettered].astype(np.float64).sum(axis=0)
        names = sorted(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()), "bundle": pa.array([sums[x].tobytes() for x in names], pa.binary())})

    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in sorted(frame["bundle"])], axis=0)  # sorted: sums don't hang on task order
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "bundle": [total.tobytes()]})

    rows = common.arrow_map(sample, bundle, "lang string, bundle binary").groupBy("lang").applyInPandas(combine, "lang string, bundle binary").collect()
    rows = sorted((r for r in rows if np.any(np.frombuffer(r["bundle"]))), key=lambda r: r["lang"])
    if not rows:
        return Profiles(encoder, [], np.zeros((0, dimensions), dtype=np.float32))
    prototypes = np.stack([np.frombuffer(r["bundle"]) for r in rows])
    prototypes = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-9)
    return Profiles(encoder, [r["lang"] for r in rows], prototypes.astype(np.float32))


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with lang_pred, score and cosine for every row."""
    common.no_clash(keep, ("lang_pred", "score", "cosine"))
    source = docs.select(*keep, F.col("text").alias("__text"))
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double", "cosine double"])
    held = docs.sparkSession.sparkContext.broadcast(profiles)  # one vector for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, cosines = held.value.judge(batch.column("__text").to_pylist())
            columns = [batch.column(f.name) for f in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "lang_pred", "score", "cosine"])

    return common.arrow_map(source, run, schema)


def needed_cosine(letters: int, ceiling: float = CEILING, half: float = HALF) -> float:
    """The cosine that a text with so many letters in its distinct words needs to count as one of a language.

    Texts of a language and letter junk of its script both gain cosine with the root of the
    number of their trigrams, until common trigrams come again; the bound lies between them at
    every length.  With few letters it falls to what chance gives (1 / sqrt(1024) = 0.03): too
    short a text to tell stays.
    """
    return ceiling * (letters / (letters + half)) ** 0.5


def accepted(docs: DataFrame, profiles: Profiles, ceiling: float = CEILING, half: float = HALF) -> DataFrame:
    """The rows, with all their columns, whose text has a language: not ``und``, and a cosine of at least :func:`needed_cosine`."""
    place = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def keeps(text: str | None, name: str, cosine: float) -> bool:
        if name == UNDETERMINED:
            return False
        return cosine >= ceiling or cosine >= needed_cosine(sum(map(str.isalpha, "".join(set(text.lower().split())))), ceiling, half)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            names, _, cosines = held.value.judge(texts)
            yield batch.filter(pa.array([keeps(*x) for x in zip(texts, names, cosines, strict=True)], pa.bool_()))

    return common.arrow_map(docs, run, docs.schema)


def identify(docs: DataFrame, training: Column, held_out: Column, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cosine for every document."""
    profiles = fit(docs.select("doc_id", "text", "lang"), training, **options)
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(marked, profiles, keep=("doc_id", "held_out"))
