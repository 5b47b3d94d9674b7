"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon gives each word a symbol: insult, threat, target, intent, negation, verb of
saying, quotation mark, other.  Five transducers read a clause's symbols, each for one
thing: whether a negation governs a hit, whether the words are reported (by a verb of saying
before or after them, or by quotation marks), whether a target stands near, on either side,
whether a threat is meant, and whether insults come in a row.  They are states and weighted
arcs; :func:`compose` makes one transducer of them, in which the weights of arcs that read a
word together are multiplied.  A clause scores the sum, over the one accepted path, of its
arcs' weights times its words' weights.  A text's score is a logistic function of its clause
scores, fitted to labelled rows; no word scores by itself.

Insult weights are a fixed seed lexicon in four languages and what labelled rows teach: words,
and stems of 4 to 6 letters (so inflected and compound forms count too), whose rate in toxic
rows is far above that in clean ones.  Terms are counted where the rows are; the driver gets
those that pass.  No label, language, source or id is an input of a score.

Defined results: null and empty texts score like a text without a match; labels that are
null, without a document, or repeated and at odds aren't learned from; of documents that repeat an id one
is learned from; without both classes to learn from, the seed lexicon and fixed coefficients
serve; repeated rows are scored alike; an empty table gives no rows; a text of any length is read
whole, clause by clause; columns of the input other than those named are ignored, and one to be kept
may not have the name of a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, QUOTE = "oitywnrq"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, INTENT, NEGATION, REPORT, QUOTE)
HITS = (INSULT, THREAT)

#: The lexicon's seed, by symbol; English, German, French, Spanish.
INSULTS = """idiot moron stupid scum trash loser pathetic worthless disgusting clown imbecile dumb filth vermin jerk fool
dummkopf abschaum trottel versager crétin imbécile ordure idiota imbécil estúpido basura""".split()
SEED: dict[str, str] = {
    THREAT: """kill hurt destroy beat punch stab shoot burn hang strangle
        töten umbringen schlagen erschießen verletzen tuer frapper détruire brûler matar golpear destruir quemar""",
    TARGET: """you your yours yourself he she him her they them their these those people everyone
        du dich dir dein deine ihr euch euer sie er ihn ihnen tu toi te vous votre vos ils elles lui eux tú ti usted ustedes vosotros él ella ellos ellas""",
    INTENT: "will shall gonna going ll must werde werden wird vais allons va voy vamos",
    NEGATION: """not no never neither nor without hardly isn aren wasn weren don doesn didn
        cannot cant wont dont doesnt didnt isnt arent wasnt werent shouldnt wouldnt couldnt
        nicht kein keine keinen keiner nie niemals ohne pas jamais sans aucun aucune nunca jamás sin ningún ninguna""",
    REPORT: """said says say saying told wrote writes claimed called calls quoted according alleged reported
        sagte sagt schrieb behauptete nannte laut dit disait écrit affirmé selon dijo dice escribió afirmó según""",
}
CLASSES = {w: symbol for symbol, words in SEED.items() for w in words.split()}

#: Weights of the arcs and how many words an element governs.
REACH, SAID_REACH = 4, 8
NEGATED, REPORTED, DIRECTED, IN_A_ROW = 0.3, 0.5, 1.5, 1.2
THREAT_AIMED, THREAT_LOOSE, THREAT_MEANT, THREAT_UNMEANT = 0.6, 0.15, 1.0, 0.7

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_CONTRACTED = re.compile(r"n['’]t\b")
#: A colon that introduces speech or a quotation ends no clause.
_SPEECH = re.compile(rf"\b({'|'.join(SEED[REPORT].split())})\b((?:[^\S\n]+\w+){{0,3}})[^\S\n]*:|:(?=[^\S\n]*[\"“„«])")
_STEMS = (4, 5, 6)

Arc = tuple[str, float, Hashable]  # symbol written, weight, next state


@dataclass(frozen=True)
class Transducer:
    """States, with arcs that read a symbol, write a symbol and carry a weight; several may read the same."""

    starts: tuple[Hashable, ...]
    arcs: dict[Hashable, dict[str, tuple[Arc, ...]]]
    finals: frozenset[Hashable]

    def run(self, symbols: list[str], weights: list[float]) -> float:
        """The largest sum, over accepted paths, of arc weights times word weights (0 if no path is accepted)."""
        paths = dict.fromkeys(self.starts, 0.0)
        for symbol, weight in zip(symbols, weights, strict=True):
            following: dict[Hashable, float] = {}
            for state, total in paths.items():
                for _, factor, to in self.arcs[state].get(symbol, ()):
                    value = total + factor * weight
                    if value > following.get(to, -1.0):
                        following[to] = value
            paths = following
        return max((v for s, v in paths.items() if s in self.finals), default=0.0)


def machine(starts: tuple[Hashable, ...], step: Callable[[Hashable, str], list[Arc]], final: Callable[[Hashable], bool]) -> Transducer:
    """The transducer of all states that ``step`` reaches from ``starts``."""
    arcs: dict[Hashable, dict[str, tuple[Arc, ...]]] = {}
    todo = list(starts)
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        arcs[state] = {s: found for s in SYMBOLS if (found := tuple(step(state, s)))}
        todo += [to for found in arcs[state].values() for _, _, to in found]
    # states from which nothing final is reached lead nowhere
    live = {s for s in arcs if final(s)}
    grown = True
    while grown:
        more = {s for s in arcs if s not in live and any(to in live for found in arcs[s].values() for _, _, to in found)}
        live |= more
        grown = bool(more)
    kept = {s: {a: tuple(x for x in found if x[2] in live) for a, found in arcs[s].items()} for s in live}
    return Transducer(tuple(s for s in starts if s in live), kept, frozenset(s for s in live if final(s)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that reads what ``a`` reads and hands what it writes to ``b``; weights are multiplied."""

    def step(state: Hashable, symbol: str) -> list[Arc]:
        left, right = state
        return [(out, w * v, (p, q)) for mid, w, p in a.arcs[left].get(symbol, ()) for out, v, q in b.arcs[right].get(mid, ())]

    return machine(tuple((p, q) for p in a.starts for q in b.starts), step, lambda s: s[0] in a.finals and s[1] in b.finals)


def negation() -> Transducer:
    """A hit within REACH words after a negation weighs less.  State: words still governed."""

    def step(left: int, symbol: str) -> list[Arc]:
        to = REACH if symbol == NEGATION else max(0, left - (symbol != QUOTE))
        return [(symbol, NEGATED if symbol in HITS and left else 1.0, to)]

    return machine((0,), step, lambda s: True)


def reported() -> Transducer:
    """Hits weigh less before a verb of saying, within SAID_REACH words after it, and between quotation marks.

    State: (whether a verb of saying is still to come, words still governed, whether a quotation is open).
    A path that waits for a verb is accepted only if it comes, one that doesn't only if none comes, so one path is accepted.
    """

    def step(state: tuple[bool, int, bool], symbol: str) -> list[Arc]:
        waits, left, quoted = state
        if symbol == QUOTE:
            return [(symbol, 1.0, (waits, left, not quoted))]
        if symbol == REPORT:
            return [(symbol, 1.0, (True, 0, quoted)), (symbol, 1.0, (False, SAID_REACH, quoted))] if waits else []
        return [(symbol, REPORTED if symbol in HITS and (waits or left or quoted) else 1.0, (waits, max(0, left - 1), quoted))]

    return machine(((False, 0, False), (True, 0, False)), step, lambda s: not s[0])


def target() -> Transducer:
    """A hit with a target within REACH words before or after it weighs more; a threat without one weighs little.

    State: (words since which a target stood near, words within which one must come, words within which none may).
    """

    def step(state: tuple[int, int, int], symbol: str) -> list[Arc]:
        near, promised, barred = state
        if symbol == QUOTE:
            return [(symbol, 1.0, state)]
        if symbol == TARGET:
            return [] if barred else [(symbol, 1.0, (REACH, 0, 0))]
        if promised == 1:  # the last word that could have been the target
            return []
        rest = (max(0, near - 1), max(0, promised - 1), max(0, barred - 1))
        if symbol not in HITS:
            return [(symbol, 1.0, rest)]
        aimed, loose = (DIRECTED, 1.0) if symbol == INSULT else (DIRECTED * THREAT_AIMED, THREAT_LOOSE)
        if near or promised:
            return [(symbol, aimed, rest)]
        return [(symbol, aimed, (rest[0], REACH, rest[2])), (symbol, loose, (rest[0], 0, REACH))]

    return machine(((0, 0, 0),), step, lambda s: not s[1])


def threat() -> Transducer:
    """A threat counts in full within REACH words after a word of intent.  State: words still governed."""

    def step(left: int, symbol: str) -> list[Arc]:
        to = REACH if symbol == INTENT else max(0, left - (symbol != QUOTE))
        return [(symbol, (THREAT_MEANT if left else THREAT_UNMEANT) if symbol == THREAT else 1.0, to)]

    return machine((0,), step, lambda s: True)


def insult() -> Transducer:
    """An insult within REACH words after another one weighs more.  State: words since."""

    def step(left: int, symbol: str) -> list[Arc]:
        to = REACH if symbol == INSULT else max(0, left - (symbol != QUOTE))
        return [(symbol, IN_A_ROW if symbol == INSULT and left else 1.0, to)]

    return machine((0,), step, lambda s: True)


MACHINES = (negation, reported, target, threat, insult)
_COMPOSED: list[Transducer] = []


def composed() -> Transducer:
    """All machines as one, made once in each process."""
    if not _COMPOSED:
        _COMPOSED.append(reduce(compose, [m() for m in MACHINES]))
    return _COMPOSED[0]


def clauses_of(text: str | None) -> list[str]:
    """The clauses of a text in lower case: ``n't`` read as ``not``, speech kept with what introduces it."""
    low = _CONTRACTED.sub(" not", (text or "").lower())
    return _CLAUSE.split(_SPEECH.sub(r"\1\2 ", low) if ":" in low else low)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    found = _WORD.findall((text or "").lower())
    return [w for x in found for w in ([x] if x.isalpha() else "".join(c if c.isalpha() else " " for c in x).split())]


@dataclass(frozen=True)
class Grammar:
    """The lexicon: weights of insults, by word and by stem; the other symbols are seeds."""

    insults: dict[str, float]
    stems: dict[str, float]
    known: dict[str, float] = field(default_factory=dict, compare=False, repr=False)

    def insult(self, word: str) -> float:
        """The weight of a word as an insult, 0 for others."""
        found = self.known.get(word)
        if found is None:
            found = self.insults.get(word, 0.0)
            if not found and len(word) > 4:
                found = max((self.stems.get(word[:k], 0.0) for k in _STEMS if len(word) >= k), default=0.0)
            if len(self.known) > 500_000:
                self.known.clear()
            self.known[word] = found
        return found

    def hit(self, word: str) -> bool:
        return CLASSES.get(word) == THREAT or self.insult(word) > 0

    def symbol(self, token: str) -> tuple[str, float]:
        """(symbol, weight) of a word or quotation mark."""
        if not token[0].isalpha():
            return QUOTE, 0.0
        weight = self.insult(token)
        if weight:
            return INSULT, weight
        found = CLASSES.get(token, OTHER)
        return found, float(found == THREAT)

    def clause(self, tokens: list[str]) -> float:
        """The score of one clause's words and quotation marks."""
        read = [self.symbol(t) for t in tokens]
        return composed().run([s for s, _ in read], [w for _, w in read])

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that match, in order."""
        out = []
        for part in clauses_of(text):
            tokens = _TOKEN.findall(part)
            if any(map(self.hit, tokens)) and (value := self.clause(tokens)) > 0:
                out.append(value)
        return out

    def with_hits(self, texts: pa.Array) -> np.ndarray:
        """Which texts hold a hit, word by distinct word."""
        lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}]+")
        words = lists.flatten().dictionary_encode()
        hit = np.fromiter((bool(w) and self.hit(w) for w in words.dictionary.to_pylist()), dtype=bool, count=len(words.dictionary))
        counts = np.concatenate([[0], np.cumsum(hit[words.indices.to_numpy()])]) if len(words) else np.zeros(1, dtype=np.int64)
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        return counts[ends] > counts[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0, dtype=bool)


def statistics(scores: list[float]) -> tuple[float, float, float]:
    """(bounded total, highest, log count) of clause scores."""
    total = sum(scores)
    return total / (1.0 + total), min(max(scores, default=0.0), 2.0), math.log1p(len(scores))


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    bias: float
    weights: tuple[float, float, float]

    def of_scores(self, scores: list[float]) -> tuple[float, int]:
        """(score, number of clauses that match)."""
        z = self.bias + sum(a * b for a, b in zip(self.weights, statistics(scores), strict=True))
        return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z)))), len(scores)

    def score(self, text: str | None) -> tuple[float, int]:
        return self.of_scores(self.grammar.clauses(text))


SEED_MODEL = Model(Grammar(dict.fromkeys(INSULTS, 1.0), {}), -3.0, (6.0, 2.0, 1.0))


def term_counts(rows: DataFrame) -> DataFrame:
    """kind (0 for a word, else a stem's length), term, toxic, clean: rows of each label that hold a term; ``rows`` has text and __label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("__label").to_pylist(), strict=True):
                words = set(words_of(text))
                counts.update({(label, 0, w) for w in words} | {(label, k, w[:k]) for w in words for k in _STEMS if len(w) >= k})
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for _, k, _ in keys], pa.int32()), pa.array([w for _, _, w in keys], pa.string()), *(pa.array([counts[x] if x[0] == y else 0 for x in keys], pa.int64()) for y in (1, 0))],
                names=["kind", "term", "toxic", "clean"],
            )

    return common.arrow_map(rows, run, "kind int, term string, toxic long, clean long").groupBy("kind", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(rows: DataFrame, n_toxic: int, n_clean: int, least: int = 4, least_ratio: float = 8.0, most_terms: int = 100_000) -> Grammar:
    """Words and stems far more frequent in rows of label 1; weights grow with the evidence, up to 1.  The ``most_terms`` most frequent of these serve."""
    toxic, clean = F.col("toxic"), F.col("clean")
    rate = lambda t, c: (t / F.lit(float(n_toxic))) / (c / F.lit(float(n_clean)))
    ratio = rate(toxic, clean + 0.5)
    # the lower end of the rate's range, so that few rows prove little
    sure = rate(toxic - 1.5 * F.sqrt(toxic), clean + 1.0 + F.sqrt(clean))
    enough = toxic >= F.when(F.col("kind") == 0, F.lit(least)).otherwise(F.lit(2 * least))
    found = term_counts(rows).filter(enough & (ratio >= least_ratio) & (sure > 2.0)).withColumn("ratio", ratio)
    insults, stems = dict.fromkeys(INSULTS, 1.0), {}
    for r in found.orderBy(F.desc("toxic"), "kind", "term").limit(most_terms).collect():
        weight = min(1.0, math.log(r["ratio"]) / math.log(100.0)) * (r["toxic"] / (r["toxic"] + r["clean"]))
        held = stems if r["kind"] else insults
        held[r["term"]] = max(weight, held.get(r["term"], 0.0))
    return Grammar(insults, stems)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for a logistic regression; the first weight is the bias."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) / len(y) + ridge * np.r_[0.0, w[1:]]
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.diag(np.r_[1e-6, np.ones(len(w) - 1)])
        move = np.linalg.solve(bend + 1e-9 * np.eye(len(w)), slope)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def clause_statistics(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """__label and the three statistics of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(grammar.clauses(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__label"), *(pa.array([f[k] for f in found], pa.float64()) for k in range(3))], names=["__label", "total", "most", "n"])

    return common.arrow_map(rows, run, "__label int, total double, most double, n double")


def fit(docs: DataFrame, labels: DataFrame, training: Column, most_rows: int = 12_000) -> Model:
    """A model from about ``most_rows`` labelled rows (doc_id, toxic), chosen by a hash of the id.

    The sampled labels are what is broadcast, so its size is bounded by ``most_rows``; the
    driver gets three numbers for each of these rows, and the terms that pass.
    """
    rows = common.labelled(docs, labels, "toxic", training, most_rows)
    n = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    if len(n) < 2:
        return SEED_MODEL
    grammar = learn_lexicon(rows, n[1], n[0])
    found = clause_statistics(rows, grammar).toPandas().sort_values(["__label", "total", "most", "n"])
    w = logistic(found[["total", "most", "n"]].to_numpy(), found["__label"].to_numpy(dtype=float), ridge=1e-4)
    if min(w[1:]) < 0:  # a match may never lower a score
        w[1:] = np.maximum(w[1:], 0.0)
    return Model(grammar, float(w[0]), (float(w[1]), float(w[2]), float(w[3])))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with score and n_clauses for every row."""
    common.no_clash(keep, ("score", "n_clauses"))
    source = docs.select(*keep, F.col("text").alias("__text"))
    kept = [f for f in source.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "n_clauses long"])
    held = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon is bounded by most_terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            found = [model.of_scores([])] * len(texts)
            for i in np.flatnonzero(model.grammar.with_hits(texts)).tolist():
                found[i] = model.score(texts[i].as_py())
            columns = [batch.column(f.name) for f in kept] + [pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), "score", "n_clauses"])

    return common.arrow_map(source, run, schema)


def judge(docs: DataFrame, labels: DataFrame, training: Column, held_out: Column, least: float = 0.5, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses for every document."""
    model = fit(docs, labels, training, **options)
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return score(marked, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= least).cast("int"))
