"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on the statistics of labelled rows; every path from a root
is a conjunctive rule; a logistic regression with an L1 penalty weighs the rules and most
get weight 0; what is left is compiled into one Spark column expression, so scoring runs
inside the JVM's generated code (Friedman and Popescu's rule ensembles).

Defined results: null and empty texts have all statistics 0 and are scored by the same
rules; labels that are null, neither 0 nor 1, without a document, or repeated and at odds aren't learned from;
without both classes the score is the share of label 1 (0.5 without labels); repeated rows
are scored alike; a very long text is read whole, some documents or one at a time; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import text_buffers, word_chunks

#: Texts are read by these; each is a share or a mean, so long and short texts compare.
STATISTICS = ("log_chars", "word_length", "upper_share", "digit_share", "symbol_share", "mark_share", "letter_share", "line_words", "long_words", "stop_share")
#: Frequent function words of the languages.
STOP_WORDS = "the of and to in is that der die und das de la le les el que en et".split()
LONG_WORD = 15


def _flags(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(characters.encode())] = 1
    return out


_ASCII_LETTERS = _flags("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_BEGINS = np.ones(256, dtype=np.uint8)  # bytes that begin a code point
_BEGINS[0x80:0xC0] = 0
_LETTERS = _ASCII_LETTERS.copy()  # code points beyond ASCII count as letters
_LETTERS[0xC0:] = 1
_WORD_BYTES = _ASCII_LETTERS.astype(bool) | (np.arange(256) >= 128)
_COUNTED = {"upper": _flags("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "digit": _flags("0123456789"), "symbol": _flags("|*#$%&@^~<>=+_\\{}[]"), "mark": _flags(".,!?;:"), "letter": _LETTERS, "line": _flags("\n"), "char": _BEGINS}


def _stop_hashes() -> np.ndarray:
    offsets, data = text_buffers(pa.array([" ".join(STOP_WORDS)]))
    return np.sort(next(word_chunks(offsets, data, keep=_WORD_BYTES)).hashes)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, counted over its bytes some documents at a time."""
    offsets, data = text_buffers(texts)
    out, stops = np.zeros((len(offsets) - 1, len(STATISTICS))), _stop_hashes()
    for c in word_chunks(offsets, data, keep=_WORD_BYTES):
        n = len(c.bounds) - 1
        at = offsets[c.first : c.first + n + 1]
        text, at = data[at[0] : at[-1]], at - at[0]

        def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        count = {name: per_text(flags[text], at) for name, flags in _COUNTED.items()}
        beyond = np.zeros(len(text), dtype=np.uint8)  # upper-case letters of Latin-1
        beyond[1:] = (text[:-1] == 0xC3) & (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[1:] != 0x97)
        begun = np.concatenate([[0], np.cumsum(_BEGINS[text], dtype=np.int64)])
        lengths = begun[c.ends] - begun[c.starts]
        chars, words = np.maximum(count["char"], 1.0), np.maximum(np.diff(c.bounds), 1).astype(float)
        place = np.minimum(np.searchsorted(stops, c.hashes), len(stops) - 1)
        columns = {
            "log_chars": np.log1p(count["char"]),
            "word_length": per_text(lengths, c.bounds) / words,
            "upper_share": (count["upper"] + per_text(beyond, at)) / np.maximum(count["letter"], 1.0),
            "digit_share": count["digit"] / chars,
            "symbol_share": count["symbol"] / chars,
            "mark_share": count["mark"] / chars,
            "letter_share": count["letter"] / chars,
            "line_words": np.diff(c.bounds) / (count["line"] + 1.0),
            "long_words": per_text(lengths >= LONG_WORD, c.bounds) / words,
            "stop_share": per_text(stops[place] == c.hashes, c.bounds) / words,
        }
        out[c.first : c.first + n] = np.column_stack([columns[name] for name in STATISTICS])
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """The rows' columns other than ``text``, with one column ``stat_...`` for each of STATISTICS; clashing names are an error."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    names = [f"stat_{n}" for n in STATISTICS]
    if clash := {f.name for f in kept} & set(names):
        raise ValueError(f"the input has columns {sorted(clash)} already")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{n} double" for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = statistics(batch.column("text"))
            columns = [batch.column(f.name) for f in kept] + [pa.array(found[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *names])

    return common.arrow_map(docs, run, schema)


#: A rule: (statistic's place, whether above, threshold) for each step of its path.
Rule = tuple[tuple[int, bool, float], ...]


def _grow(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, bend: np.ndarray, rows: np.ndarray, path: Rule, depth: int, least: int, rules: list[Rule], out: np.ndarray) -> None:
    value = -slope[rows].sum() / (bend[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        all_slope, all_bend = slope[rows].sum(), bend[rows].sum()
        for f in range(x.shape[1]):
            if not len(edges[f]):
                continue
            bins = binned[rows, f]
            size = len(edges[f]) + 1
            g, h, n = (np.cumsum(np.bincount(bins, weights=w, minlength=size))[:-1] for w in (slope[rows], bend[rows], np.ones(len(rows))))
            gain = g**2 / (h + 1.0) + (all_slope - g) ** 2 / (all_bend - h + 1.0) - all_slope**2 / (all_bend + 1.0)
            gain[(n < least) | (len(rows) - n < least)] = 0.0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, k))
    if best[1] is None:
        out[rows] += value
        return
    f, k = best[1]
    threshold = float(edges[f][k])
    for above in (False, True):
        part = rows[(x[rows, f] > threshold) == above]
        step = (*path, (f, above, threshold))
        rules.append(step)
        _grow(x, binned, edges, slope, bend, part, step, depth - 1, least, rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 25, depth: int = 3, rate: float = 0.3, bins: int = 48, seed: int = common.SEED) -> list[Rule]:
    """The paths of gradient-boosted trees, each grown on a random half of the rows."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    z = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rng, rules = np.random.default_rng(seed), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows, move = np.flatnonzero(rng.random(len(y)) < 0.5), np.zeros(len(y))
        found: list[Rule] = []
        _grow(x, binned, edges, p - y, p * (1 - p), rows, (), depth, max(5, len(rows) // 500), found, move)
        rules += found
        z += rate * sum(((_holds(x, r)) * 1.0) * v for r, v in _leaf_values(x, found, p - y, p * (1 - p), rows)) if found else 0.0
    return list(dict.fromkeys(rules))


def _leaf_values(x: np.ndarray, rules: list[Rule], slope: np.ndarray, bend: np.ndarray, rows: np.ndarray) -> list[tuple[Rule, float]]:
    """(rule, step) of each leaf, a rule that no other one continues."""
    inner = {r[:-1] for r in rules}
    out = []
    for r in rules:
        if r not in inner:
            held = rows[_holds(x[rows], r)]
            out.append((r, float(-slope[held].sum() / (bend[held].sum() + 1.0))))
    return out


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for f, above, threshold in rule:
        out &= (x[:, f] > threshold) == above
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """(bias, weights) of an L1-penalised logistic regression by accelerated proximal gradient."""
    mean, spread = a.mean(axis=0), np.maximum(a.std(axis=0), 0.02)
    s = (a - mean) / spread
    step = 4.0 / max(1e-9, float(np.linalg.norm(s, 2) ** 2) / len(y) + 1.0)
    w, b = np.zeros(a.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-np.clip(s @ v + c, -30, 30))) - y
        now = v - step * (s.T @ g) / len(y)
        now = np.sign(now) * np.maximum(np.abs(now) - step * penalty, 0.0)
        b_now, t_now = c - step * float(g.mean()), (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = now + (t - 1) / t_now * (now - w), b_now + (t - 1) / t_now * (b_now - b)
        w, b, t = now, b_now, t_now
    return b - float((w / spread) @ mean), w / spread


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def column(self) -> Column:
        """The score as a Spark expression over the statistics' columns."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            held = F.lit(True)
            for f, above, threshold in rule:
                stat = F.col(f"stat_{STATISTICS[f]}")
                held = held & ((stat > threshold) if above else (stat <= threshold))
            z = z + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

    def values(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * _holds(x, rule)
        return 1 / (1 + np.exp(-z))


def ensemble(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3) -> RuleEnsemble:
    if not len(y):
        return RuleEnsemble(0.0, ())
    if len(set(y.tolist())) < 2:
        share = min(0.999, max(0.001, float(y.mean())))
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rules = tree_rules(x, y)
    if not rules:
        return RuleEnsemble(float(np.log(y.mean() / (1 - y.mean()))), ())
    a = np.column_stack([_holds(x, r) for r in rules]).astype(float)
    bias, weights = lasso(a, y, penalty)
    return RuleEnsemble(bias, tuple((r, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-6))


def fit(docs: DataFrame, labels: DataFrame, training: Column, most_rows: int = 12_000) -> RuleEnsemble:
    """An ensemble from about ``most_rows`` labelled rows (doc_id, quality), chosen by a hash of the id.

    The sampled labels are broadcast and the sample's statistics come to the driver: both are
    bounded by ``most_rows``.
    """
    rows = with_statistics(common.labelled(docs, labels, "quality", training, most_rows)).orderBy("doc_id")
    found = rows.select("__label", *[f"stat_{n}" for n in STATISTICS]).toPandas()
    return ensemble(found[[f"stat_{n}" for n in STATISTICS]].to_numpy(float), found["__label"].to_numpy(float))


def judge(docs: DataFrame, labels: DataFrame, training: Column, held_out: Column, least: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs, labels, training, **options)
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    scored = with_statistics(marked).withColumn("score", model.column())
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"))
