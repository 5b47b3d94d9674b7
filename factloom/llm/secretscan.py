"""Secret scan: fixed credential patterns, and guess cost of values in credential context.

The base patterns mark assignments, access keys and hexadecimal runs.  Besides, a value
that stands in credential context (after a credential word and ``=``, ``:``, ``:=``, ``=>`` or
``is``, after an option ``--password``, in an element ``<password>``, after ``Bearer``, or as the
password of a URL) is split by dynamic programming into words, dates,
repeats, sequences, keyboard walks and brute-force spans at the least total guess cost
(log10 of guesses); a value that takes at least ``least_cost`` is a span of kind ``guess``, unless a base span holds it.
Words are ranked by the number of the table's documents that hold them, after a few common passwords.
After ``is`` a value counts only if it has a digit, a symbol or a capital inside, so plain words in sentences stay.
Positions are code points of the whole text, ends exclusive.

Defined results: a null text counts as empty; an empty text has no spans and the digest of
the empty string; repeated rows give repeated rows; a text of any length is searched whole; an empty table gives no rows; other
columns of the input are ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "guess")
LEAST_COST = 8.0

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_CONTEXT_WORDS = ("passphrase", "passcode", "password", "passwd", "pwd", "secret", "token", "credential", *(f"{w}{gap}key" for w in ("private", "access", "auth", "client", "api") for gap in ("", "_", "-")))
#: A credential word, as a word or part of an identifier (``DB_PASSWORD``, ``secretKey``, ``PGPASSWORD``).  What follows it is bounded, so that time stays linear.
_CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z]))|(?=pass(?:word|wd|phrase)))
    (?:passphrase|passcode|password|passwd|pwd|(?:client[_-]?)?secret|(?:(?:auth|access)[_-]?)?token|credential|(?:private|access|auth|client|api)[_-]?key)
    s?[0-9]{0,8}(?:(?:[_-]|(?-i:(?<=[a-z0-9])[A-Z]))[A-Za-z0-9_-]{0,64})?
    ["']?\]?\x20*(?P<sign>:=|=>|[:=]|\bis\b)\x20*(?:"(?P<double>[^"\n]{4,})"|'(?P<single>[^'\n]{4,})'|["']?(?P<bare>[!#-&(-~][!-~]{3,}))""",
    re.IGNORECASE | re.ASCII | re.VERBOSE,
)
_NAMED = r"(?:passphrase|passcode|password|passwd|pwd|secret|token|credential|(?:private|access|auth|client|api)[_-]?key)s?"
#: Other contexts, each with what a text must hold for it to be looked for; group ``value`` is what is priced.
_OTHER_CONTEXTS = (
    ("pass", re.compile(r"""(?<![A-Za-z0-9])pass["']?\x20*(?::=|=>|[:=])\x20*["']?(?P<value>[!#-&(-~][!-~]{3,})""", re.IGNORECASE | re.ASCII)),
    ("-", re.compile(rf"""(?<![\w-])--?(?:[a-z]{{1,16}}[_-])?{_NAMED}\x20+(?P<value>[!#-&(-,./-~][!-~]{{3,}})""", re.IGNORECASE | re.ASCII)),
    ("<", re.compile(rf"""<[^<>\n]{{0,64}}{_NAMED}[^<>\n]{{0,64}}>\x20*(?P<value>[^<>\s][^<>\n]{{2,4096}}[^<>\s])\x20*</""", re.IGNORECASE | re.ASCII)),
    ("bearer", re.compile(r"""(?<![A-Za-z0-9])bearer\x20+(?P<value>[A-Za-z0-9._~+/=-]{8,})""", re.IGNORECASE | re.ASCII)),
    ("://", re.compile(r"""://[^\s/:@]{1,64}:(?P<value>[^\s/@]{4,256})@""")),
)
_TELLING = re.compile(r"[0-9@#$%^&*+=_~|\\]|[a-z][A-Z]")  # what a value in a sentence has and a plain word hasn't
PROSE_WORDS = 6  # a quoted value of this many plain words is a sentence

#: Common passwords and password words, most guessed first.
COMMON = """
123456 password qwerty 12345 111111 abc123 letmein monkey dragon iloveyou admin welcome login master hello
freedom whatever shadow sunshine princess football baseball superman batman trustno1 starwars secret passw0rd
test guest root user changeme default temp example sample summer winter spring autumn january february march
april june july august september october november december monday tuesday wednesday thursday friday saturday
sunday love money house computer internet server database company office hunter killer pepper ginger cookie
cheese orange banana apple flower silver golden purple yellow green black white blue red one two three the
correct horse battery staple my your our pass word key token api access private public client
""".split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEAR = {a: {b for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= y + dy < 4 and 0 <= x + dx < len(_ROWS[y + dy]) and (b := _ROWS[y + dy][x + dx]) != a} for y, row in enumerate(_ROWS) for x, a in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
_LEET = str.maketrans("013457@$!", "oieastasi")
_SPAN, _BLOCK = 40, 8
SHORT_WORD, LONG_WORD = 3, 20


def ranks(words: Iterable[str]) -> dict[str, int]:
    """The guessing order: common passwords, then ``words`` as they come."""
    out: dict[str, int] = {}
    for w in (*COMMON, *words):
        out.setdefault(w, len(out) + 1)
    return out


_RANK = ranks(())


def _pool(c: str) -> float:
    return 10.0 if c.isdigit() else 26.0 if c.isalpha() and c.isascii() else 33.0 if c.isascii() else 200.0


def _date_cost(length: int) -> float:
    return math.log10(120.0) if length == 4 else math.log10(120.0 * 372.0 * (1.0 if length == 8 else 4.0))


def guess_cost(value: str, rank: dict[str, int] = _RANK, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes (0 for an empty value).

    Every piece has at most ``_SPAN`` characters, so once all of the last ``_SPAN`` places
    cost ``enough`` the whole does, and that is returned.
    """
    n, low = len(value), value.lower()
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    kinds = {(c.isdigit(), c.islower(), c.isupper()) for c in value[: 4 * _SPAN]}
    mixed = 26.0 if len(kinds) > 1 else 0.0
    best, ending = [0.0], {}  # ends of dates, with their lengths
    run = walk = step = 1
    for j in range(1, n + 1):
        i = j - 1
        for pattern in (_DATE, _YEAR) if value[i].isdigit() else ():
            if m := pattern.match(value, i):
                ending.setdefault(m.end(), set()).add(m.end() - i)
        if i:
            run = run + 1 if value[i] == value[i - 1] else 1
            walk = walk + 1 if low[i] in _NEAR.get(low[i - 1], ()) else 1
            gap = ord(value[i]) - ord(value[i - 1])
            step = step + 1 if i > 1 and gap in (1, -1) and gap == ord(value[i - 1]) - ord(value[i - 2]) else 2 if gap in (1, -1) else 1
        c = value[i]
        least = best[i] + math.log10(_pool(c) + (mixed if c.isalpha() else 0.0))
        for length in range(SHORT_WORD, min(j, LONG_WORD) + 1):
            word = low[j - length : j]
            place, leet = rank.get(word), 0.0
            if place is None:
                place, leet = rank.get(plain[j - length : j]), 0.3
            if place is not None:
                least = min(least, best[j - length] + math.log10(place + 10.0) + leet + (0.3 if value[j - length : j] != word else 0.0))
        for length in range(3, min(run, _SPAN) + 1):
            least = min(least, best[j - length] + math.log10(_pool(c) * length))
        for length in range(3, min(step, _SPAN) + 1):
            least = min(least, best[j - length] + math.log10(_pool(c) * length * 2.0))
        for length in range(4, min(walk, _SPAN) + 1):
            least = min(least, best[j - length] + math.log10(47.0 * 2.5 * length))
        for length in range(2, min(_BLOCK, j // 2) + 1):  # a block said again
            if value[j - length : j] == value[j - 2 * length : j - length]:
                least = min(least, best[j - length] + math.log10(2.0))
        for length in ending.pop(j, ()):
            least = min(least, best[j - length] + _date_cost(length))
        best.append(least)
        if j >= _SPAN and j % _SPAN == 0 and min(best[-_SPAN:]) >= enough:
            return enough
    return best[n]


def corpus_words(docs: DataFrame, most_words: int = 50_000) -> list[str]:
    """Up to ``most_words`` words (3 to 20 letters a-z) that most documents hold, most frequent first.

    All texts are counted, without the values that stand in credential context.  Words as
    frequent as each other are in or out together, so a threshold of the counts decides; it comes from
    a few thousand numbers, and only the words above it come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_CONTEXT.sub(" ", t) if t and _may_hold(t.lower()) else t for t in batch.column(0).to_pylist()]
            lists = pc.split_pattern_regex(pc.ascii_lower(pa.array(texts, pa.large_string()).fill_null("")), r"[\x20\x09-\x0D]+")
            words = pc.utf8_trim(lists.flatten(), ".,;:!?()[]\"'").dictionary_encode()
            owner, index = pc.list_parent_indices(lists).to_numpy(), words.indices.to_numpy()
            counts = np.bincount(np.unique(owner * np.int64(len(words.dictionary)) + index) % max(1, len(words.dictionary)), minlength=len(words.dictionary))
            fit = pc.match_substring_regex(words.dictionary, f"^[a-z]{{{SHORT_WORD},{LONG_WORD}}}$")
            yield pa.RecordBatch.from_arrays([words.dictionary.filter(fit).cast(pa.string()), pa.array(counts).filter(fit)], names=["word", "n"])

    scratch = common.Scratch(docs.sparkSession)
    found = scratch.save(common.arrow_map(docs.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(F.log2(F.col("n") / 1000) * 64))
    taken, least = 0, 1 << 62
    for r in sorted(found.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        taken += r["count"]
        if taken > most_words:
            break
        least = r["step"]
    words = found.filter(step >= least).collect()
    scratch.drop(found)
    return [r["word"] for r in sorted(words, key=lambda r: (-r["n"], r["word"]))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    low = text.lower()
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(found)


def _may_hold(low: str) -> bool:
    return any(w in low for w in _CONTEXT_WORDS)


def _costly(value: str, sign: str, rank: dict[str, int], least_cost: float) -> bool:
    """Whether a value in credential context is a secret.  Plain words are none after ``is``, nor is a sentence."""
    if sign.lower() == "is" and not _TELLING.search(value):
        return False
    parts = value.split()
    if len(parts) > 1:
        least_cost *= 2
        if len(parts) >= PROSE_WORDS and all(p.strip(".,;:!?()'-").isalpha() for p in parts):
            return False
    return guess_cost(value, rank, least_cost) >= least_cost


def guess_spans(text: str, least_cost: float = LEAST_COST, rank: dict[str, int] = _RANK) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of values in credential context that are costly to guess."""
    low, out = text.lower(), []
    for held, pattern in _OTHER_CONTEXTS:
        for m in pattern.finditer(text) if held in low else ():
            value = m["value"].rstrip(".,;:)]}>\"'")
            if len(value) >= 4 and _TELLING.search(value) and _costly(value, "=", rank, least_cost):
                out.append((m.start("value"), 3, m.start("value") + len(value)))
    for m in _CONTEXT.finditer(text) if _may_hold(low) else ():
        g = next(name for name in ("double", "single", "bare") if m[name] is not None)
        value = m[g].rstrip(".,;:)]}>\"'") if g == "bare" else m[g]
        if len(value) >= 4 and _costly(value, m["sign"], rank, least_cost):
            out.append((m.start(g), 3, m.start(g) + len(value)))
    return _apart(out)


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sorted spans without those inside another: contexts can meet in one value."""
    out: list[tuple[int, int, int]] = []
    for s in sorted(set(spans), key=lambda s: (s[0], -s[2])):
        if not out or s[2] > out[-1][2]:
            out.append(s)
    return out


def _join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, least_cost: float = LEAST_COST, most_words: int = 50_000) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans for every document."""
    held = docs.sparkSession.sparkContext.broadcast(ranks(corpus_words(docs, most_words)))  # bounded by most_words
    source = docs.select("doc_id", F.col("text").alias("__text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, joined = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = [s for s in guess_spans(text or "", least_cost, held.value) if not any(b[0] <= s[0] and s[2] <= b[2] for b in base)]
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in (base if k < 3 else more)))
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                joined.append(_join(sorted(base + more)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"])

    return common.arrow_map(source, run, schema)


def redact(docs: DataFrame, least_cost: float = LEAST_COST, mark: str = "[SECRET]", size: str = "n_chars", most_words: int = 50_000) -> DataFrame:
    """All rows and columns, each span of a secret replaced by ``mark``; column ``size``, if there, is put right in changed rows."""
    place = docs.columns.index("text")
    count = docs.columns.index(size) if size in docs.columns else None
    held = docs.sparkSession.sparkContext.broadcast(ranks(corpus_words(docs, most_words)))

    def clean(text: str | None) -> str | None:
        spans = sorted(base_spans(text) + guess_spans(text, least_cost, held.value)) if text else []
        if not spans:
            return text
        parts, at = [], 0
        for a, _, b in spans:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join(parts) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(place).to_pylist()
            after = [clean(t) for t in before]
            columns = list(batch.columns)
            columns[place] = pa.array(after, columns[place].type)
            if count is not None:
                sizes = [n if a == b else len(a) for a, b, n in zip(after, before, columns[count].to_pylist(), strict=True)]
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return common.arrow_map(docs, run, docs.schema)
