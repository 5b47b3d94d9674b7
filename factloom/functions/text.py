"""Scalar text functions as Spark columns; all of them stay inside generated code."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
STOP_WORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]
PLACEHOLDER = "Abstract not available for this paper."
#: What Python's str.split() takes as white space.
SPACES = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u0085\u001c-\u001f]+"


def words(text: Column) -> Column:
    """Array of white-space separated words; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def norm_alnum(text: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


norm_venue = norm_alnum


def norm_title(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), SPACES, " "))


def norm_nfkc(text: Column) -> Column:
    """NFKC, case folded, Unicode letters and digits only; an Arrow UDF, as no built-in function folds or normalises."""

    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()))

    return F.pandas_udf(fold, T.StringType())(text)


def norm_doi(value: Column) -> Column:
    """Lower case without resolver and ``doi:`` prefixes; null when nothing is left."""
    out = F.lower(F.btrim(value))
    for prefix in ("^https://doi\\.org/", "^http://doi\\.org/", "^doi:"):
        out = F.regexp_replace(out, prefix, "")
    return F.nullif(out, F.lit(""))


def dedup_key(doi: Column, title: Column, year: Column) -> Column:
    """``doi:...`` when there is a DOI (an empty one counts as none), else ``title:...:year``."""
    return F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), norm_alnum(title), F.lit(":"), F.coalesce(year.cast("string"), F.lit(""))))


def query_terms(query: Column) -> Column:
    """Distinct lower-case alphanumeric tokens of 3 or more characters that aren't stop words, in order."""
    tokens = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS)))


def token_estimate(text: Column) -> Column:
    return F.floor((F.length(text) + 3) / 4).cast("long")


def quote(text: Column, most: int = 240) -> Column:
    return F.substring(text, 1, most)


def key_slot(value: Column, size: int = 8) -> Column:
    return F.substring(F.sha2(value, 256), 1, size)


def norm_doc_id(value: Column) -> Column:
    return F.upper(F.btrim(F.regexp_replace(F.btrim(value), r"[\[\]]", "")))


def safe_filename(value: Column, default: str = "paper") -> Column:
    """``name.pdf`` of a paper's id: a DOI link's or URL's last segment, other characters than ``A-Za-z0-9._-`` as ``_``, no ``.`` or ``_`` at the ends."""
    last = lambda x: F.element_at(F.split(x, "/"), -1)
    part = F.when(F.contains(value, F.lit("doi.org")), last(value)).when(value.startswith("http"), last(F.regexp_replace(value, "/+$", ""))).otherwise(value)
    clean = F.regexp_replace(F.regexp_replace(part, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)), F.lit(".pdf"))


def key_env_name(suffix: Column, base: str = "GEMINI_API_KEY") -> Column:
    """The environment variable of a key: ``base``, with ``_n`` for others than the first."""
    return F.when(suffix == 1, F.lit(base)).otherwise(F.concat(F.lit(f"{base}_"), suffix.cast("string")))


def default_paper_id(path: Column) -> Column:
    """The last part of a path, whichever slash it has."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def sanitized_error(error: Column) -> Column:
    """The class of an error (``pkg.Class: what it said``) and nothing of what it said."""
    return F.concat(F.regexp_extract(error, r"^(?:[A-Za-z0-9_]+\.)*([A-Za-z0-9_]+)", 1), F.lit(": processing failed (details omitted)"))


def version_label(match: Column, revision: Column, version: Column) -> Column:
    """What a reader is told about the version of a full text; fixed values."""
    other = F.coalesce(F.nullif(revision, F.lit("")), F.nullif(version, F.lit("")), F.lit("unknown"))
    return F.when(match == "exact", "\u6307\u5b9a\u7248\u672c\u5df2\u78ba\u8a8d").when(match == "alternative", F.concat(F.lit("\u4f7f\u7528\u66ff\u4ee3\u7248\u672c\uff1a"), other)).otherwise("\u7248\u672c\u672a\u78ba\u8a8d")


def venue_verification(venues: Column) -> Column:
    return F.when(F.size(F.coalesce(venues, F.array())) > 0, "provider_reported").otherwise("unconfirmed")


def json_contract(raw: Column, schema: str, fine) -> Column:
    """``syntax`` for what isn't JSON, ``schema`` where ``fine`` (of the object parsed by ``schema``) doesn't hold, else ``ok``."""
    bare = strip_fence(raw)
    return F.when(F.try_parse_json(bare).isNull(), "syntax").when(F.coalesce(fine(F.from_json(bare, schema)), F.lit(False)), "ok").otherwise("schema")


def strip_fence(text: Column) -> Column:
    """Without the lines of a code fence that opens and closes it, and nothing after the last closing brace."""
    bare = F.btrim(text, F.lit(" \t\n\r\f\u000b"))
    fenced = bare.startswith("```") & bare.endswith("```")
    inner = F.btrim(F.array_join(F.slice(F.split(bare, "\r?\n"), F.lit(2), F.greatest(F.size(F.split(bare, "\r?\n")) - 2, F.lit(0))), "\n"), F.lit(" \t\n\r\f\u000b"))
    bare = F.when(fenced, inner).otherwise(bare)
    last = F.length(bare) - F.instr(F.reverse(bare), "}") + 1
    return F.when(F.instr(bare, "}") > 0, F.substring(bare, F.lit(1), last)).otherwise(bare)


def short_query_ok(text: Column, least: int = 2, most: int = 4) -> Column:
    return word_count(text).between(least, most)


def usable_abstract(text: Column, least: int = 20) -> Column:
    return F.coalesce((text != PLACEHOLDER) & (F.length(F.btrim(text)) >= least), F.lit(False))


def limitation_cue(text: Column) -> Column:
    """Words that state a limitation; a fixed pattern."""
    return text.rlike(r"(?i)(?:limitation|future\s+work|fails?\s+to|does\s+not|remains\s+(?:un)?(?:explor|solv|address)|lack\s+of)")


def is_table(text: Column) -> Column:
    """Two or more lines that aren't blank, all of which begin with a pipe."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("|"))
