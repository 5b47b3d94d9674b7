"""Numeric scores as Spark columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def citation_score(citations: Column) -> Column:
    """ln(1 + c) / ln(1001), at most 1; null counts as 0."""
    return F.least(F.log1p(F.coalesce(citations, F.lit(0)).cast("double")) / F.lit(math.log(1001.0)), F.lit(1.0))


def recency_score(year: Column) -> Column:
    return F.least(F.greatest((year - 2020) / F.lit(10.0), F.lit(0.0)), F.lit(1.0))


def lexical_score(terms: list[str], title: Column, abstract: Column) -> Column:
    """(3 x terms in the title + terms in the abstract) / (4 x terms); a term counts when it stands anywhere, in words too."""
    hits = lambda where: sum((F.when(F.contains(where, F.lit(t)), 1).otherwise(0) for t in terms), F.lit(0))
    return (3 * hits(F.lower(title)) + hits(F.lower(abstract))) / F.lit(4.0 * max(1, len(terms)))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, left to right, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def relevance_1_10(score: Column) -> Column:
    return F.least(F.greatest(F.ceil(score * 10 / 3), F.lit(1)), F.lit(10)).cast("int")


def metadata_quality(venue: Column, citations: Column) -> Column:
    """4, and 2 each for a venue, 10 and 100 citations."""
    plus = lambda test: F.when(test, 2).otherwise(0)
    c = F.coalesce(citations, F.lit(0))
    return F.least(4 + plus(F.coalesce(venue, F.lit("")) != "") + plus(c >= 10) + plus(c >= 100), F.lit(10)).cast("int")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 when either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def duration_seconds(raw: Column) -> Column:
    """``12``, ``500ms``, ``3s`` and ``2m`` in seconds; null for anything else."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*(ms|s|m)?\s*$"
    value = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit("")).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    return F.when(unit == "ms", value / 1000).when(unit == "m", value * 60).otherwise(value)


def round1(x: Column) -> Column:
    """``x`` to one decimal place, by its exact binary value, ties to the even tenth; for 0 <= x < 1e5.

    The nearest double to each midpoint (2k + 1) / 20 is compared with x; where they are equal,
    the sign of 20 x - (2k + 1), which is exact in this order of operations, decides.
    """
    k = F.floor(x * 10)
    odd = (2 * k + 1).cast("double")
    middle = odd / F.lit(20.0)
    beyond = (middle * 16.0 - odd) + middle * 4.0
    up = (x > middle) | ((x == middle) & ((beyond > 0) | ((beyond == 0) & (k % 2 == 1))))
    return (k + up.cast("int")).cast("double") / F.lit(10.0)


def provider_error(text: Column, code: Column) -> Column:
    """struct(kind, delay): daily_quota, retry_after (with its seconds), service or other."""
    low = F.lower(text)
    limited = F.coalesce(code == 429, F.lit(False)) | F.contains(low, F.lit("429"))
    hint = F.nullif(F.regexp_extract(text, r"(?i)retry in\s+([0-9]+(?:\.[0-9]+)?)\s*s", 1), F.lit("")).try_cast("double")
    down = F.coalesce(code == 503, F.lit(False)) | F.contains(low, F.lit("503")) | F.contains(low, F.lit("overloaded")) | F.contains(low, F.lit("unavailable"))
    said = lambda kind, delay=F.lit(0.0): F.struct(F.lit(kind).alias("kind"), delay.alias("delay"))
    quota = F.when(F.contains(low, F.lit("per day")) | hint.isNull(), said("daily_quota")).otherwise(said("retry_after", hint))
    return F.when(limited, quota).when(down, said("service")).otherwise(said("other"))


def retry_hint(code: Column, text: Column, header: Column, most: float = 90.0) -> Column:
    """Seconds to wait after a limit of tokens per minute: the header's, else the text's ``try again in``; null if there is none up to ``most``."""
    low = F.lower(text)
    minute = F.contains(low, F.lit("tokens per minute")) | F.contains(low, F.lit("token per minute")) | F.contains(low, F.lit("tpm"))
    said = F.nullif(F.regexp_extract(low, r"try again in\s+([0-9]+(?:\.[0-9]+)?)\s*s", 1), F.lit("")).try_cast("double")
    bounded = lambda x: F.when((x > 0) & (x <= most), x)
    return F.when((code == 429) & ~F.contains(low, F.lit("per day")) & minute, F.coalesce(bounded(duration_seconds(header)), bounded(said)))


def retry_delay(header: Column, attempt: Column, now: Column) -> Column:
    """Seconds of a Retry-After header, a number or an HTTP date (not negative), else 2 to the power of ``attempt``."""
    number = header.try_cast("double")
    at = F.try_to_timestamp(F.regexp_replace(header, r"^[A-Za-z]{3}, (.*) GMT$", "$1"), F.lit("dd MMM yyyy HH:mm:ss"))
    date = F.when(header.rlike(r"^[A-Za-z]{3}, \d{2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} GMT$"), (F.unix_micros(at) - F.unix_micros(now)) / 1e6)
    said = F.coalesce(number, date)
    return F.when(said.isNotNull(), F.greatest(said, F.lit(0.0))).otherwise(F.pow(F.lit(2.0), attempt))


#: HTTP codes that are worth another try.
RETRIED_CODES = [429, 500, 502, 503, 504]


def network_error(status: Column, cause: Column) -> Column:
    """struct(kind, code, retryable) of a logged error: its HTTP status if there is one, else the kind of its cause."""
    said = lambda kind, code, again: F.struct(F.lit(kind).alias("kind"), (code if isinstance(code, Column) else F.lit(code)).alias("code"), (again if isinstance(again, Column) else F.lit(again)).alias("retryable"))
    out = F.when(status.isNotNull(), said("http", F.concat(F.lit("http_"), status.cast("string")), status.isin(RETRIED_CODES)))
    causes = {
        "certificate": ("tls_certificate", "certificate_verification_failed", False),
        "tls": ("tls_transport", "tls_error", True),
        "dns_again": ("dns", "dns_temporary", True),
        "dns": ("dns", "dns_permanent", False),
        "timeout": ("timeout", "timeout", True),
        "reset": ("connection", "connection_error", True),
        "refused": ("connection", "connection_error", True),
        "aborted": ("connection", "connection_error", True),
    }
    for name, found in causes.items():
        out = out.when(cause == name, said(*found))
    return out.otherwise(said("unknown", "network_error", False))


def error_class(kind: Column) -> Column:
    """The name of the error that a kind of :func:`provider_error` is raised as."""
    return F.when(kind.isin("daily_quota", "retry_after"), "DailyQuotaExhausted").when(kind == "service", "LlmServiceError").otherwise("LlmEvidenceError")


def min_year_default(today: Column, years: int = 3) -> Column:
    """The first of the last ``years`` years; the date comes from outside, so that reruns agree."""
    return F.year(today) - years + 1
