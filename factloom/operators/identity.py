"""What a fetched body is, and whether it is the paper's: decision lists over extracted columns.

Parsing a PDF is the caller's; these take its first page's text, its metadata and the paper's
own data as columns.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls

#: Limits, patterns, titles that say nothing.
MOST_BYTES = 25 * 1024 * 1024
DOI = r"10\.\d{4,9}/[^\s<>]+"
LABELLED_DOI = r"(?i)(?:doi\s*[:=]\s*|https?://doi\.org/)(10\.\d{4,9}/[^\s<>]+)"
ARXIV_MARK = r"(?i)arxiv\s*:\s*([A-Za-z0-9./-]+)"
NO_TITLES = ["untitled", "document", "microsoftword"]
NO_AUTHORS = ["unknown", "anonymous"]
LEAST_TITLE = 12


def decoded(body: Column) -> Column:
    """struct(body, reason) of bytes: unpacked if they are gzip; reason for what is too large, broken or empty."""

    def one(data: bytes | None) -> tuple[bytes | None, str | None]:
        data = data or b""
        if len(data) > MOST_BYTES:
            return None, "content_too_large"
        if data.startswith(b"\x1f\x8b"):
            try:
                stream = zlib.decompressobj(31)
                out = stream.decompress(data, MOST_BYTES + 1)
                if len(out) > MOST_BYTES:
                    return None, "decompressed_too_large"
                if not stream.eof:
                    return None, "invalid_gzip"
                data = out if not stream.unused_data else gzip.decompress(data)
            except (OSError, EOFError, zlib.error):
                return None, "invalid_gzip"
        return (data, None) if data else (None, "empty_content")

    schema = T.StructType([T.StructField("body", T.BinaryType()), T.StructField("reason", T.StringType())])

    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in bodies], columns=["body", "reason"])

    return F.pandas_udf(run, schema)(body)


def _dois(source: Column, pattern: str = DOI, group: int = 0) -> Column:
    """Distinct DOIs of a text in lower case, marks at their end left out."""
    found = F.regexp_extract_all(F.coalesce(source, F.lit("")), F.lit(pattern), F.lit(group))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, "[.,;)]+$", ""))))


def _first_line(page: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.split(page, "\n"), lambda x: F.btrim(x) != ""), F.lit(0)), F.lit(""))


def title_match(title: Column, metadata_title: Column, page: Column) -> Column:
    """Whether the paper's title is the metadata's, the first line, or, if it isn't short, anywhere on the page; case and marks aside."""
    plain = text.norm_alnum
    own = plain(title)
    return (own != "") & ((own == plain(F.coalesce(metadata_title, F.lit("")))) | (own == plain(_first_line(page))) | ((F.length(own) >= LEAST_TITLE) & F.contains(plain(page), own)))


def pdf_identity(is_pdf: Column, readable: Column, page: Column, metadata_title: Column, metadata: Column, title: Column, doi: Column) -> Column:
    """struct(format, identity): what a body is, and whether DOI or title make it the paper's."""
    said = lambda f, i: F.struct(F.lit(f).alias("format"), F.lit(i).alias("identity"))
    own = F.regexp_replace(F.lower(F.coalesce(doi, F.lit(""))), "^https://doi\\.org/", "")
    seen = _dois(F.concat_ws(" ", page, metadata))
    named = text.norm_alnum(F.coalesce(metadata_title, F.lit("")))
    out = F.when(~is_pdf, said("not_pdf", "unconfirmed")).when(~readable, said("invalid_pdf", "unconfirmed"))
    out = out.when((own != "") & F.array_contains(seen, own), said("valid_pdf", "confirmed")).when((own != "") & (F.size(seen) > 0), said("valid_pdf", "mismatch"))
    out = out.when(title_match(title, metadata_title, page), said("valid_pdf", "confirmed"))
    return out.when((F.coalesce(metadata_title, F.lit("")) != "") & ~named.isin(NO_TITLES), said("valid_pdf", "mismatch")).otherwise(said("valid_pdf", "unconfirmed"))


def inspected(page: Column, metadata_title: Column, metadata_author: Column, metadata: Column, title: Column, authors: Column, doi: Column, allowed_arxiv: Column, target: Column, url: Column, plain_identity: Column) -> Column:
    """struct(identity, version_match, evidence, revision): labelled DOIs, arXiv marks, title and author conflicts weighed together.

    ``authors`` and ``allowed_arxiv`` are arrays; ``target`` is the revision asked for and
    ``plain_identity`` what :func:`pdf_identity` found.  Contradictions are never settled by the title.
    """
    plain = text.norm_alnum
    labelled = F.array_union(_dois(page, LABELLED_DOI, 1), _dois(metadata))
    observed = _dois(page)
    marks = F.filter(F.transform(F.regexp_extract_all(page, F.lit(ARXIV_MARK), F.lit(1)), lambda x: urls.arxiv_id(x)), lambda x: x.isNotNull())
    titled = F.coalesce(title_match(title, metadata_title, page), F.lit(False))

    def decide(v: Column) -> Column:
        own = F.coalesce(doi, F.lit(""))
        derived = F.transform(allowed_arxiv, lambda x: F.concat(F.lit("10.48550/arxiv."), F.lower(x)))
        allowed = F.array_union(F.filter(F.array(doi), lambda x: x.isNotNull()), derived)
        author = F.exists(authors, lambda a: F.contains(plain(page), plain(a)))
        line = F.coalesce(F.nullif(metadata_author, F.lit("")), F.regexp_extract(page, r"(?im)^authors?\s*:\s*(.+)$", 1))
        author_conflict = (line != "") & ~plain(line).isin(NO_AUTHORS) & ~F.exists(authors, lambda a: F.contains(plain(line), plain(a)))
        named = plain(F.coalesce(metadata_title, F.lit("")))
        title_conflict = (F.coalesce(metadata_title, F.lit("")) != "") & ~named.isin(NO_TITLES) & (named != plain(title)) & ~v["titled"]
        strange = F.size(F.array_except(v["labelled"], allowed)) > 0
        mark = F.get(v["marks"], F.lit(0))
        ours = F.array_contains(allowed_arxiv, mark["base"])
        other_doi = (F.size(v["observed"]) > 0) & (own != "") & ~F.array_contains(v["observed"], own)
        fits = ours & v["titled"] & author & (F.size(F.array_except(v["observed"], allowed)) == 0)
        by_arxiv = F.when(other_doi, F.when(fits, "confirmed").otherwise("mismatch")).when(~ours, "mismatch").when(v["titled"] & ((plain_identity == "confirmed") | author), "confirmed").otherwise(plain_identity)
        conflict = (F.size(v["labelled"]) > 1) | strange | title_conflict | author_conflict
        several = F.size(F.array_distinct(F.transform(v["marks"], lambda x: F.concat_ws("v", x["base"], x["revision"])))) > 1
        has_mark = F.size(v["marks"]) > 0
        related = (F.size(v["labelled"]) > 0) & v["titled"] & author
        loose = (F.size(v["observed"]) > 0) & ((F.size(v["observed"]) > 1) | ~v["titled"])
        identity = (
            F.when(conflict, "mismatch")
            .when(several, "unconfirmed")
            .when(has_mark, by_arxiv)
            .when((own != "") & F.array_contains(v["labelled"], own), "confirmed")
            .when(related, "confirmed")
            .when(loose, F.when(F.size(F.array_except(v["observed"], allowed)) == 0, "unconfirmed").otherwise("mismatch"))
            .otherwise(plain_identity)
        )
        asked = urls.identifier(url)
        exact = F.coalesce((asked["scheme"] == "arxiv") & (asked["value"] == mark["base"]) & (asked["revision"] == mark["revision"]) & (target == mark["revision"]), F.lit(False))
        differs = F.coalesce(target != mark["revision"], F.lit(False)) | ((own != "") & ~F.contains(own, F.lit("arxiv.")))
        by_mark = has_mark & ~conflict & ~several
        match = F.when(by_mark & exact, "exact").when(by_mark & differs, "alternative").when(~conflict & ~has_mark & related & ~F.array_contains(v["labelled"], own), "alternative").otherwise("unknown")
        evidence = F.when(by_mark & exact, "official").when(by_mark, "pdf_observed").otherwise("unknown")
        fine = identity == "confirmed"
        return F.struct(identity.alias("identity"), F.when(fine, match).alias("version_match"), F.when(fine, evidence).alias("evidence"), F.when(fine & by_mark, mark["revision"]).alias("revision"))

    return urls.let(F.struct(labelled.alias("labelled"), observed.alias("observed"), marks.alias("marks"), titled.alias("titled")), decide)
