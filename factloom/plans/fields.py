"""Queries of single columns, provider records, locations and small joins, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text, urls
from ..operators import papers as P
from ..operators import records as R
from ..sources import adapters as A
from .queries import CHUNKS, PAPERS, RANKED, WORD, _ranked, query


def _id() -> Column:
    return F.col("paper_id").cast("string")


def _pick(value: Column, *choices: Column) -> Column:
    """The choice at ``value`` modulo the number of choices."""
    out = choices[-1]
    for i, c in reversed(list(enumerate(choices[:-1]))):
        out = F.when(value % len(choices) == i, c).otherwise(out)
    return out


# ---- names, titles, identifiers ----


@query("SELECT regexp_replace(lower(source), '[^a-z0-9]', '', 'g') AS venue, count(*) AS n FROM documents GROUP BY 1")
def norm_venue(spark, sf):
    return A.papers(spark, sf).groupBy(text.norm_venue(F.col("venue")).alias("venue")).agg(F.count("*").alias("n"))


@query(f"WITH {PAPERS} SELECT paper_id, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title_key FROM papers")
def norm_title_ws(spark, sf):
    return A.papers(spark, sf).select("paper_id", text.norm_title(F.col("title")).alias("title_key"))


@query(f"WITH {PAPERS} SELECT paper_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS title_key FROM papers")
def norm_title_alnum(spark, sf):
    return A.papers(spark, sf).select("paper_id", text.norm_alnum(F.col("title")).alias("title_key"))


@query("SELECT doc_id AS paper_id, CASE WHEN doc_id % 3 < 2 THEN '10.1/a' || doc_id END AS doi FROM documents")
def norm_doi(spark, sf):
    raw = _pick(F.col("paper_id"), F.concat(F.lit(" https://doi.org/10.1/A"), _id()), F.concat(F.lit("DOI:10.1/A"), _id()), F.lit("doi: "))
    return A.papers(spark, sf).select("paper_id", text.norm_doi(raw).alias("doi"))


@query("SELECT doc_id AS paper_id, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 THEN '20' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '.' || lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0') END AS base, CASE WHEN doc_id % 14 BETWEEN 1 AND 12 AND doc_id % 3 > 0 THEN 'v' || (doc_id % 3) END AS revision FROM documents")
def arxiv_id(spark, sf):
    i = F.col("paper_id")
    revision = F.when(i % 3 > 0, F.concat(F.lit("v"), (i % 3).cast("string"))).otherwise("")
    raw = F.concat(F.lit("arXiv:20"), F.lpad((i % 14).cast("string"), 2, "0"), F.lit("."), F.lpad((i % 100000).cast("string"), 5, "0"), revision)
    found = urls.arxiv_id(raw)
    return A.papers(spark, sf).select("paper_id", found["base"].alias("base"), found["revision"].alias("revision"))


# ---- texts ----


@query(f"WITH {PAPERS} SELECT paper_id, len(regexp_extract_all(title, '{WORD}')) BETWEEN 2 AND 4 AS ok FROM papers")
def short_query_ok(spark, sf):
    return A.papers(spark, sf).select("paper_id", text.short_query_ok(F.col("title")).alias("ok"))


@query("SELECT doc_id AS paper_id, substr(sha256(text), 1, 8) AS slot, sha256(text) AS whole FROM documents")
def key_slot(spark, sf):
    return A.papers(spark, sf).select("paper_id", text.key_slot(F.col("abstract")).alias("slot"), text.key_slot(F.col("abstract"), 64).alias("whole"))


@query(f"WITH {CHUNKS} SELECT chunk_id, substr(text, 1, 240) AS quote, (length(text) + 3) // 4 AS tokens FROM chunks")
def quote240(spark, sf):
    return A.chunks(spark, sf).select("chunk_id", text.quote(F.col("text")).alias("quote"), text.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id AS paper_id, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS n FROM documents")
def word_count(spark, sf):
    return A.papers(spark, sf).select("paper_id", text.word_count(F.col("abstract")).alias("n"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id / 1000 WHEN 1 THEN event_id * 1.0 WHEN 2 THEN event_id * 60.0 WHEN 3 THEN event_id * 1.0 END AS seconds FROM events")
def duration_parse(spark, sf):
    n = F.col("event_id").cast("string")
    raw = _pick(F.col("event_id"), F.concat(n, F.lit("ms")), F.concat(n, F.lit("s")), F.concat(n, F.lit("m")), n, F.concat(n, F.lit(" hours")))
    return A.read(spark, sf, "events").select("event_id", scores.duration_seconds(raw).alias("seconds"))


@query(f"WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE regexp_matches(section || ' ' || text, '(?i)(limitation|future\\s+work|fails?\\s+to|does\\s+not|remains\\s+(un)?(explor|solv|address)|lack\\s+of)')")
def limitation_cue(spark, sf):
    return A.chunks(spark, sf).filter(text.limitation_cue(F.concat_ws(" ", "section", "text"))).select("chunk_id")


@query(f"WITH {CHUNKS} SELECT chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS place FROM chunks WHERE length(trim(text)) >= 20 AND len(regexp_extract_all(text, '{WORD}')) >= 4")
def min_chars(spark, sf):
    kept = A.chunks(spark, sf).filter((F.length(F.btrim("text")) >= 20) & (text.word_count(F.col("text")) >= 4))
    return kept.select("chunk_id", F.row_number().over(W.partitionBy("paper_id").orderBy("ord")).alias("place"))


# ---- locations ----

_LOC = "loc AS (SELECT page_id, regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS host, CASE WHEN page_id % 3 = 0 THEN 'published' WHEN page_id % 3 = 1 THEN 'accepted' ELSE 'submitted' END AS version FROM pages)"


def _locations(spark, sf) -> DataFrame:
    version = _pick(F.col("page_id"), F.lit("published"), F.lit("accepted"), F.lit("submitted"))
    return A.read(spark, sf, "pages").select("page_id", urls.pdf_host(F.col("url")).alias("host"), version.alias("version"))


@query(f"WITH {_LOC} SELECT host, page_id, row_number() OVER (PARTITION BY host ORDER BY CASE version WHEN 'published' THEN 0 WHEN 'accepted' THEN 1 ELSE 2 END, page_id) AS place FROM loc")
def unpaywall_order(spark, sf):
    return _locations(spark, sf).select("host", "page_id", F.row_number().over(W.partitionBy("host").orderBy(R.version_order(F.col("version")), "page_id")).alias("place"))


# ---- small joins and choices ----


@query(f"WITH {PAPERS}, {RANKED} SELECT paper_id, score FROM ranked WHERE score >= 1.0")
def filter_min_score(spark, sf):
    return _ranked(spark, sf).filter("score >= 1.0").select("paper_id", "score")


@query(f"WITH {PAPERS}, {RANKED} SELECT paper_id FROM ranked WHERE score * 1.5 * 10 / 3 > 7 AND 4 + CASE WHEN coalesce(venue, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(citation_count, 0) >= 10 THEN 2 ELSE 0 END + CASE WHEN coalesce(citation_count, 0) >= 100 THEN 2 ELSE 0 END >= 6")
def usable_only(spark, sf):
    return P.assess(_ranked(spark, sf).withColumn("score", F.col("score") * 1.5)).filter("include").select("paper_id")


@query(f"WITH {PAPERS}, {CHUNKS} SELECT c.chunk_id, coalesce(CAST(p.citation_count AS VARCHAR), 'n/a') AS citations, coalesce(p.venue, 'n/a') AS venue FROM chunks c LEFT JOIN papers p ON c.paper_id = p.paper_id")
def join_meta_prompt(spark, sf):
    meta = A.papers(spark, sf).select("paper_id", F.col("citation_count").cast("string").alias("citations"), "venue")
    joined = A.chunks(spark, sf).select("paper_id", "chunk_id").join(meta, "paper_id", "left")
    return joined.select("chunk_id", F.coalesce("citations", F.lit("n/a")).alias("citations"), F.coalesce("venue", F.lit("n/a")).alias("venue"))


@query("SELECT split_part(text, '.', 1) AS title, arg_max(doc_id % 4, doc_id) AS query_group, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1")
def join_paper_query(spark, sf):
    return A.papers(spark, sf).filter("title is not null").groupBy("title").agg(F.max_by("query_group", "ord").alias("query_group"), F.min("ord").alias("first_id"))


@query(f"WITH {PAPERS}, k AS (SELECT query_group, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS q, min(ord) AS ord FROM papers GROUP BY 1, 2) SELECT query_group, q, row_number() OVER (PARTITION BY query_group ORDER BY ord) AS place FROM k QUALIFY place <= 5")
def dedup_plan_queries(spark, sf):
    once = A.papers(spark, sf).groupBy("query_group", text.norm_title(F.col("title")).alias("q")).agg(F.min("ord").alias("ord"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("query_group").orderBy("ord"))).filter("place <= 5").select("query_group", "q", "place")


@query(f"WITH {CHUNKS} SELECT chunk_id, paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY utility DESC, ord % 3 DESC, chunk_id) AS place FROM chunks")
def rerank_rcs(spark, sf):
    order = W.partitionBy("paper_id").orderBy(F.desc("utility"), F.desc(F.col("ord") % 3), "chunk_id")
    return A.chunks(spark, sf).select("chunk_id", "paper_id", F.row_number().over(order).alias("place"))
