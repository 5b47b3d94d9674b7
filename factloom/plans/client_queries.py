"""Encoders, clients, bodies and identity as queries: stand-ins answer by rule, so SQL can say what comes out."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clients as K
from ..operators import identity as I
from ..operators import recovery
from ..sources import adapters as A
from ..sources import fulltext
from ..streaming import events as E
from .cases import by_case
from .queries import CHUNKS, _pairs, query


def letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for an encoder: how often three letters stand in a text."""
    return [[float(t.count(c)) for c in "aeq"] for t in texts]


def by_length(prompt: str, schema: dict | None) -> str:
    """A stand-in for a client: scores are lengths by some modulus; every third prompt's first answer is broken, to be repaired."""
    if "could not be used" not in prompt and len(prompt) % 3 == 0:
        return "```json\nnot an answer\n```"
    body = prompt.split("Evidence chunks:\n", 1)[1].split("\nThe answer below", 1)[0]
    rows = [(m[1], len(m[2])) for m in re.finditer(r"\[(\d+)\] [^:]*: (.*?)(?=\n\n\[\d+\] |$)", body, re.DOTALL)]
    names = list(schema["fields"])
    found = [{"chunk_id": i, **{n: schema["fields"][n][0] + (size + k) % 10 for k, n in enumerate(names)}} for i, size in rows]
    return json.dumps({"assessments": found})


_V = "v AS (SELECT *, [CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE), length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'q', ''))] AS v FROM chunks)"
_SENTENCE = "the quick brown"


def _query_vector() -> list[float]:
    return letters([K.QUERY_PREFIX + _SENTENCE])[0]


_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in _query_vector()) + "]"


def _vectors(spark, sf) -> DataFrame:
    return K.encode_chunks(A.chunks(spark, sf), letters)


@query(f"WITH {CHUNKS}, {_V} SELECT chunk_id, v[1] AS a, v[2] AS e, v[3] AS q FROM v")
def encode_chunks(spark, sf):
    return _vectors(spark, sf).select("chunk_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("e"), F.col("v")[2].alias("q"))


@query(f"SELECT item_id, CAST(length(t) - length(replace(t, 'a', '')) AS DOUBLE) AS a, CAST(length(t) - length(replace(t, 'q', '')) AS DOUBLE) AS q FROM (SELECT item_id, '{K.QUERY_PREFIX}' || text AS t FROM benchmark WHERE text IS NOT NULL)")
def encode_query(spark, sf):
    """Queries are encoded with the prefix that chunks don't have."""
    rows = A.read(spark, sf, "benchmark").filter("text is not null")
    v = K.encoded(F.concat(F.lit(K.QUERY_PREFIX), F.col("text")), letters)
    return rows.withColumn("v", v).select("item_id", F.col("v")[0].alias("a"), F.col("v")[2].alias("q"))


@query(f"WITH {CHUNKS}, {_V} SELECT chunk_id, list_dot_product(v, {_Q}) AS score FROM v")
def evid_semantic_cached(spark, sf):
    """Scores from vectors encoded before; the text isn't read again."""
    held = _vectors(spark, sf).select("chunk_id", "v")
    return K.semantic_scores(held, K.encode_query(_SENTENCE, letters)).select("chunk_id", "score")


@query(f"WITH {CHUNKS}, {_V} SELECT paper_id, chunk_id, list_dot_product(v, {_Q}) AS score FROM v ORDER BY score DESC, paper_id, chunk_id LIMIT 10")
def retrieve_local(spark, sf):
    docs = A.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return K.retrieve_local(docs, _SENTENCE, letters).select("paper_id", "chunk_id", "score")


@query("SELECT text, count(*) AS n, length(text) - length(replace(text, 'a', '')) AS a FROM documents WHERE text IS NOT NULL GROUP BY text")
def embed_cache(spark, sf):
    """Each distinct text is encoded once, and every row that has it gets the vector."""
    rows = A.read(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    return K.encode_chunks(rows, letters).groupBy("text").agg(F.count("*").alias("n"), F.first(F.col("v")[0]).cast("long").alias("a"))


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_id, CAST(length(text) % 10 AS INTEGER) AS utility_score FROM chunks")
def score_batches(spark, sf):
    return K.score_batches(A.chunks(spark, sf), _SENTENCE, by_length).select("paper_id", "chunk_id", "utility_score")


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_id, CAST(1 + length(text) % 10 AS INTEGER) AS relevance_score, CAST(1 + (length(text) + 1) % 10 AS INTEGER) AS quality_score FROM chunks")
def rcs(spark, sf):
    return K.rcs(A.chunks(spark, sf), _SENTENCE, by_length).select("paper_id", "chunk_id", "relevance_score", "quality_score")


@query(f"WITH {CHUNKS}, {_V}, t AS (SELECT *, list_dot_product(v, {_Q}) AS score FROM v ORDER BY score DESC, paper_id, chunk_id LIMIT 10) SELECT paper_id, chunk_id, CAST(1 + length(text) % 10 AS INTEGER) AS relevance_score FROM t")
def evidence_pipeline(spark, sf):
    docs = A.read(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    return K.evidence_pipeline(docs, _SENTENCE, letters, by_length).select("paper_id", "chunk_id", "relevance_score")


@query(f"WITH {CHUNKS}, b AS (SELECT paper_id, chunk_id, section, text, (row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) - 1) // 4 AS batch, (row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) - 1) % 4 + 1 AS idx FROM chunks) SELECT paper_id, batch, 'Rate.' || chr(10) || 'Research idea: {_SENTENCE}' || chr(10) || 'Evidence chunks:' || chr(10) || string_agg('[' || idx || '] ' || section || ': ' || text, chr(10) || chr(10) ORDER BY idx) AS prompt FROM b GROUP BY paper_id, batch")
def prompts(spark, sf):
    from ..operators import chunks as C

    batches = C.batch_fixed(A.chunks(spark, sf), ["paper_id"], ["chunk_id"], K.SCORE_BATCH).withColumn("idx", F.col("idx") + 1)
    return batches.groupBy("paper_id", "batch").agg(K.batch_prompt(_SENTENCE, "Rate.", ["idx"]).alias("prompt"))


def longer(prompt: str, schema: dict | None) -> str:
    """A stand-in for a judge: the longer text of each pair."""
    if "could not be used" not in prompt and len(prompt) % 2:
        return '{"verdicts": []}'
    pairs = re.findall(r"A: (.*)\nB: (.*)", prompt)
    return json.dumps({"verdicts": [{"winner": "tie" if len(a) == len(b) else "A" if len(a) > len(b) else "B"} for a, b in pairs]})


_JUDGED = """lex AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'view'),
emb AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
j AS (SELECT l.query_id, l.rank, length(CAST(l.chunk_id AS VARCHAR)) AS a, length(CAST(e.chunk_id AS VARCHAR)) AS b FROM lex l JOIN emb e ON l.query_id = e.query_id AND l.rank = e.rank WHERE l.chunk_id <> e.chunk_id)"""


def _texts(spark, sf) -> DataFrame:
    return _pairs(spark, sf).filter("kind = 'valid'").select("query_id", "rank", F.col("lexical_chunk").cast("string").alias("first"), F.col("embedding_chunk").cast("string").alias("second"))


@query(f"WITH {_JUDGED} SELECT query_id, rank, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS said FROM j")
def judge_batched(spark, sf):
    return K.judge_batched(_texts(spark, sf), longer)


@query(f"WITH {_JUDGED} SELECT query_id, rank, CASE WHEN a = b THEN 'tie' WHEN a > b THEN 'A' ELSE 'B' END AS said FROM j")
def judge_single(spark, sf):
    """One call for each pair."""
    return K.judge_single(_texts(spark, sf), longer)


def first_claim(prompt: str, schema: dict | None) -> str:
    """A stand-in for a writer: cites the first claim that it is given, and at first one that it isn't."""
    if "could not be used" not in prompt and len(prompt) % 2:
        return '{"report": "Says [claim-0]."}'
    cited = re.search(r"\[claim-[^\]]+\]", prompt)[0]
    return json.dumps({"report": f"Says {cited}."})


@query("""WITH c AS (SELECT conv_id, 'claim-' || (turn * 7 + 1) AS claim_id FROM conversations) SELECT conv_id AS section_index, 'Says [' || min(claim_id) || '].' AS report FROM c GROUP BY conv_id""")
def synth_llm(spark, sf):
    """Sections written from their own claims, one call and at most one repair each."""
    rows = A.read(spark, sf, "conversations").select(F.col("conv_id").alias("section_index"), F.concat(F.lit("claim-"), (F.col("turn") * 7 + 1).cast("string")).alias("claim_id"))
    sections = rows.groupBy("section_index").agg(F.collect_set("claim_id").alias("claim_ids")).withColumn("title", F.lit("T")).withColumn("purpose", F.lit("p"))
    claims = rows.select("claim_id").distinct().withColumn("text", F.lit("said"))
    return K.synthesised(sections, claims, first_claim).select("section_index", "report")


# ---- bodies and identity ----


def by_paragraph(content: bytes) -> list[str]:
    """A stand-in for a PDF parser: a page for each paragraph; bodies without any can't be read."""
    pages = content.decode().split("<p>")
    if len(pages) < 2:
        raise ValueError("no pages")
    return pages


@query(
    """WITH s AS (SELECT page_id, string_split(html, '<p>') AS parts FROM pages), p AS (SELECT page_id, generate_subscripts(parts, 1) AS page_number, trim(unnest(parts), E' \n\t\r') AS text, len(parts) AS n FROM s)
    SELECT page_id || '.pdf' AS paper_id, CAST(page_number AS INTEGER) AS page_number, length(text) AS size, 'parser 2' AS method FROM p WHERE length(text) >= 20 AND n > 1 UNION ALL
    SELECT page_id || '.pdf', NULL, NULL, CASE WHEN n = 1 THEN 'ValueError' ELSE 'NoText' END FROM p GROUP BY page_id, n HAVING max(length(text)) < 20 OR n = 1"""
)
def pdf_text(spark, sf):
    """Pages of 20 characters or more by the second of two parsers, as the first finds none."""
    files = A.read(spark, sf, "pages").select(F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit(".pdf")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    found = fulltext.page_texts(files, [lambda c: [], by_paragraph])
    return found.select("paper_id", "page_number", F.length("text").alias("size"), "method")


def by_url(url: str) -> bytes:
    """A stand-in for a fetcher: fails for URLs of an even length."""
    if len(url) % 2 == 0:
        raise TimeoutError
    return url.encode()


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 OR length(url) % 2 = 0 THEN NULL ELSE octet_length(encode(url)) END AS size, CASE WHEN page_id % 3 = 0 THEN 'invalid_url' WHEN length(url) % 2 = 0 THEN 'TimeoutError' ELSE 'transport_success' END AS reason FROM pages")
def fetch_pdf(spark, sf):
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("ftp"), "url")).otherwise(F.col("url"))
    return fulltext.fetch_bodies(A.read(spark, sf, "pages").select("page_id", url.alias("url")), by_url).select("page_id", F.octet_length("body").alias("size"), "reason")


def web_by_length(url: str) -> bytes:
    """A stand-in for the web: what a URL gives follows from its length, pages link to two PDFs."""
    kind = len(url) % 4
    if kind == 0:
        raise TimeoutError
    links = f'<html><a href="{url}-a.pdf">PDF</a><a href="{url}--b.pdf">PDF</a>'
    return {1: b"%PDF-1.7 the paper", 2: links.encode(), 3: b"%PDF-1.7 another"}[kind]


def _by_content(rows: DataFrame) -> DataFrame:
    body = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    return rows.withColumn("format", F.when(body.startswith("%PDF-"), "valid_pdf").otherwise("not_pdf")).withColumn("identity", F.when(body.endswith("the paper"), "confirmed").otherwise("mismatch"))


def _web(spark, sf) -> DataFrame:
    """Three locations of each page's paper: the provider's, another PDF's, a landing page."""
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(k).alias("place"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit(end)).alias("link")) for k, (s, end) in enumerate((("provider", ""), ("location", ".pdf"), ("landing_page", "/x")))]))
    return A.read(spark, sf, "pages").filter("url is not null").select(F.col("page_id").alias("paper_id"), at.alias("x")).select("paper_id", "x.source", "x.place", F.col("x.link").alias("url"))


#: What each round of a paper gives, by the length of its provider's URL (without query and fragment) modulo 4.
_ROUNDS_OF = """web AS (SELECT page_id AS paper_id, length(regexp_replace(url, '[?#].*$', '')) % 4 AS kind FROM pages WHERE url IS NOT NULL),
rounds AS (SELECT w.paper_id, r.* EXCLUDE (k) FROM web w JOIN (VALUES
  (1, 1, 'provider', 'downloaded'), (3, 1, 'provider', 'mismatch'), (3, 2, 'location', 'mismatch'), (3, 3, 'landing_page', 'downloaded'),
  (2, 1, 'provider', 'html_response'), (2, 2, 'location', 'html_response'), (2, 3, 'html_pdf', 'timeout'), (2, 4, 'html_pdf', 'downloaded'),
  (0, 1, 'provider', 'timeout'), (0, 2, 'location', 'timeout'), (0, 3, 'landing_page', 'html_response'), (0, 4, 'html_pdf', 'timeout')) AS r(k, round, source, reason) ON r.k = w.kind)"""


@query(f"WITH {_ROUNDS_OF} SELECT paper_id, round, source, reason FROM rounds")
def recover_rounds(spark, sf):
    """Every attempt of a recovery in rounds: locations, then links found on the way, to the first confirmed PDF or the end of the budget."""
    return recovery.recover(_web(spark, sf), web_by_length, _by_content, E.shared_folder(spark)).select("paper_id", "round", "source", "reason")


@query(f"WITH {_ROUNDS_OF} SELECT paper_id, CASE WHEN bool_or(reason = 'downloaded') THEN 'downloaded' ELSE 'recovery_exhausted' END AS outcome, max(round) AS rounds, max(source) FILTER (reason = 'downloaded') AS source FROM rounds GROUP BY paper_id")
def download_one(spark, sf):
    """What came of each paper's recovery."""
    locations = _web(spark, sf)
    return recovery.outcomes(locations, recovery.recover(locations, web_by_length, _by_content, E.shared_folder(spark)))


by_case(
    "decode_body",
    "pages",
    "page_id",
    {"reason": "VARCHAR", "size": "INTEGER"},
    [(("plain {i}", "text"), (None, None)), (("", "text"), ("empty_content", None)), (("H4sIAAAAAAAC/8tIzcnJBwCGphA2BQAAAA==", "base64"), (None, "5")), (("H4sIAAAAAAAC/8tIzcnJBw==", "base64"), ("invalid_gzip", None)), (("H4sI", "base64"), ("invalid_gzip", None))],
    lambda body, kind: (lambda d: {"reason": d["reason"], "size": F.when(kind == "base64", F.octet_length(d["body"]))})(I.decoded(F.when(kind == "base64", F.try_to_binary(body, F.lit("base64"))).otherwise(F.encode(body, "UTF-8")))),
)
by_case(
    "pdf_identity",
    "documents",
    "doc_id",
    {"format": "VARCHAR", "identity": "VARCHAR"},
    [
        (("n", "y", "", "", "", "T", "10.1234/a"), ("not_pdf", "unconfirmed")),
        (("y", "n", "", "", "", "T", "10.1234/a"), ("invalid_pdf", "unconfirmed")),
        (("y", "y", "A page, doi 10.1234/AB{i}.", "", "", "Some Title", "https://doi.org/10.1234/ab{i}"), ("valid_pdf", "confirmed")),
        (("y", "y", "A page, doi 10.1234/other", "Some Title", "", "Some Title", "10.1234/ab{i}"), ("valid_pdf", "mismatch")),
        (("y", "y", "Some   TITLE!\nby", "", "", "Some title", None), ("valid_pdf", "confirmed")),
        (("y", "y", "x\nwe cite: A Rather Long Title here", "", "", "A rather long title", None), ("valid_pdf", "confirmed")),
        (("y", "y", "x\nshort title", "", "", "short", None), ("valid_pdf", "unconfirmed")),
        (("y", "y", "nothing", "Another Work", "", "Some title", None), ("valid_pdf", "mismatch")),
        (("y", "y", "nothing", "Microsoft Word", "", "Some title", None), ("valid_pdf", "unconfirmed")),
    ],
    lambda pdf, fine, page, mt, meta, title, doi: {k: I.pdf_identity(pdf == "y", fine == "y", page, mt, meta, title, doi)[k] for k in ("format", "identity")},
)
by_case(
    "inspect_fulltext",
    "documents",
    "doc_id",
    {"identity": "VARCHAR", "version_match": "VARCHAR", "evidence": "VARCHAR"},
    [
        # page, metadata title, metadata author, title, doi, arXiv id known, revision asked for, URL, identity by DOI and title alone
        (("Long Paper Title\nAnn Lee\ndoi: 10.1234/ab", "", "", "Long Paper Title", "10.1234/ab", None, None, "https://e.org/x.pdf", "confirmed"), ("confirmed", "unknown", "unknown")),
        (("Long Paper Title\nAnn Lee\ndoi: 10.1234/ab and https://doi.org/10.1234/cd", "", "", "Long Paper Title", "10.1234/ab", None, None, "https://e.org/x.pdf", "confirmed"), ("mismatch", None, None)),
        (("Long Paper Title\nAnn Lee\narXiv:2001.00001v2", "", "", "Long Paper Title", None, "2001.00001", "v2", "https://arxiv.org/pdf/2001.00001v2", "confirmed"), ("confirmed", "exact", "official")),
        (("Long Paper Title\nAnn Lee\narXiv:2001.00001v1", "", "", "Long Paper Title", None, "2001.00001", "v2", "https://arxiv.org/pdf/2001.00001v2", "confirmed"), ("confirmed", "alternative", "pdf_observed")),
        (("Long Paper Title\nAnn Lee\narXiv:2001.00009v1", "", "", "Long Paper Title", None, "2001.00001", None, "https://e.org/x.pdf", "confirmed"), ("mismatch", None, None)),
        (("Long Paper Title\nAnn Lee\narXiv:2001.00001 arXiv:2001.00002", "", "", "Long Paper Title", None, "2001.00001", None, "https://e.org/x.pdf", "confirmed"), ("unconfirmed", None, None)),
        (("Long Paper Title\nAuthors: Someone Else", "", "", "Long Paper Title", None, None, None, "https://e.org/x.pdf", "confirmed"), ("mismatch", None, None)),
        (("Long Paper Title\nx", "Other Name", "Ann Lee", "Entirely different", None, None, None, "https://e.org/x.pdf", "mismatch"), ("mismatch", None, None)),
        (("Long Paper Title\nsee 10.1234/zz", "", "unknown", "Long Paper Title", None, None, None, "https://e.org/x.pdf", "confirmed"), ("confirmed", "unknown", "unknown")),
        (("Other words\nsee 10.1234/zz", "", "", "Long Paper Title", None, None, None, "https://e.org/x.pdf", "unconfirmed"), ("mismatch", None, None)),
    ],
    lambda page, mt, ma, title, doi, arxiv, target, url, plain: (
        lambda found: {k: found[k] for k in ("identity", "version_match", "evidence")}
    )(I.inspected(page, mt, ma, F.lit(""), title, F.array(F.lit("Ann Lee"), F.lit("Bo Li")), doi, F.filter(F.array(arxiv), lambda x: x.isNotNull()), target, url, plain)),
)
