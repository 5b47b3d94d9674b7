"""The operators as queries over whole tables, each with the same thing said in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, sections, text, urls
from ..operators import batching
from ..operators import chunks as C
from ..operators import decisions as D
from ..operators import pacing
from ..operators import papers as P
from ..operators import providers as R
from ..operators import state as S
from ..sources import adapters as A
from ..sources import sinks
from ..streaming import events as E
from ..streaming import pacing as streamed_pacing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
TERMS = ["retrieval", "the", "tion", "queue"]

PAPERS = """papers AS (
  SELECT doc_id AS paper_id, split_part(text, '.', 1) AS title, text AS abstract, CAST(2015 + doc_id % 12 AS INTEGER) AS year,
         CASE WHEN doc_id % 7 <> 0 THEN CAST((doc_id * 37) % 1500 AS INTEGER) END AS citation_count, source AS venue,
         doc_id % 4 AS query_group, doc_id AS ord, lang FROM documents)"""
CHUNKS = rf"""split AS (SELECT doc_id AS paper_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents),
starts AS (SELECT paper_id, ws, len(ws) AS n, unnest(range(0, len(ws), 220)) AS s FROM split WHERE len(ws) >= 4),
chunks AS (
  SELECT paper_id, s // 220 + 1 AS ord, array_to_string(ws[s + 1 : s + 250], ' ') AS text,
         paper_id || '-p1-1-c' || (s // 220 + 1) AS chunk_id,
         ['Abstract', '1 Introduction', '2 Related Work', '3 Method', '4 Experiments', '5 Results', '6 Limitations', 'References', 'Appendix'][(s // 220) % 9 + 1] AS section,
         (paper_id * 13 + (s // 220 + 1) * 7) % 11 AS utility
  FROM starts WHERE (s = 0 OR s - 220 + 250 < n) AND n - s >= 4)"""
CITES = "least(ln(1 + coalesce(citation_count, 0)) / ln(1001.0), 1.0)"
RECENCY = "least(greatest((year - 2020) / 10.0, 0.0), 1.0)"


def _hits(column: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in TERMS)


SCORE = f"(3 * ({_hits('title')}) + ({_hits('abstract')})) / {4.0 * len(TERMS)} + {CITES} + {RECENCY}"
RANKED = f"""scored AS (SELECT *, {SCORE} AS raw FROM papers),
ranked AS (SELECT *, round(raw, 9) AS score, row_number() OVER (PARTITION BY query_group ORDER BY round(raw, 9) DESC, coalesce(citation_count, 0) DESC, year DESC, ord) AS rank FROM scored)"""


def sql_round1(x: str) -> str:
    """One decimal place by the exact binary value, ties to the even tenth."""
    k, odd = f"floor(({x}) * 10)", f"(2 * floor(({x}) * 10) + 1)"
    m = f"({odd} / 20.0::DOUBLE)"
    beyond = f"(({m} * 16.0::DOUBLE - {odd}) + {m} * 4.0::DOUBLE)"
    return f"(({k} + CASE WHEN ({x}) > {m} OR (({x}) = {m} AND ({beyond} > 0 OR ({beyond} = 0 AND CAST({k} AS BIGINT) % 2 = 1))) THEN 1 ELSE 0 END) / 10.0::DOUBLE)"


_UTILITY = "0.7::DOUBLE * max(utility) + (1 - 0.7::DOUBLE) * (CAST(sum(utility) AS DOUBLE) / count(*))"
_SHRUNK = lambda c: f"(count(*)::DOUBLE * (CAST(sum({c}) AS DOUBLE) / count(*)::DOUBLE) + 5.5::DOUBLE) / (count(*)::DOUBLE + 1.0::DOUBLE)"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Papers with a lexical score, to 9 places so that both engines agree on ties, and its rank by group."""
    papers = A.papers(spark, sf)
    score = scores.lexical_score(TERMS, F.col("title"), F.col("abstract")) + scores.citation_score(F.col("citation_count")) + scores.recency_score(F.col("year"))
    scored = papers.withColumn("score", F.round(score, 9)).drop("title", "abstract")  # texts don't go along
    return P._ranked(scored, ["query_group"])


# ---- filters, de-duplication, ranking, selection ----


@query(f"WITH {PAPERS} SELECT paper_id, CASE WHEN year < 2017 THEN 'year_before_min' WHEN year > 2025 THEN 'year_after_max' WHEN coalesce(citation_count, 0) < 50 THEN 'citation_below_min' WHEN NOT (contains(regexp_replace(lower(venue), '[^a-z0-9]', '', 'g'), 'src1')) THEN 'venue_not_allowed' END AS reason FROM papers")
def filter_chain_reasons(spark, sf):
    policy = P.FilterPolicy(2017, 2025, 50, ("src1",))
    return A.papers(spark, sf).select("paper_id", P.filter_reason(policy).alias("reason"))


@query(f"WITH {PAPERS} SELECT paper_id, year FROM papers WHERE year BETWEEN 2018 AND 2024")
def filter_year(spark, sf):
    return A.papers(spark, sf).filter(P.filter_reason(P.FilterPolicy(2018, 2024)).isNull()).select("paper_id", "year")


@query(f"WITH {PAPERS} SELECT paper_id FROM papers WHERE coalesce(citation_count, 0) >= 100")
def filter_citations(spark, sf):
    return A.papers(spark, sf).filter(P.filter_reason(P.FilterPolicy(min_citations=100)).isNull()).select("paper_id")


@query(f"WITH {PAPERS} SELECT venue, count(*) AS n FROM papers WHERE contains(lower(venue), 'src1') OR contains(lower(venue), 'src7') GROUP BY venue")
def filter_venue(spark, sf):
    return A.papers(spark, sf).filter(P.filter_reason(P.FilterPolicy(venues=("src1", "src7"))).isNull()).groupBy("venue").agg(F.count("*").alias("n"))


@query(f"WITH {PAPERS} SELECT count(*) AS n, count(*) FILTER (length(trim(abstract)) >= 20) AS usable FROM papers")
def filter_abstract(spark, sf):
    return A.papers(spark, sf).agg(F.count("*").alias("n"), F.count_if(text.usable_abstract(F.col("abstract"))).alias("usable"))


_DEDUP = """keyed AS (SELECT *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) AS title_key FROM papers),
marked AS (SELECT *, min(ord) OVER (PARTITION BY title_key) AS pos,
  row_number() OVER (PARTITION BY title_key ORDER BY coalesce(citation_count, 0) DESC, CASE WHEN venue IS NOT NULL THEN 1 ELSE 0 END DESC, length(abstract) DESC, year DESC, ord) = 1 AS is_winner FROM keyed)"""


@query(f"WITH {PAPERS}, {_DEDUP} SELECT paper_id, pos FROM marked WHERE is_winner")
def dedup_title(spark, sf):
    return P.dedup_title(A.papers(spark, sf)).filter("is_winner").select("paper_id", "pos")


@query(f"WITH {PAPERS}, {_DEDUP} SELECT l.paper_id, w.paper_id AS related_id FROM marked l JOIN marked w ON l.title_key = w.title_key AND w.is_winner WHERE NOT l.is_winner")
def dup_titles_audit(spark, sf):
    marked = P.dedup_title(A.papers(spark, sf))
    winners = marked.filter("is_winner").select("title_key", F.col("paper_id").alias("related_id"))
    return marked.filter("not is_winner").join(winners, "title_key").select("paper_id", "related_id")


@query(f"WITH {PAPERS}, {RANKED} SELECT paper_id, query_group, rank, score FROM ranked")
def rank_lexical(spark, sf):
    return _ranked(spark, sf).select("paper_id", "query_group", "rank", "score")


@query(f"WITH {PAPERS}, kept AS (SELECT * FROM papers WHERE year BETWEEN 2016 AND 2026), {_DEDUP.replace('FROM papers', 'FROM kept')}, {RANKED.replace('FROM papers', 'FROM marked WHERE is_winner')} SELECT paper_id, query_group, rank, score FROM ranked")
def filter_and_rank(spark, sf):
    score = scores.lexical_score(TERMS, F.col("title"), F.col("abstract")) + scores.citation_score(F.col("citation_count")) + scores.recency_score(F.col("year"))
    scored = A.papers(spark, sf).withColumn("score", F.round(score, 9)).withColumn("abstract_length", F.length("abstract")).drop("abstract")
    kept = P.filter_chain(scored, P.FilterPolicy(2016, 2026))
    return P._ranked(kept.drop("title"), ["query_group"]).select("paper_id", "query_group", "rank", "score")


@query(f"WITH {PAPERS}, {RANKED} SELECT paper_id, score FROM ranked WHERE score >= 1.0 ORDER BY score DESC, coalesce(citation_count, 0) DESC, year DESC, ord LIMIT 20")
def select_top(spark, sf):
    return _ranked(spark, sf).filter("score >= 1.0").orderBy(F.desc("score"), F.desc(F.coalesce("citation_count", F.lit(0))), F.desc("year"), "ord").limit(20).select("paper_id", "score")


@query(f"WITH {PAPERS}, {RANKED}, a AS (SELECT paper_id, CAST(least(greatest(ceil(score * 10 / 3), 1), 10) AS INTEGER) AS relevance, CAST(least(4 + CASE WHEN coalesce(venue, '') <> '' THEN 2 ELSE 0 END + CASE WHEN coalesce(citation_count, 0) >= 10 THEN 2 ELSE 0 END + CASE WHEN coalesce(citation_count, 0) >= 100 THEN 2 ELSE 0 END, 10) AS INTEGER) AS quality FROM ranked) SELECT *, relevance >= 8 AND quality >= 6 AS include FROM a")
def assess_meta(spark, sf):
    return P.assess(_ranked(spark, sf)).select("paper_id", "relevance", "quality", "include")


@query(f"""WITH {PAPERS}, {RANKED}, base AS (SELECT *, count(*) OVER g AS n, max(year) OVER g AS newest,
 row_number() OVER (PARTITION BY query_group ORDER BY coalesce(citation_count, 0) DESC, rank) AS cpos FROM ranked WINDOW g AS (PARTITION BY query_group)),
pct AS (SELECT *, CASE WHEN n <= 1 THEN 0.0 ELSE CAST(rank - 1 AS DOUBLE) / (n - 1) END AS rp, CASE WHEN n <= 1 THEN 0.0 ELSE CAST(cpos - 1 AS DOUBLE) / (n - 1) END AS cp FROM base),
t AS (SELECT *, rp <= 0.20 AND cp <= 0.30 AND citation_count IS NOT NULL AS ta, rp <= 0.50 AND year >= newest - 1 AS tb, rp BETWEEN 0.40 AND 0.70 AND cp <= 0.30 AND citation_count IS NOT NULL AS tc FROM pct),
c AS (SELECT *, sum(ta::INT) OVER o AS ca, sum(tb::INT) OVER o AS cb, sum(tc::INT) OVER o AS cc FROM t WINDOW o AS (PARTITION BY query_group ORDER BY rank)),
r AS (SELECT paper_id, query_group, rank, CASE WHEN n <= 24 THEN 'all' WHEN ta AND ca <= 6 THEN 'a' WHEN tb AND cb <= 12 THEN 'b' WHEN tc AND cc <= 6 THEN 'c' END AS bucket FROM c)
SELECT * FROM r WHERE bucket IS NOT NULL""")
def bucket_sample(spark, sf):
    return P.bucket_sample(_ranked(spark, sf), ["query_group"]).select("paper_id", "query_group", "rank", "bucket")


@query(f"""WITH {PAPERS}, {RANKED}, base AS (SELECT *, count(*) OVER g AS n, max(year) OVER g AS newest, row_number() OVER (PARTITION BY query_group ORDER BY coalesce(citation_count, 0) DESC, rank) AS cpos FROM ranked WINDOW g AS (PARTITION BY query_group)),
pct AS (SELECT *, CASE WHEN n <= 1 THEN 0.0 ELSE CAST(rank - 1 AS DOUBLE) / (n - 1) END AS rp, CASE WHEN n <= 1 THEN 0.0 ELSE CAST(cpos - 1 AS DOUBLE) / (n - 1) END AS cp FROM base)
SELECT paper_id, query_group, rp <= 0.20 AND cp <= 0.30 AND citation_count IS NOT NULL AS is_a, rp <= 0.50 AND year >= newest - 1 AS is_b, rp BETWEEN 0.40 AND 0.70 AND cp <= 0.30 AND citation_count IS NOT NULL AS is_c FROM pct""")
def bucket_predicates(spark, sf):
    return P.bucket_flags(_ranked(spark, sf), ["query_group"]).select("paper_id", "query_group", "is_a", "is_b", "is_c")


@query(f"""WITH {PAPERS}, reasons AS (SELECT *, CASE WHEN year < 2017 THEN 'year_before_min' WHEN coalesce(citation_count, 0) < 50 THEN 'citation_below_min' END AS reason FROM papers), {_DEDUP.replace('FROM papers', 'FROM reasons WHERE reason IS NULL')}
SELECT paper_id, reason FROM reasons WHERE reason IS NOT NULL UNION ALL SELECT paper_id, CASE WHEN NOT is_winner THEN 'duplicate_title' END FROM marked""")
def filter_chain(spark, sf):
    """Every paper with the reason why it goes, a title that another paper wins among them; null if it stays."""
    return P.filter_audit(A.papers(spark, sf), P.FilterPolicy(2017, min_citations=50)).select("paper_id", "reason")


@query(f"WITH {PAPERS} SELECT paper_id, round({CITES}, 9) AS citation_score, {RECENCY} AS recency_score FROM papers")
def citation_and_recency(spark, sf):
    return A.papers(spark, sf).select("paper_id", F.round(scores.citation_score(F.col("citation_count")), 9).alias("citation_score"), scores.recency_score(F.col("year")).alias("recency_score"))


# ---- vectors ----

_V = "v AS (SELECT vec_id AS chunk_id, label AS paper_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT v AS qv FROM v WHERE chunk_id = (SELECT min(chunk_id) FROM v)), s AS (SELECT chunk_id, paper_id, round(list_dot_product(v, qv), 9) AS score FROM v, q)"


def _scored_vectors(spark, sf) -> DataFrame:
    v = A.vectors(spark, sf)
    q = v.orderBy("chunk_id").limit(1).select(F.col("v").alias("qv"))  # one row: a broadcast of fixed size
    return v.crossJoin(F.broadcast(q)).select("chunk_id", "paper_id", F.round(scores.dot(F.col("v"), F.col("qv")), 9).alias("score"))


@query(f"WITH {_V} SELECT chunk_id, score FROM s", "dot")
def dot_product(spark, sf):
    return _scored_vectors(spark, sf).select("chunk_id", "score")


@query("WITH v AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), q AS (SELECT chunk_id AS query_id, v AS qv FROM v ORDER BY chunk_id LIMIT 3) SELECT query_id, chunk_id, round(list_dot_product(v, qv), 9) AS score FROM v, q")
def cross_score(spark, sf):
    """Every chunk against each of a few queries' vectors, which are three rows here and broadcast."""
    v = A.vectors(spark, sf)
    few = v.orderBy("chunk_id").limit(3).select(F.col("chunk_id").alias("query_id"), F.col("v").alias("qv"))
    return v.crossJoin(F.broadcast(few)).select("query_id", "chunk_id", F.round(scores.dot(F.col("v"), F.col("qv")), 9).alias("score"))


@query(f"WITH {_V} SELECT chunk_id, score FROM s ORDER BY score DESC, paper_id, chunk_id LIMIT 10")
def evid_semantic(spark, sf):
    return C.top_capped(_scored_vectors(spark, sf), 10, None, "paper_id", ["paper_id", "chunk_id"]).select("chunk_id", "score")


@query(f"WITH {_V}, c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, paper_id, chunk_id) AS place FROM s) SELECT chunk_id, paper_id, score FROM c WHERE place <= 2 ORDER BY score DESC, paper_id, chunk_id LIMIT 15")
def evid_semantic_cap(spark, sf):
    return C.top_capped(_scored_vectors(spark, sf), 15, 2, "paper_id", ["paper_id", "chunk_id"])


@query(f"WITH {_V}, c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY score DESC, chunk_id) AS place FROM s) SELECT chunk_id, paper_id, score, place FROM c WHERE place <= 2")
def sample_top_per_paper(spark, sf):
    return C.sample_top(_scored_vectors(spark, sf), 2)


@query(f"WITH {_V}, p AS (SELECT chunk_id, paper_id, 2015 + chunk_id % 12 AS year, CAST((chunk_id * 37) % 1500 AS INTEGER) AS citation_count, score FROM s), r AS (SELECT chunk_id, round(0.5 * greatest(score, 0.0) + 0.5 * greatest(-score, 0.0) + {CITES} + {RECENCY}, 9) AS score, citation_count, year FROM p) SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, citation_count DESC, year DESC, chunk_id) AS rank FROM r")
def rank_semantic(spark, sf):
    s = _scored_vectors(spark, sf).withColumn("year", 2015 + F.col("chunk_id") % 12).withColumn("citation_count", ((F.col("chunk_id") * 37) % 1500).cast("int")).withColumn("ord", F.col("chunk_id"))
    parts = P.rank_semantic(s.withColumnRenamed("score", "sim"), F.col("sim"), -F.col("sim"), 0.5).drop("rank")
    return P._ranked(parts.withColumn("score", F.round("score", 9)), None).select("chunk_id", "score", "rank")


# ---- chunks ----


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_id, ord, text FROM chunks")
def chunk_words(spark, sf):
    return A.chunks(spark, sf).select("paper_id", "chunk_id", "ord", "text")


@query(f"WITH {CHUNKS}, s AS (SELECT paper_id, chunk_id, " + " + ".join(f"least(CAST((length(lower(text)) - length(replace(lower(text), '{t}', ''))) // {len(t)} AS BIGINT), 3)" for t in TERMS) + " AS score FROM chunks) SELECT paper_id, chunk_id, score FROM s ORDER BY score DESC, paper_id, chunk_id LIMIT 25")
def evid_lexical(spark, sf):
    return C.evidence_lexical(A.chunks(spark, sf), TERMS, 25).select("paper_id", "chunk_id", "score")


_CATEGORY = "CASE section WHEN 'Abstract' THEN 'context' WHEN '1 Introduction' THEN 'context' WHEN '2 Related Work' THEN 'context' WHEN '3 Method' THEN 'method' WHEN '4 Experiments' THEN CASE WHEN regexp_matches(text, '(?i)\\b(?:datasets?|baselines?|metrics?|protocol|hyperparameters?|implementation details|training setup)\\b') THEN 'evaluation_setup' ELSE 'results' END WHEN '5 Results' THEN 'results' WHEN '6 Limitations' THEN 'limitations_future' ELSE 'other' END"
_CLASS = "CASE section WHEN 'Abstract' THEN 1 WHEN '1 Introduction' THEN 9 WHEN '2 Related Work' THEN 11 WHEN '3 Method' THEN 7 WHEN '4 Experiments' THEN 5 WHEN '5 Results' THEN 4 WHEN '6 Limitations' THEN 2 WHEN 'References' THEN 14 ELSE 13 END"


def _categorised(spark, sf) -> DataFrame:
    return A.chunks(spark, sf).withColumn("category", sections.category(F.col("section"), F.col("text"))).withColumn("score", F.col("utility")).withColumn("is_abstract", sections.has_heading(F.col("section"), "abstract"))


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_id, {_CATEGORY} AS category FROM chunks")
def class_category(spark, sf):
    return _categorised(spark, sf).select("paper_id", "chunk_id", "category")


@query(f"WITH {CHUNKS} SELECT chunk_id, CAST({_CLASS} AS INTEGER) AS priority FROM chunks")
def class_chunk(spark, sf):
    return A.chunks(spark, sf).select("chunk_id", sections.chunk_class(F.col("section"), F.col("text"))["priority"].cast("int").alias("priority"))


@query(f"WITH {CHUNKS}, k AS (SELECT paper_id, {_CATEGORY} AS category FROM chunks) SELECT paper_id, category, count(*) AS n, 1 AS papers FROM k GROUP BY paper_id, category UNION ALL SELECT NULL, category, count(*), count(DISTINCT paper_id) FROM k GROUP BY category")
def section_dist(spark, sf):
    """Chunks by paper and category, and in one pass by category over all papers (paper_id null) with the number of papers."""
    per = _categorised(spark, sf).rollup("category", "paper_id").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"))
    return per.filter("category is not null").select("paper_id", "category", "n", "papers")


@query(f"WITH {CHUNKS} SELECT paper_id, chunk_id FROM chunks WHERE section <> 'References'")
def drop_noise(spark, sf):
    return A.chunks(spark, sf).filter(~sections.is_noise(F.col("section"), F.col("text"))).select("paper_id", "chunk_id")


@query(f"""WITH {CHUNKS}, k AS (SELECT *, {_CATEGORY} AS category FROM chunks), m AS (SELECT *, row_number() OVER (PARTITION BY paper_id, category ORDER BY utility DESC, chunk_id) AS c FROM k),
s AS (SELECT paper_id, chunk_id, category, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN category = 'method' AND c = 1 THEN 1 WHEN category = 'results' AND c = 1 THEN 2 ELSE 3 END, utility DESC, chunk_id) AS slot FROM m)
SELECT * FROM s WHERE slot <= 2""")
def sample_formal_scoring(spark, sf):
    return C.sample_scoring(_categorised(spark, sf)).select("paper_id", "chunk_id", "category", "slot")


@query(f"""WITH {CHUNKS}, k AS (SELECT *, {_CATEGORY} AS category, section = 'Abstract' AS is_abstract FROM chunks),
f AS (SELECT *, CASE WHEN is_abstract THEN 0 WHEN category = 'context' THEN 1 ELSE 2 END AS front FROM k),
m AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY front, utility DESC, chunk_id) = 1 AND front < 2 AS first,
  row_number() OVER (PARTITION BY paper_id, category ORDER BY utility DESC, chunk_id) AS c FROM f),
o AS (SELECT *, CASE WHEN first THEN 0 WHEN category = 'method' AND c <= 2 THEN 1 + c WHEN category = 'evaluation_setup' AND c <= 2 THEN 3 + c WHEN category = 'results' AND c <= 2 THEN 5 + c WHEN category = 'limitations_future' AND c <= 2 THEN 7 + c WHEN category = 'other' THEN 20 END AS place FROM m),
s AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY place, utility DESC, chunk_id) AS slot FROM o WHERE place IS NOT NULL)
SELECT * FROM s WHERE slot <= 9""")
def sample_formal_notes(spark, sf):
    return C.sample_notes(_categorised(spark, sf)).select("paper_id", "chunk_id", "slot")


@query(f"""WITH {CHUNKS}, i AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) - 1 AS idx, {_CLASS} AS p FROM chunks),
b AS (SELECT *, min(CASE WHEN section = 'References' THEN idx END) OVER (PARTITION BY paper_id) AS refs, min(CASE WHEN section = 'Appendix' THEN idx END) OVER (PARTITION BY paper_id) AS app FROM i),
r AS (SELECT *, CASE WHEN refs IS NULL THEN CASE WHEN app IS NULL OR idx <= app THEN p ELSE 13 END WHEN app IS NULL THEN CASE WHEN idx < refs THEN p ELSE 14 END
  WHEN refs < app THEN CASE WHEN idx < refs THEN p WHEN idx < app THEN 14 ELSE 13 END ELSE CASE WHEN idx < app THEN p WHEN idx < refs THEN 13 ELSE 14 END END AS priority FROM b),
t AS (SELECT paper_id, chunk_id, CAST(priority AS INTEGER) AS priority, row_number() OVER (PARTITION BY paper_id ORDER BY priority, idx) AS place FROM r)
SELECT paper_id, chunk_id, priority FROM t WHERE place <= 6""")
def coverage_pack(spark, sf):
    chunks = A.chunks(spark, sf).withColumn("page_start", F.lit(1)).withColumn("page_end", F.lit(1))
    return C.coverage_pack(chunks).select("paper_id", "chunk_id", F.col("priority").cast("int").alias("priority"))


@query(f"WITH {CHUNKS}, b AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS i FROM chunks) SELECT paper_id, chunk_id, i // 4 AS batch, i % 4 AS idx FROM b")
def batch_fixed(spark, sf):
    return C.batch_fixed(A.chunks(spark, sf), ["paper_id"], ["ord"]).select("paper_id", "chunk_id", "batch", "idx")


@query(f"WITH {CHUNKS}, b AS (SELECT paper_id, chunk_id, row_number() OVER (PARTITION BY paper_id ORDER BY ord) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY paper_id) // 3) AS stride FROM chunks) SELECT paper_id, chunk_id FROM b WHERE i % stride = 0 AND i // stride < 3")
def strided(spark, sf):
    return C.strided(A.chunks(spark, sf), "paper_id", ["ord"], 3).select("paper_id", "chunk_id")


@query(
    f"""WITH RECURSIVE {CHUNKS}, sized AS (SELECT paper_id, chunk_id, ord, (length(text) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY paper_id ORDER BY ord) AS n FROM chunks),
    batched AS (
      SELECT paper_id, chunk_id, ord, tokens, n, tokens AS used, CAST(0 AS BIGINT) AS batch FROM sized WHERE n = 1 UNION ALL
      SELECT s.paper_id, s.chunk_id, s.ord, s.tokens, s.n, CASE WHEN b.used + s.tokens > 3000 THEN s.tokens ELSE b.used + s.tokens END, b.batch + CAST(b.used + s.tokens > 3000 AS BIGINT)
      FROM batched b JOIN sized s ON s.paper_id = b.paper_id AND s.n = b.n + 1)
    SELECT paper_id, chunk_id, ord, tokens, batch FROM batched"""
)
def batch_tokens_screen(spark, sf):
    """Chunks in order in batches of up to 3,000 estimated tokens."""
    rows = A.chunks(spark, sf).select("paper_id", "chunk_id", "ord", text.token_estimate(F.col("text")).alias("tokens"))
    return batching.batch_tokens(rows, "paper_id", ["ord"], 3000)


@query(
    """WITH RECURSIVE sized AS (SELECT event_id, event_type, CAST(abs(value) * 100 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
    batched AS (
      SELECT event_id, event_type, tokens, n, tokens AS used, CAST(0 AS BIGINT) AS batch FROM sized WHERE n = 1 UNION ALL
      SELECT s.event_id, s.event_type, s.tokens, s.n, CASE WHEN b.used + s.tokens > 25000 THEN s.tokens ELSE b.used + s.tokens END, b.batch + CAST(b.used + s.tokens > 25000 AS BIGINT)
      FROM batched b JOIN sized s ON s.event_type = b.event_type AND s.n = b.n + 1)
    SELECT event_id, event_type, tokens, batch FROM batched"""
)
def batch_tokens_events(spark, sf):
    """A few keys of many rows each, every key in several pieces."""
    rows = A.read(spark, sf, "events").select("event_id", "event_type", F.round(F.abs("value") * 100).cast("long").alias("tokens"))
    return batching.batch_tokens(rows, "event_type", ["event_id"], 25000)


@query(rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD}')) AS BIGINT) AS words, (length(text) + 3) // 4 AS tokens, substr(text, 1, 240) AS quote, substr(sha256(text), 1, 8) AS slot, regexp_matches(text, '(?i)(?:limitation|future\s+work|fails?\s+to|does\s+not|remains\s+(?:un)?(?:explor|solv|address)|lack\s+of)') AS cue FROM documents")
def text_measures(spark, sf):
    t = F.col("text")
    return A.read(spark, sf, "documents").select("doc_id", text.word_count(t).alias("words"), text.token_estimate(t).alias("tokens"), text.quote(t).alias("quote"), text.key_slot(t).alias("slot"), text.limitation_cue(t).alias("cue"))


@query(rf"WITH t AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('a','an','and','for','in','of','on','the','to','with')) AS w FROM benchmark), u AS (SELECT item_id, unnest(w) AS term FROM t) SELECT DISTINCT item_id, term FROM u")
def query_terms(spark, sf):
    return A.read(spark, sf, "benchmark").select("item_id", F.explode(text.query_terms(F.col("text"))).alias("term"))


@query(rf"WITH w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws FROM documents) SELECT doc_id, array_to_string(ws, ' ') AS abstract FROM w")
def abstract_round_trip(spark, sf):
    """An inverted index, word to positions, and the text again from it, row by row: nothing is shuffled."""
    again = R.inverted_abstract(R.inverted_index(text.words(F.col("text"))))
    return A.read(spark, sf, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce(again, F.lit(""))).alias("abstract"))


# ---- decisions ----


@query(f"WITH {CHUNKS}, b AS (SELECT paper_id, {_UTILITY} AS x, round((7 * max(utility) * count(*) + 3 * sum(utility)) / count(*), 6) AS score_tenths, count(*) AS n_samples, array_to_string(list(chunk_id ORDER BY chunk_id), ',') AS citations FROM chunks GROUP BY paper_id) SELECT paper_id, {sql_round1('x')} AS utility, score_tenths, n_samples, citations FROM b")
def agg_functional(spark, sf):
    out = D.agg_functional(A.chunks(spark, sf))
    return out.select("paper_id", "utility", F.round("score_tenths", 6).alias("score_tenths"), "n_samples", F.array_join("citations", ",").alias("citations"))


@query(f"WITH {CHUNKS}, b AS (SELECT paper_id, {_SHRUNK('utility')} AS x FROM chunks GROUP BY paper_id) SELECT paper_id, {sql_round1('x')} AS shrunk FROM b")
def agg_shrunk(spark, sf):
    return D.agg_shrunk(A.chunks(spark, sf), "utility")


@query(f"WITH {CHUNKS}, s AS (SELECT paper_id, {_SHRUNK('utility')} AS rel, {_SHRUNK('10 - utility')} AS qual FROM chunks GROUP BY paper_id), r AS (SELECT paper_id, {sql_round1('rel')} AS relevance, {sql_round1('qual')} AS quality FROM s) SELECT paper_id, relevance, quality, relevance >= 6.0 AS include FROM r")
def agg_rcs(spark, sf):
    c = A.chunks(spark, sf).withColumn("other", 10 - F.col("utility"))
    both = D.agg_shrunk(c, "utility").withColumnRenamed("shrunk", "relevance").join(D.agg_shrunk(c, "other").withColumnRenamed("shrunk", "quality"), "paper_id")
    return both.select("paper_id", "relevance", "quality", (F.col("relevance") >= 6.0).alias("include"))


_SCORED = f"u AS (SELECT paper_id, {_UTILITY} AS x FROM chunks GROUP BY paper_id), g AS (SELECT paper_id, paper_id % 4 AS query_group, {sql_round1('x')} AS score FROM u)"


def _functional(spark, sf) -> DataFrame:
    return D.agg_functional(A.chunks(spark, sf)).select("paper_id", (F.col("paper_id") % 4).alias("query_group"), F.col("utility").alias("score"))


@query(f"WITH {CHUNKS}, {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_group ORDER BY score DESC, paper_id) AS rank, CASE WHEN query_group = 3 THEN 1 ELSE 2 END AS quota FROM g) SELECT paper_id, query_group, rank, rank <= quota AND score >= 6.0 AS include, concat_ws(',', CASE WHEN score < 6.0 THEN 'threshold_not_met' END, CASE WHEN rank > quota THEN 'quota_not_selected' END) AS reasons FROM r")
def quota_threshold(spark, sf):
    quota = F.when(F.col("query_group") == 3, 1).otherwise(2)
    return D.quota_threshold(_functional(spark, sf), "query_group", quota, 6.0).select("paper_id", "query_group", "rank", "include", "reasons")


@query(f"WITH {CHUNKS}, {_SCORED} SELECT paper_id, score FROM g ORDER BY score DESC, paper_id LIMIT 1")
def best_fallback(spark, sf):
    return _functional(spark, sf).orderBy(F.desc("score"), "paper_id").limit(1).select("paper_id", "score")


_SCREEN = "screened AS (SELECT doc_id AS paper_id, CASE WHEN toxic = 1 THEN 'reject' WHEN quality = 1 THEN 'keep' ELSE 'maybe' END AS priority FROM labels)"


@query(f"WITH {PAPERS}, {_SCREEN} SELECT p.paper_id FROM papers p ANTI JOIN screened s ON p.paper_id = s.paper_id")
def anti_missing(spark, sf):
    return D.missing(A.papers(spark, sf).select("paper_id"), A.screened(spark, sf), ["paper_id"])


@query(f"WITH {PAPERS}, {_SCREEN} SELECT p.paper_id, coalesce(s.priority, 'exclude') AS priority, CASE WHEN s.priority IS NULL THEN CAST(1.0 AS DOUBLE) END AS score FROM papers p LEFT JOIN screened s ON p.paper_id = s.paper_id")
def anti_unscored(spark, sf):
    """Papers without a decision come out as excluded with score 1.0."""
    papers, screened = A.papers(spark, sf).select("paper_id"), A.screened(spark, sf)
    left = D.missing(papers, screened, ["paper_id"]).select("paper_id", F.lit("exclude").alias("priority"), F.lit(1.0).alias("score"))
    return screened.join(papers, "paper_id").select("paper_id", "priority", F.lit(None).cast("double").alias("score")).unionByName(left)


@query(f"WITH {PAPERS}, s AS (SELECT paper_id, count(*) AS supplied FROM papers GROUP BY 1), r AS (SELECT doc_id AS paper_id, count(*) AS returned FROM labels GROUP BY 1) SELECT coalesce(s.paper_id, r.paper_id) AS paper_id, coalesce(supplied, 0) AS supplied, coalesce(returned, 0) AS returned FROM s FULL JOIN r ON s.paper_id = r.paper_id WHERE coalesce(supplied, 0) <> 1 OR coalesce(returned, 0) <> 1")
def set_coverage(spark, sf):
    return D.exactly_once(A.papers(spark, sf), A.screened(spark, sf), ["paper_id"])


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def reject_dup_ids(spark, sf):
    return D.duplicates(A.read(spark, sf, "documents"), ["text"])


@query(f"WITH {PAPERS}, {RANKED}, {_SCREEN}, x AS (SELECT r.paper_id, query_group, rank, priority, r.paper_id % 3 <> 0 AS success FROM ranked r JOIN screened s ON r.paper_id = s.paper_id), k AS (SELECT *, sum(CASE WHEN priority = 'keep' AND success THEN 1 ELSE 0 END) OVER (PARTITION BY query_group) AS kept FROM x), m AS (SELECT *, kept + coalesce(sum(success::INT) OVER (PARTITION BY query_group ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k WHERE priority = 'maybe') SELECT paper_id, priority, success FROM k WHERE priority = 'keep' UNION ALL SELECT paper_id, priority, success FROM m WHERE before < 2000")
def keep_maybe_fill(spark, sf):
    rows = _ranked(spark, sf).join(A.screened(spark, sf), "paper_id").withColumn("success", F.col("paper_id") % 3 != 0)
    return D.keep_maybe_fill(rows, "query_group", 2000).select("paper_id", "priority", "success")


@query(f"WITH {PAPERS}, {RANKED}, b AS (SELECT paper_id, query_group, coalesce(sum((paper_id % 3 <> 0)::INT) OVER (PARTITION BY query_group ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ranked) SELECT paper_id, query_group FROM b WHERE before < 5")
def backfill_topn(spark, sf):
    rows = _ranked(spark, sf).withColumn("success", F.col("paper_id") % 3 != 0)
    return D.until_target(rows, "query_group", ["rank"], 5).select("paper_id", "query_group")


@query(f"WITH {PAPERS} SELECT count(DISTINCT query_group) AS queries, CAST(ceil(20.0 / count(DISTINCT query_group)) AS BIGINT) AS target FROM papers")
def per_query_target(spark, sf):
    n = F.count_distinct("query_group")
    return A.papers(spark, sf).agg(n.alias("queries"), F.ceil(F.lit(20.0) / n).alias("target"))


# ---- evaluation ----

_PAIRS = """lex AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE event_type <> 'view'),
emb AS (SELECT user_id AS query_id, event_id AS chunk_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
pairs AS (SELECT coalesce(l.query_id, e.query_id) AS query_id, coalesce(l.rank, e.rank) AS rank, l.chunk_id AS lexical_chunk, e.chunk_id AS embedding_chunk,
  CASE WHEN l.chunk_id IS NULL OR e.chunk_id IS NULL THEN 'unpaired' WHEN l.chunk_id = e.chunk_id THEN 'same_chunk' ELSE 'valid' END AS kind
  FROM lex l FULL JOIN emb e ON l.query_id = e.query_id AND l.rank = e.rank)"""


def _pairs(spark, sf) -> DataFrame:
    ranked = lambda e: e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    events = A.read(spark, sf, "events")
    return D.pair_ranked(ranked(events.filter("event_type <> 'view'")), ranked(events))


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def join_pair_rank(spark, sf):
    return _pairs(spark, sf).select("query_id", "rank", "lexical_chunk", "embedding_chunk", "kind")


_WINNER = "CASE WHEN lexical_chunk % 3 = 0 THEN 'tie' WHEN (lexical_chunk % 3 = 1) = (rank % 2 = 0) THEN 'lexical' ELSE 'embedding' END"
_WINS = f"""won AS (SELECT *, CASE WHEN kind = 'valid' THEN {_WINNER} END AS winner FROM pairs),
w AS (SELECT query_id, count(*) FILTER (kind = 'valid') AS valid_pairs, count(*) FILTER (kind = 'same_chunk') AS same_chunk_ties, count(*) FILTER (kind = 'unpaired') AS unpaired,
  count(*) FILTER (winner = 'embedding') AS embedding_wins, count(*) FILTER (winner = 'lexical') AS lexical_wins, count(*) FILTER (winner = 'tie') AS judge_ties FROM won GROUP BY query_id),
rated AS (SELECT *, CAST(embedding_wins AS DOUBLE) / nullif(embedding_wins + lexical_wins, 0) AS win_rate_embedding FROM w),
verdicts AS (SELECT *, CASE WHEN valid_pairs < 3 THEN 'insufficient' WHEN win_rate_embedding IS NULL THEN 'comparable' WHEN win_rate_embedding >= 0.6 THEN 'embedding better' WHEN win_rate_embedding <= 0.4 THEN 'lexical better' ELSE 'comparable' END AS verdict FROM rated)"""


def _judged(spark, sf) -> DataFrame:
    """Pairs with the winner of valid ones; the judge says A, B or tie, and which method is A goes by rank."""
    said = F.when(F.col("lexical_chunk") % 3 == 0, "tie").when(F.col("lexical_chunk") % 3 == 1, "A").otherwise("B")
    shown = F.when(F.col("rank") % 2 == 0, "lexical").otherwise("embedding")
    return _pairs(spark, sf).withColumn("winner", F.when(F.col("kind") == "valid", D.pair_winner(said, shown)))


@query(f"WITH {_PAIRS}, {_WINS} SELECT query_id, rank, winner FROM won WHERE winner IS NOT NULL")
def pairwise_winner(spark, sf):
    return _judged(spark, sf).filter("winner is not null").select("query_id", "rank", "winner")


@query(f"WITH {_PAIRS}, {_WINS} SELECT * FROM verdicts")
def agg_pair_query(spark, sf):
    return D.pair_verdicts(_judged(spark, sf), "query_id")


@query(f"WITH {_PAIRS}, {_WINS}, t AS (SELECT count(*) FILTER (verdict = 'lexical better') AS lexical, count(*) FILTER (verdict = 'embedding better') AS embedding FROM verdicts) SELECT *, CASE WHEN embedding > lexical THEN 'embedding better' WHEN lexical > embedding THEN 'lexical better' ELSE 'comparable overall' END AS overall FROM t")
def agg_pair_overall(spark, sf):
    return D.pair_overall(D.pair_verdicts(_judged(spark, sf), "query_id"))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT 'shared' AS part, user_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', user_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'only_b', user_id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def set_overlap(spark, sf):
    events = A.read(spark, sf, "events")
    a, b = (events.filter(F.col("event_type") == k).select("user_id").distinct() for k in ("view", "click"))
    parts = {"shared": a.intersect(b), "only_a": a.subtract(b), "only_b": b.subtract(a)}
    out = None
    for name, rows in parts.items():
        part = rows.select(F.lit(name).alias("part"), "user_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_PAIRS}, s AS (SELECT avg(lexical_chunk % 11) AS lexical, avg(embedding_chunk % 11) AS embedding FROM pairs WHERE kind <> 'unpaired') SELECT round(lexical, 9) AS avg_lexical, round(embedding, 9) AS avg_embedding, CASE WHEN embedding - lexical >= 0.5 THEN 'embedding better' WHEN embedding - lexical <= -0.5 THEN 'lexical better' ELSE 'comparable' END AS verdict FROM s")
def agg_compare(spark, sf):
    """Two methods' mean scores over all ranks that both filled, and the verdict."""
    both = _pairs(spark, sf).filter("kind <> 'unpaired'")
    out = both.agg(F.avg(F.col("lexical_chunk") % 11).alias("a"), F.avg(F.col("embedding_chunk") % 11).alias("b"))
    return out.select(F.round("a", 9).alias("avg_lexical"), F.round("b", 9).alias("avg_embedding"), D.mean_verdict(F.col("a"), F.col("b")).alias("verdict"))


_PLANS = """t AS (SELECT item_id, item_id // 5 AS plan_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) >= 3 AND x NOT IN ('a','an','and','for','in','of','on','the','to','with'))) AS w FROM benchmark),
p AS (SELECT a.plan_id, a.item_id AS a, b.item_id AS b, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE CAST(len(list_intersect(a.w, b.w)) AS DOUBLE) / len(list_distinct(list_concat(a.w, b.w))) END AS j FROM t a JOIN t b ON a.plan_id = b.plan_id AND a.item_id < b.item_id)"""


def _plan_pairs(spark, sf) -> DataFrame:
    """Pairs of a plan's queries, of which a plan has five here: an equi-join by plan."""
    items = A.read(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 5).alias("plan_id"), "item_id", text.query_terms(F.col("text")).alias("w"))
    other = items.select("plan_id", F.col("item_id").alias("other"), F.col("w").alias("x"))
    return items.join(other, "plan_id").filter("item_id < other").select("plan_id", F.col("item_id").alias("a"), F.col("other").alias("b"), scores.jaccard(F.col("w"), F.col("x")).alias("j"))


@query(f"WITH {_PLANS} SELECT plan_id, a, b, round(j, 9) AS overlap FROM p")
def cross_pairs(spark, sf):
    return _plan_pairs(spark, sf).select("plan_id", "a", "b", F.round("j", 9).alias("overlap"))


@query(f"WITH {_PLANS} SELECT plan_id, round(max(j), 9) AS max_overlap, count(*) AS pairs FROM p GROUP BY plan_id")
def max_overlap(spark, sf):
    """The largest Jaccard overlap of two queries of each plan."""
    return _plan_pairs(spark, sf).groupBy("plan_id").agg(F.round(F.max("j"), 9).alias("max_overlap"), F.count("*").alias("pairs"))


# ---- claims ----

_CLAIMS = "c AS (SELECT conv_id AS paper_id, turn, text, row_number() OVER (ORDER BY conv_id, turn) AS claim_no FROM conversations)"


@query(f"WITH {_CLAIMS} SELECT paper_id, turn, 'claim-' || claim_no AS claim_id FROM c")
def claim_number(spark, sf):
    rows = A.read(spark, sf, "conversations").withColumnRenamed("conv_id", "paper_id")
    return D.number_claims(rows, "paper_id", ["turn"]).select("paper_id", "turn", F.concat(F.lit("claim-"), F.col("claim_no").cast("string")).alias("claim_id"))


@query("SELECT conv_id, array_to_string(list_sort(list_distinct(list(role || '-' || turn))), ',') AS chunks FROM conversations GROUP BY conv_id")
def claim_chunks(spark, sf):
    rows = A.read(spark, sf, "conversations")
    return rows.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("role", F.lit("-"), F.col("turn").cast("string")))), ",").alias("chunks"))


@query("SELECT conv_id, '# ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn) AS report FROM conversations GROUP BY conv_id")
def report_join(spark, sf):
    rows = A.read(spark, sf, "conversations").withColumn("part", F.concat(F.lit("## "), "role", F.lit("\n"), "text"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part"))), lambda x: x["part"]), "\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("# "), F.first("conv_id").cast("string"), F.lit("\n"), body).alias("report"))


@query(
    """WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS place, regexp_extract(url, '\\?([^#]*)', 1) AS query, url FROM pages)
    SELECT page_id, place || CASE WHEN query <> '' THEN '?' || array_to_string(list_sort(string_split(query, '&')), '&') ELSE '' END AS canonical, place AS sanitized, regexp_matches(url, '^https?://[^/@]+(/|$)') AS usable FROM u"""
)
def page_urls(spark, sf):
    """The URL rules over every page's own URL: canonical, fit to be stored, usable."""
    url = F.col("url")
    return A.read(spark, sf, "pages").select("page_id", urls.canonical_url(url).alias("canonical"), urls.sanitize_url(url).alias("sanitized"), urls.is_http_url(url).alias("usable"))


# ---- logs ----


@query("SELECT event_id, sum(CAST(abs(value) * 100 AS BIGINT)) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS used FROM events")
def tpm_window(spark, sf):
    events = A.read(spark, sf, "events").withColumn("tokens", F.round(F.abs("value") * 100).cast("long"))
    return D.token_window(events, "event_type", 60).select("event_id", "used")


#: The log's 30 days replayed in an hour, each user with a key of 7,700 tokens a minute.
_REQUESTS = "requests AS (SELECT event_id, user_id, epoch_us(ts) // 720 AS came, CAST(abs(value) * 100 AS BIGINT) AS tokens FROM events)"


def _requests(events: DataFrame) -> DataFrame:
    return events.select("event_id", "user_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 720).alias("at"), F.round(F.abs("value") * 100).cast("long").alias("tokens"))


_ADMISSION = f"""WITH RECURSIVE {_REQUESTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY came, event_id) AS n FROM requests),
asked AS (
  SELECT CAST(NULL AS BIGINT) AS event_id, user_id, 0 AS n, CAST(NULL AS BIGINT) AS admitted_at, CAST(NULL AS BIGINT) AS wait, CAST(NULL AS BIGINT) AS used,
         CAST(-1 AS BIGINT) AS last, CAST([] AS STRUCT(t BIGINT, k BIGINT)[]) AS held FROM (SELECT DISTINCT user_id FROM requests)
  UNION ALL
  SELECT event_id, user_id, n, CASE WHEN fits THEN go END, CASE WHEN fits THEN go - came END, CASE WHEN fits THEN CAST(coalesce(list_sum(list_transform(list_filter(live, lambda e: go - e.t < 60000000), lambda e: e.k)), 0) AS BIGINT) END,
         CASE WHEN fits THEN go ELSE last END,
         CASE WHEN fits THEN list_append(list_filter(live, lambda e: go - e.t < 60000000), {{'t': go, 'k': tokens}}) ELSE held END
  FROM (
    SELECT *, CASE WHEN need <= 0 THEN now ELSE greatest(now + 100000, live[list_min(list_filter(range(1, len(live) + 1), lambda k: list_sum(list_transform(live[1:k], lambda e: e.k)) >= need))].t + 60000000) END AS go
    FROM (
      SELECT *, coalesce(list_sum(list_transform(live, lambda e: e.k)), 0) + tokens - 7700 AS need
      FROM (
        SELECT r.event_id, r.user_id, r.n, r.came, r.tokens, a.last, a.held, r.tokens <= 7700 AS fits, greatest(r.came, a.last) AS now,
               list_filter(a.held, lambda e: greatest(r.came, a.last) - e.t < 60000000) AS live
        FROM asked a JOIN numbered r ON r.user_id = a.user_id AND r.n = a.n + 1))))
SELECT event_id, admitted_at, wait, used FROM asked WHERE n > 0"""


@query(_ADMISSION)
def tpm_admission(spark, sf):
    """When each request goes that 60 seconds' tokens have to leave room for; one above the budget is refused."""
    return pacing.admitted(_requests(A.read(spark, sf, "events")), "user_id", "at", "event_id", 7700).select("event_id", "admitted_at", "wait", "used")


@query(_ADMISSION)
def stream_tpm_admission(spark, sf):
    """The same with the window of each key as a stream's state."""
    stream = _requests(E.read_stream(spark, f"{sf}/events.parquet"))
    return streamed_pacing.admitted(stream, "user_id", "at", "event_id", 7700, E.shared_folder(spark)).select("event_id", "admitted_at", "wait", "used")


@query(
    """WITH RECURSIVE numbered AS (SELECT event_id, event_type, epoch_us(ts) AS came, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
called AS (
  SELECT CAST(NULL AS BIGINT) AS event_id, event_type, 0 AS n, CAST(NULL AS BIGINT) AS slot, CAST(NULL AS BIGINT) AS call_at, CAST(NULL AS BIGINT) AS nth,
         CAST(-1 AS BIGINT) AS day, CAST([0, 0, 0] AS BIGINT[]) AS free, CAST([0, 0, 0] AS BIGINT[]) AS calls FROM (SELECT DISTINCT event_type FROM events)
  UNION ALL
  SELECT event_id, event_type, n, k - 1, CASE WHEN k IS NOT NULL THEN greatest(came, free[k]) END, CASE WHEN k IS NOT NULL THEN calls[k] + 1 END, day,
         list_transform([1, 2, 3], lambda i: CASE WHEN i = k THEN greatest(came, free[k]) + 13000000 ELSE free[i] END),
         list_transform([1, 2, 3], lambda i: calls[i] + CAST(coalesce(i = k, false) AS BIGINT))
  FROM (
    SELECT event_id, event_type, n, came, day, free, calls,
           list_sort(list_filter([{'f': greatest(free[1], came), 'i': 1, 'c': calls[1]}, {'f': greatest(free[2], came), 'i': 2, 'c': calls[2]}, {'f': greatest(free[3], came), 'i': 3, 'c': calls[3]}], lambda x: x.c < 20))[1].i AS k
    FROM (
      SELECT r.event_id, r.event_type, r.n, r.came, r.came // 86400000000 AS day, c.free, CASE WHEN r.came // 86400000000 = c.day THEN c.calls ELSE CAST([0, 0, 0] AS BIGINT[]) END AS calls
      FROM called c JOIN numbered r ON r.event_type = c.event_type AND r.n = c.n + 1)))
SELECT event_id, slot, call_at, nth FROM called WHERE n > 0"""
)
def rate_schedule(spark, sf):
    """Each call's key of three, the time it goes and its number of that key's day; refused once all have had 20."""
    calls = A.read(spark, sf, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return pacing.scheduled(calls, "event_type", "at", "event_id", 3).select("event_id", "slot", "call_at", "nth")


@query("SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS nth FROM events")
def rate_gap(spark, sf):
    return D.request_gaps(A.read(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "gap", "nth")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) AS received FROM events GROUP BY user_id")
def agg_stage_counts(spark, sf):
    kind = F.col("event_type")
    return A.read(spark, sf, "events").groupBy("user_id").agg(*[F.count_if(kind == k).alias(f"{k}s") for k in ("view", "click", "purchase")], F.count("*").alias("received"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def dispositions(spark, sf):
    return D.last_by(A.read(spark, sf, "events"), ["user_id"], "event_id").select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedup_first_decision(spark, sf):
    return D.first_by(A.read(spark, sf, "events"), ["user_id"], ["event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT count(*) AS events, count(DISTINCT (user_id, event_type)) AS keys, count(DISTINCT user_id) AS users FROM events")
def agg_candidate_totals(spark, sf):
    return A.read(spark, sf, "events").agg(F.count("*").alias("events"), F.count_distinct("user_id", "event_type").alias("keys"), F.count_distinct("user_id").alias("users"))


# ---- pages and URLs ----


@query(r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*href\s*=\s*["'']([^"'']+)["'']', 1)) AS link FROM pages) SELECT page_id, link, count(*) AS n FROM l GROUP BY ALL""")
def html_anchors(spark, sf):
    return A.read(spark, sf, "pages").select("page_id", F.explode(urls.anchors(F.col("html"))).alias("link")).groupBy("page_id", "link").agg(F.count("*").alias("n"))


@query(r"SELECT regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1) AS host, count(*) AS n, count(*) FILTER (regexp_matches(url, '^https?://')) AS http FROM pages GROUP BY 1")
def pdf_host(spark, sf):
    u = F.col("url")
    return A.read(spark, sf, "pages").groupBy(urls.pdf_host(u).alias("host")).agg(F.count("*").alias("n"), F.count_if(urls.is_http_url(u)).alias("http"))


# ---- joins between provider and download records ----


@query(f"WITH {PAPERS}, {_SCREEN} SELECT p.paper_id, p.query_group, s.priority, s.priority IS NULL AS warning FROM papers p LEFT JOIN screened s ON p.paper_id = s.paper_id")
def sink_make_papers(spark, sf):
    papers = A.papers(spark, sf).select("paper_id", "query_group")
    return papers.join(A.screened(spark, sf), "paper_id", "left").withColumn("warning", F.col("priority").isNull())


@query(f"WITH {PAPERS}, {_SCREEN} SELECT p.paper_id, p.title, p.year, p.citation_count, p.venue, s.priority FROM papers p LEFT JOIN screened s ON p.paper_id = s.paper_id")
def sink_papers(spark, sf):
    """Papers published with the event log, read back from what was published."""
    papers = A.papers(spark, sf).select("paper_id", "title", "year", "citation_count", "venue").join(A.screened(spark, sf), "paper_id", "left")
    papers = papers.withColumns({"url": F.lit(None).cast("string"), "pdf_url": F.lit(None).cast("string")})
    folder = E.shared_folder(spark)
    sinks.write_papers(papers, A.read(spark, sf, "events").select("event_id", "user_id", "event_type"), folder)
    return sinks.published(spark, folder, "papers", "papers").drop("url", "pdf_url")


@query("SELECT event_id, user_id, event_type FROM events")
def sink_atomic(spark, sf):
    """Events published once, then again with papers whose task fails: the first publication is what is read."""
    folder, events = E.shared_folder(spark), A.read(spark, sf, "events").select("event_id", "user_id", "event_type")
    sinks.publish({"events": events}, folder, "papers")
    broken = A.papers(spark, sf).select(F.when(F.col("paper_id") >= 0, F.raise_error(F.lit("a failing task"))).otherwise(F.col("paper_id")).alias("paper_id"))
    if sinks.saved("papers", sinks.publish, {"events": events.limit(0), "papers": broken}, folder, "papers") is not None:
        raise RuntimeError("a failed write was published")
    return sinks.published(spark, folder, "papers", "events")


@query(f"WITH {PAPERS} SELECT query_group, 'DOC_' || row_number() OVER (PARTITION BY query_group ORDER BY ord) AS doc, paper_id FROM papers")
def join_doc_ids(spark, sf):
    place = F.row_number().over(W.partitionBy("query_group").orderBy("ord"))
    return A.papers(spark, sf).select("query_group", F.concat(F.lit("DOC_"), place.cast("string")).alias("doc"), "paper_id")


@query(f"WITH {PAPERS}, {_SCREEN} SELECT paper_id, query_group FROM papers p SEMI JOIN (SELECT paper_id FROM screened WHERE priority = 'keep') s ON p.paper_id = s.paper_id")
def semi_stage_paper(spark, sf):
    kept = A.screened(spark, sf).filter("priority = 'keep'")
    return A.papers(spark, sf).join(kept, "paper_id", "left_semi").select("paper_id", "query_group")


@query(f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 2 = 0 THEN 'doi:10.1/' || paper_id ELSE 'title:' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g') || ':' || year END AS key FROM papers")
def dedup_key(spark, sf):
    doi = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("10.1/"), F.col("paper_id").cast("string")))
    return A.papers(spark, sf).select("paper_id", text.dedup_key(doi, F.col("title"), F.col("year")).alias("key"))


# -- budgets, caches and resumed work -----------------------------------------------------


@query(f"WITH {PAPERS} SELECT paper_id, 'DOC_' || paper_id AS doc FROM papers")
def norm_doc_id(spark, sf):
    raw = F.concat(F.lit(" [doc_"), F.col("paper_id").cast("string"), F.lit("] "))
    return A.papers(spark, sf).select("paper_id", text.norm_doc_id(raw).alias("doc"))


@query(f"WITH {PAPERS}, firsts AS (SELECT query_group, citation_count, min(ord) AS ord FROM papers WHERE citation_count IS NOT NULL GROUP BY ALL) SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY query_group ORDER BY ord, citation_count) <= 40")
def lookup_cache(spark, sf):
    return S.lookup_cache(A.papers(spark, sf).select("query_group", "citation_count", "ord"), "query_group", "citation_count", "ord")


_ATTEMPTS = "attempts AS (SELECT event_type, event_id, event_id % 5 + 1 AS attempt, value AS delay FROM events)"


def _attempts(spark, sf) -> DataFrame:
    return A.read(spark, sf, "events").select("event_type", "event_id", (F.col("event_id") % 5 + 1).alias("attempt"), F.col("value").alias("delay"))


@query(
    f"""WITH {_ATTEMPTS}, spent AS (SELECT *, sum(CASE WHEN attempt IN (2, 3) AND delay <= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM attempts)
    SELECT event_type, event_id, CASE WHEN attempt = 1 THEN 'first' WHEN attempt > 3 THEN 'exhausted' WHEN delay > 30 THEN 'deferred' WHEN s <= 160 THEN 'retry' ELSE 'over_budget' END AS status FROM spent"""
)
def retry_budget(spark, sf):
    return S.retry_budget(_attempts(spark, sf), "event_type", "event_id").select("event_type", "event_id", "status")


@query(f"WITH {_ATTEMPTS} SELECT event_type, count_if(attempt = 1) AS firsts, count_if(attempt = 2) AS retries, count_if(attempt = 3) AS recoveries, count_if(attempt > 3) AS failures, count(*) AS transports FROM attempts GROUP BY event_type")
def transport_counters(spark, sf):
    n = F.col("attempt")
    return _attempts(spark, sf).groupBy("event_type").agg(F.count_if(n == 1).alias("firsts"), F.count_if(n == 2).alias("retries"), F.count_if(n == 3).alias("recoveries"), F.count_if(n > 3).alias("failures"), F.count("*").alias("transports"))


@query(
    """SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER w, 100.0 - row_number() OVER w) AS "left"
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)"""
)
def provider_headers(spark, sf):
    calls = A.read(spark, sf, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("said"))
    estimate = 100.0 - F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return S.provider_headers(calls, "user_id", "event_id", "said", estimate).select("user_id", "event_id", "left")


@query(f"WITH {PAPERS} SELECT p.paper_id, CASE WHEN l.doc_id IS NOT NULL AND p.year % 2 = l.quality THEN 'completed' ELSE 'pending' END AS state FROM papers p LEFT JOIN labels l ON p.paper_id = l.doc_id")
def notes_checkpoint(spark, sf):
    work = A.papers(spark, sf).select("paper_id", (F.col("year") % 2).alias("manifest"))
    done = A.read(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").alias("manifest"))
    return S.checkpointed(work, done, "paper_id", "manifest").select("paper_id", "state")


@query(f"WITH {PAPERS} SELECT paper_id, query_group FROM papers ANTI JOIN (SELECT DISTINCT citation_count % 4 AS query_group FROM papers WHERE citation_count < 2) d USING (query_group)")
def pair_checkpoint(spark, sf):
    papers = A.papers(spark, sf)
    completed = papers.filter("citation_count < 2").select((F.col("citation_count") % 4).cast("long").alias("query_group")).distinct()
    return D.missing(papers.select("paper_id", "query_group"), completed, ["query_group"])


@query(f"WITH {PAPERS} SELECT p.paper_id, coalesce(l.quality, -1) AS verdict FROM papers p LEFT JOIN labels l ON p.paper_id = l.doc_id")
def merge_resume(spark, sf):
    prior = A.papers(spark, sf).select("paper_id", F.lit(-1).alias("verdict"))
    fresh = A.read(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.col("quality").cast("int").alias("verdict"))
    return S.merge_resume(prior, fresh, ["paper_id"])


@query(f"WITH {CHUNKS} SELECT paper_id, string_agg(chunk_id, ',' ORDER BY ord) AS ids FROM chunks GROUP BY paper_id")
def ids_of(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("ord", "chunk_id")))
    return A.chunks(spark, sf).groupBy("paper_id").agg(F.array_join(F.transform(ordered, lambda x: x["chunk_id"]), ",").alias("ids"))


# -- the event log as a stream ------------------------------------------------------------


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_stage_counts(spark, sf):
    return E.running_counts(E.read_stream(spark, f"{sf}/events.parquet"), ["user_id", "event_type"], E.shared_folder(spark))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_dispositions(spark, sf):
    return E.latest_state(E.read_stream(spark, f"{sf}/events.parquet"), "user_id", "event_id", ["event_type"], E.shared_folder(spark))
