"""Screening answers, rounds and searches: resolving ids, gaps, unions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from . import decisions as D
from . import papers as P

OVERLAP = 0.5
FOLLOW_UPS = 3


def numbered(candidates: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Candidates with doc, ``DOC_n`` consecutive over queries in order: each query's count is summed up, then its own numbers added."""
    out = D.number_claims(candidates, by, order).withColumnRenamed("claim_no", "number")
    return out.withColumn("doc", F.concat(F.lit("DOC_"), F.col("number").cast("string")))


def resolved(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc, paper_id, priority, state of numbered candidates and decisions (doc_id, priority), one row for each document named.

    ``ok``; ``missing`` and ``duplicate`` are fatal, ``unknown`` decisions are dropped with a warning.
    """
    said = decisions.withColumn("doc", text.norm_doc_id(F.col("doc_id"))).groupBy("doc").agg(F.count("*").alias("__said"), F.min("priority").alias("priority"))
    both = candidates.select("doc", "paper_id").join(said, "doc", "full")
    state = F.when(F.col("paper_id").isNull(), "unknown").when(F.col("__said").isNull(), "missing").when(F.col("__said") > 1, "duplicate").otherwise("ok")
    return both.select("doc", "paper_id", F.when(state == "ok", F.col("priority")).alias("priority"), state.alias("state"))


def empty_gaps(queries: DataFrame, candidates: DataFrame, by: str) -> DataFrame:
    """``by`` and gap of queries that have no candidate; these need no screening."""
    return queries.join(candidates, by, "left_anti").select(by, F.concat(F.lit("No candidates retrieved for: "), F.col(by).cast("string")).alias("gap"))


def follow_ups(gaps: DataFrame, by: str, order: list[str], most: int = FOLLOW_UPS) -> DataFrame:
    """The first ``most`` follow-up queries of each screening, one of each text, with round."""
    once = D.first_by(gaps, [by, "query"], order)
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return once.withColumn("place", place).filter(F.col("place") <= most).withColumn("round", F.lit("follow_up"))


def union_rounds(initial: DataFrame, follow_up: DataFrame) -> DataFrame:
    """Candidates of both rounds; of a paper found twice the first of the initial round, else of the other."""
    both = initial.withColumn("round", F.lit("initial")).unionByName(follow_up.withColumn("round", F.lit("follow_up")))
    return D.first_by(both, ["paper_id"], [F.desc(F.col("round") == "initial"), "query_ord", "rank"])


def overlap_accept(first: Column, repaired: Column, most: float = OVERLAP) -> Column:
    """Which of two plans serves: the first if its queries overlap little, else the second if it overlaps little or less."""
    return F.when(first <= most, "first").when((repaired <= most) | (repaired < first), "repaired").otherwise("first")


def search_counts(papers: DataFrame, by: str, policy: P.FilterPolicy) -> DataFrame:
    """received, after_year, after_venue, after_dedup for each query, in one pass over marked rows.

    Titles are taken once for each query, of the papers that pass the filters before.
    """
    year = P.filter_reason(P.FilterPolicy(policy.min_year, policy.max_year)).isNull()
    venue = P.filter_reason(P.FilterPolicy(venues=policy.venues)).isNull()
    marked = papers.select(by, year.alias("__y"), (year & venue).alias("__v"), F.when(year & venue, text.norm_title(F.col("title"))).alias("__t"))
    per_title = marked.groupBy(by, "__t").agg(F.count("*").alias("n"), F.count_if("__y").alias("y"), F.count_if("__v").alias("v"))
    kept = F.count_if(F.col("v") > 0)
    return per_title.groupBy(by).agg(F.sum("n").alias("received"), F.sum("y").alias("after_year"), F.sum("v").alias("after_venue"), kept.alias("after_dedup"))


def search_and_rank(papers: DataFrame, by: str, policy: P.FilterPolicy, score: Column) -> DataFrame:
    """The papers of each query that pass, one of each title there, with score and rank."""
    kept = papers.filter(P.filter_reason(policy).isNull()).withColumn("title_key", text.norm_title(F.col("title")))
    best = W.partitionBy(by, "title_key").orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), F.desc(F.col("venue").isNotNull().cast("int")), F.desc(F.length("abstract")), F.desc("year"), "ord")
    once = kept.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n", "title_key")
    return P._ranked(once.withColumn("score", score), [by])
