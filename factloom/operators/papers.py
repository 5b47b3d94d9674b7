"""Filtering, title de-duplication, ranking and selection of papers.

Relations: papers(paper_id, title, abstract, year, citation_count, venue, ord).  ``ord`` is
the input order; every order here ends in it, so results don't hang on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from .decisions import globally_ranked

#: Venues and the ways in which their names are written.
VENUES = {
    "NeurIPS": ["neurips", "nips", "annual conference on neural information processing systems"],
    "ICML": ["icml", "international conference on machine learning"],
    "ICLR": ["iclr", "international conference on learning representations"],
    "ACL": ["acl", "association for computational linguistics", "annual meeting of the association for computational linguistics"],
    "EMNLP": ["emnlp", "conference on empirical methods in natural language processing"],
    "NAACL": ["naacl", "north american chapter of the association for computational linguistics"],
    "SIGIR": ["sigir", "international acm sigir conference on research and development in information retrieval"],
    "CIKM": ["cikm", "acm international conference on information and knowledge management"],
    "WSDM": ["wsdm", "acm international conference on web search and data mining"],
    "WWW": ["www", "the web conference", "international world wide web conference"],
    "KDD": ["kdd", "acm sigkdd conference on knowledge discovery and data mining", "knowledge discovery and data mining"],
    "RecSys": ["recsys", "acm conference on recommender systems", "acm recommender systems"],
    "CVPR": ["cvpr", "ieee cvf conference on computer vision and pattern recognition", "computer vision and pattern recognition"],
    "ICCV": ["iccv", "ieee international conference on computer vision"],
    "ECCV": ["eccv", "european conference on computer vision"],
    "AAAI": ["aaai", "aaai conference on artificial intelligence"],
    "IJCAI": ["ijcai", "international joint conference on artificial intelligence"],
}


@dataclass(frozen=True)
class FilterPolicy:
    min_year: int | None = None
    max_year: int | None = None
    min_citations: int | None = None
    venues: tuple[str, ...] = ()


def _clean(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def venue_defaults() -> list[str]:
    """Every conference's tokens, its own name's among them, sorted."""
    return sorted({_clean(n) for name, aliases in VENUES.items() for n in (name, *aliases)} - {""})


def venue_index() -> dict[str, str]:
    """Each token's conference; a token of two conferences is an error."""
    out: dict[str, str] = {}
    for name, aliases in VENUES.items():
        for token in {_clean(n) for n in (name, *aliases)} - {""}:
            if out.setdefault(token, name) != name:
                raise ValueError(f"{token} names both {out[token]} and {name}")
    return out


def venue_names(tokens: list[str]) -> list[str]:
    """The names, as providers read them, of the conferences that ``tokens`` name, in the order of VENUES."""
    wanted = {venue_index()[t] for t in tokens if t in venue_index()}
    return [n for name, aliases in VENUES.items() if name in wanted for n in (name, *aliases)]


def venue_tokens(raw: str | list[str] | None) -> list[str]:
    """Tokens of a list, or of names with commas between: all for None, none for "" and "none", every alias of known names, then unknown names.

    If no name is known there are none, so nothing is filtered.
    """
    if raw is None:
        return venue_defaults()
    raw = raw if isinstance(raw, str) else ",".join(raw)
    if raw.strip().lower() in ("", "none"):
        return []
    wanted, index = [t for t in map(_clean, raw.split(",")) if t], venue_index()
    known = [_clean(n) for t in wanted if t in index for n in (index[t], *VENUES[index[t]])]
    return list(dict.fromkeys([*sorted(known), *(t for t in wanted if t not in index)])) if known else []


def candidate_line(number: Column, title: Column, year: Column, citations: Column, abstract: Column) -> Column:
    """One candidate as a prompt lists it."""
    flat = lambda c: F.btrim(F.regexp_replace(c, text.SPACES, " "))
    head = F.concat(F.lit("- [DOC_"), number.cast("string"), F.lit('] "'), flat(title), F.lit('" ('), F.coalesce(year.cast("string"), F.lit("n/a")))
    return F.concat(head, F.lit(", citations: "), F.coalesce(citations.cast("string"), F.lit("N/A")), F.lit(")\n  Abstract: "), flat(abstract))


def filter_reason(policy: FilterPolicy, venues: Column | None = None) -> Column:
    """Why a paper goes: the first test that it fails; null if it stays.  Any of ``venues`` (structs with name) may be allowed, or ``venue`` where a paper has none of these."""
    from . import venues as V

    tests: list[tuple[Column, str]] = []
    if policy.min_year is not None:
        tests.append((F.col("year") < policy.min_year, "year_before_min"))
    if policy.max_year is not None:
        tests.append((F.col("year") > policy.max_year, "year_after_max"))
    if policy.min_citations is not None:
        tests.append((F.coalesce("citation_count", F.lit(0)) < policy.min_citations, "citation_below_min"))
    if policy.venues:
        tests.append((~V.allowed(V.of_paper(F.coalesce("venue", F.lit("")), venues), policy.venues), "venue_not_allowed"))
    out = F.lit(None).cast("string")
    for test, reason in reversed(tests):
        out = F.when(test, reason).otherwise(out)
    return out


def dedup_title(papers: DataFrame) -> DataFrame:
    """Marks each paper's ``is_winner`` among those of its normalised title, and ``pos``, where the title first stands.

    Preferred are more citations, a venue, a longer abstract (by ``abstract_length`` if that is
    there), a later year, the earlier place.
    """
    same = W.partitionBy("title_key")
    length = F.col("abstract_length") if "abstract_length" in papers.columns else F.length("abstract")
    best = same.orderBy(F.desc(F.coalesce("citation_count", F.lit(0))), F.desc(F.col("venue").isNotNull().cast("int")), F.desc(length), F.desc("year"), "ord")
    marked = papers.withColumn("title_key", text.norm_title(F.col("title")))
    return marked.withColumn("pos", F.min("ord").over(same)).withColumn("is_winner", F.row_number().over(best) == 1)


def filter_chain(papers: DataFrame, policy: FilterPolicy) -> DataFrame:
    return dedup_title(papers.filter(filter_reason(policy).isNull())).filter("is_winner").drop("is_winner", "title_key")


def filter_audit(papers: DataFrame, policy: FilterPolicy) -> DataFrame:
    """All papers with ``reason``: the first test that one fails, ``duplicate_title`` where another paper of its title wins, null if it stays."""
    marked = papers.withColumn("reason", filter_reason(policy))
    rest = dedup_title(marked.filter("reason is null"))
    rest = rest.withColumn("reason", F.when(~F.col("is_winner"), "duplicate_title"))
    return marked.filter("reason is not null").unionByName(rest.select(*marked.columns))


def rank_lexical(papers: DataFrame, terms: list[str], by: list[str] | None = None) -> DataFrame:
    """score and rank; the order is by the unrounded score, citations, year, input order."""
    score = scores.lexical_score(terms, F.col("title"), F.col("abstract")) + scores.citation_score(F.col("citation_count")) + scores.recency_score(F.col("year"))
    return _ranked(papers.withColumn("score", score), by)


def rank_semantic(papers: DataFrame, idea: Column, sub: Column, weight: float, by: list[str] | None = None) -> DataFrame:
    """As rank_lexical, with ``weight`` x the idea's and (1 - ``weight``) x the sub-query's cosine, negative ones as 0."""
    positive = lambda c: F.greatest(c, F.lit(0.0))
    score = weight * positive(idea) + (1 - weight) * positive(sub) + scores.citation_score(F.col("citation_count")) + scores.recency_score(F.col("year"))
    return _ranked(papers.withColumn("score", score), by)


def _ranked(papers: DataFrame, by: list[str] | None) -> DataFrame:
    """``rank`` by falling score, citations, year, then input order; a group of any size is dealt out over tasks."""
    order = [-F.coalesce("score", F.lit(float("-inf"))), -F.coalesce("citation_count", F.lit(0)), -F.coalesce("year", F.lit(0)), F.col("ord")]
    return globally_ranked(papers, order, by=by)


def select_top(ranked: DataFrame, min_score: float, most: int) -> DataFrame:
    """The first ``most`` of those with at least ``min_score``, in order of rank."""
    return ranked.filter(F.col("score") >= min_score).orderBy("rank").limit(most)


def assess(ranked: DataFrame) -> DataFrame:
    """relevance, quality and include (relevance >= 8 and quality >= 6) from metadata."""
    out = ranked.withColumn("relevance", scores.relevance_1_10(F.col("score"))).withColumn("quality", scores.metadata_quality(F.col("venue"), F.col("citation_count")))
    return out.withColumn("include", (F.col("relevance") >= 8) & (F.col("quality") >= 6))


def bucket_flags(ranked: DataFrame, by: list[str]) -> DataFrame:
    """n, rank_pct, cite_pct, and whether a paper is of kind a (top and cited), b (top half and recent), c (middle and cited).

    A paper without a citation count stands last by citations and is never of kind a or c.
    """
    whole = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.max("year").alias("newest"))
    cited = [-F.coalesce("citation_count", F.lit(0)), F.col("rank")]
    placed = globally_ranked(ranked, cited, "__cited", by).join(whole, by)
    share = lambda place: F.when(F.col("n") <= 1, F.lit(0.0)).otherwise((place - 1) / (F.col("n") - 1))
    out = placed.withColumn("rank_pct", share(F.col("rank"))).withColumn("cite_pct", share(F.col("__cited"))).drop("__cited")
    often = F.col("citation_count").isNotNull() & (F.col("cite_pct") <= 0.30)
    out = out.withColumn("is_a", (F.col("rank_pct") <= 0.20) & often).withColumn("is_b", (F.col("rank_pct") <= 0.50) & (F.col("year") >= F.col("newest") - 1))
    return out.withColumn("is_c", F.col("rank_pct").between(0.40, 0.70) & often).drop("newest")


def bucket_sample(ranked: DataFrame, by: list[str], keep_all: int = 24, budgets: tuple[int, int, int] = (6, 12, 6)) -> DataFrame:
    """Buckets a, b, c of :func:`bucket_flags` by rank; all, without buckets, up to ``keep_all``.

    Each bucket is cut to its budget before papers that stand in an earlier one are dropped.
    """
    base = bucket_flags(ranked, by)
    bucket = F.lit(None).cast("string")
    for name, budget in reversed(list(zip("abc", budgets, strict=True))):
        place = F.sum(F.col(f"is_{name}").cast("int")).over(W.partitionBy(*by).orderBy("rank"))
        base = base.withColumn(f"in_{name}", F.col(f"is_{name}") & (place <= budget))
        bucket = F.when(F.col(f"in_{name}"), name).otherwise(bucket)
    out = base.withColumn("bucket", F.when(F.col("n") <= keep_all, F.lit("all")).otherwise(bucket)).filter("bucket is not null")
    return out.select(*ranked.columns, "bucket")


def mark_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``seen``: whether an earlier row has the same ``key``."""
    return rows.withColumn("seen", F.row_number().over(W.partitionBy(key).orderBy(order)) > 1)
