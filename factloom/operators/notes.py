"""From chunks and assessments to notes, claims, directions and report text.

Long tables throughout: a claim is a row (paper_id, claim_ord, ...), its evidence one row for
each chunk, so nothing grows with the corpus inside a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sections, text
from . import decisions as D

#: From how many papers of which utility on evidence converges.
CONVERGING_PAPERS, CONVERGING_UTILITY = 2, 6.0
MARKER = r"\[([^\[\]]+)\]"
HEADING = r"(?m)^\s{0,3}#{1,6}(?:\s|$)|^\s*(?:=+|-+)\s*$"


def deterministic_notes(chunks: DataFrame, pack: DataFrame) -> DataFrame:
    """paper_id, claim_ord, chunk_id, aspect, quote: a claim for each chunk of the pack, then for each other chunk with a limitation cue.

    ``pack`` has paper_id, chunk_id and idx, the place in the paper, as has ``chunks``; both have text.
    """
    first = pack.select("paper_id", "chunk_id", "idx", "text", sections.text_class(F.col("text"))["name"].alias("aspect"), F.lit(0).alias("part"))
    cued = chunks.filter(text.limitation_cue(F.col("text"))).join(pack.select("paper_id", "chunk_id"), ["paper_id", "chunk_id"], "left_anti")
    every = first.unionByName(cued.select("paper_id", "chunk_id", "idx", "text", F.lit("limitations").alias("aspect"), F.lit(1).alias("part")))
    place = F.row_number().over(W.partitionBy("paper_id").orderBy("part", "idx"))
    return every.select("paper_id", place.alias("claim_ord"), "chunk_id", "aspect", text.quote(F.col("text")).alias("quote"))


def note_claims(answers: DataFrame, supplied: DataFrame) -> DataFrame:
    """paper_id, claim_ord, text, aspect, place, chunk_id, quote of a model's claims: aliases resolved, each chunk of a claim once, in order.

    ``answers`` has paper_id and claims, an array of struct(text, aspect, chunk_ids); ``supplied``
    has paper_id, alias, chunk_id and text.  Without an aspect a claim is on limitations.  An
    alias that names no supplied chunk has chunk_id null; see :func:`unknown_aliases`.
    """
    claims = answers.select("paper_id", F.posexplode("claims").alias("at", "c"))
    cited = claims.select("paper_id", (F.col("at") + 1).alias("claim_ord"), F.col("c.text").alias("text"), F.coalesce(F.nullif(F.col("c.aspect"), F.lit("")), F.lit("limitations")).alias("aspect"), F.posexplode(F.array_distinct("c.chunk_ids")).alias("place", "alias"))
    known = supplied.select("paper_id", "alias", "chunk_id", text.quote(F.col("text")).alias("quote"))
    return cited.join(known, ["paper_id", "alias"], "left").select("paper_id", "claim_ord", "text", "aspect", (F.col("place") + 1).alias("place"), "alias", "chunk_id", "quote")


def unknown_aliases(cited: DataFrame) -> DataFrame:
    """paper_id and alias of citations that name no supplied chunk; not empty is an error."""
    return cited.filter("chunk_id is null").select("paper_id", "alias").distinct()


def tagged(claims: DataFrame, usable: DataFrame) -> DataFrame:
    """Claims of usable papers with claim_id, ``claim-N`` consecutive over papers in order."""
    kept = claims.join(usable.select("paper_id"), "paper_id", "left_semi")
    out = D.number_claims(kept, "paper_id", ["claim_ord"])
    return out.withColumn("claim_id", F.concat(F.lit("claim-"), F.col("claim_no").cast("string")))


def claim_chunks(evidence: DataFrame) -> DataFrame:
    """claim_id and its distinct chunk ids, sorted, of rows (claim_id, chunk_id)."""
    return evidence.groupBy("claim_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))


def markers(report: Column) -> Column:
    """What stands in square brackets, in order."""
    return F.regexp_extract_all(report, F.lit(MARKER), F.lit(1))


def check_sections(sections_: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key, state, unknown of report sections (key, report): ok, heading, no_markers, or unknown_markers with their list.

    ``allowed`` has key and claim_id, the claims that a section may cite.
    """
    cited = sections_.select(key, F.explode(F.array_distinct(markers(F.col("report")))).alias("claim_id"))
    strange = cited.join(allowed, [key, "claim_id"], "left_anti").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("claim_id")), ",").alias("unknown"))
    out = sections_.join(strange, key, "left")
    state = F.when(F.size(markers(F.col("report"))) == 0, "no_markers").when(F.col("unknown").isNotNull(), "unknown_markers").when(F.col("report").rlike(HEADING), "heading").otherwise("ok")
    return out.select(key, state.alias("state"), F.coalesce("unknown", F.lit("")).alias("unknown"))


def outline_check(outline: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """key and claim_id that an outline's sections (key, claim_ids) cite without being allowed."""
    cited = outline.select(key, F.explode("claim_ids").alias("claim_id")).distinct()
    return D.unknown(allowed.select("claim_id"), cited, ["claim_id"]).select(key, "claim_id")


def scoped_notes(claims: DataFrame, outline: DataFrame, key: str) -> DataFrame:
    """key with the tagged claims that the section may use."""
    cited = outline.select(key, F.explode("claim_ids").alias("claim_id")).distinct()
    return claims.join(cited, "claim_id")


def direction_papers(directions: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """key and the distinct papers, sorted, of the claims that a direction (key, claim_ids) rests on."""
    cited = directions.select(key, F.explode("claim_ids").alias("claim_id")).distinct()
    found = cited.join(claims.select("claim_id", "paper_id").distinct(), "claim_id")
    return found.groupBy(key).agg(F.array_sort(F.collect_set(F.col("paper_id").cast("string"))).alias("papers"))


def directions(assessed: DataFrame, evidence: DataFrame, claims: DataFrame) -> DataFrame:
    """direction, paper_id, chunk_id: what each direction rests on.

    ``convergence`` if two or more usable papers reach the utility, over all their evidence;
    ``limitations`` for each usable paper with claims on them; without either ``fallback``, the best
    usable paper.  ``assessed`` has paper_id, utility and include, ``evidence`` paper_id and chunk_id.
    """
    usable = assessed.filter("include")
    strong = usable.filter(F.col("utility") >= CONVERGING_UTILITY).select("paper_id")
    enough = strong.limit(CONVERGING_PAPERS).agg(F.count("*").alias("__n")).filter(F.col("__n") >= CONVERGING_PAPERS)  # one row or none
    converging = evidence.join(strong, "paper_id", "left_semi").crossJoin(F.broadcast(enough)).select(F.lit("convergence").alias("direction"), "paper_id", "chunk_id")
    limits = claims.filter("aspect = 'limitations'").join(usable.select("paper_id"), "paper_id", "left_semi").select(F.lit("limitations").alias("direction"), "paper_id", "chunk_id")
    found = converging.unionByName(limits).distinct()
    best = usable.orderBy(F.desc("utility"), "paper_id").limit(1).select("paper_id")
    none = found.limit(1).agg(F.count("*").alias("__n")).filter("__n = 0")
    alone = evidence.join(F.broadcast(best), "paper_id", "left_semi").crossJoin(F.broadcast(none)).select(F.lit("fallback").alias("direction"), "paper_id", "chunk_id").distinct()
    return found.unionByName(alone)


def _listed(column: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: x[column]), ", ")


def materials(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """paper_id and its line of the list of materials: source, claims, chunks.  ``claims`` are tagged, with chunk_id; ``sources`` has paper_id and source_path."""
    per = claims.groupBy("paper_id").agg(_listed("claim_id", "claim_no").alias("ids"), F.array_join(F.array_sort(F.collect_set("chunk_id")), ", ").alias("chunks"))
    out = per.join(sources, "paper_id", "left")
    line = F.concat(F.lit("- "), F.col("paper_id").cast("string"), F.lit(": source="), F.coalesce("source_path", F.lit("unavailable")), F.lit("; claims="), F.col("ids"), F.lit("; chunks="), F.col("chunks"))
    return out.select("paper_id", line.alias("line"))


def report_blocks(claims: DataFrame, assessed: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """paper_id, notes, assessment, source: each usable paper's three pieces of the deterministic report."""
    line = F.concat(F.lit("- "), F.col("aspect"), F.lit(": "), F.col("quote"), F.lit(" ["), F.col("chunk_id"), F.lit("]"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("claim_ord", line.alias("l")))), lambda x: x["l"]), "\n")
    notes = claims.groupBy("paper_id").agg(F.concat(F.lit("## Reading notes for "), F.first("paper_id").cast("string"), F.lit("\n"), body).alias("notes"), F.array_join(F.array_sort(F.collect_set("chunk_id")), ", ").alias("cover"))
    cited = evidence.groupBy("paper_id").agg(F.array_sort(F.collect_set("chunk_id")).alias("cited"))
    rows = assessed.filter("include").join(notes, "paper_id").join(cited, "paper_id", "left").join(sources, "paper_id", "left")
    cites = F.coalesce("cited", F.array().cast("array<string>"))
    marks = F.array_join(F.transform(cites, lambda c: F.concat(F.lit("["), c, F.lit("]"))), " ")
    name = F.col("paper_id").cast("string")
    return rows.select(
        "paper_id",
        "notes",
        F.concat(F.lit("- "), name, F.lit(": "), F.col("rationale"), F.lit(" "), marks).alias("assessment"),
        F.concat(F.lit("- "), name, F.lit(": source="), F.coalesce("source_path", F.lit("unavailable")), F.lit("; evidence chunks="), F.coalesce(F.nullif(F.array_join(cites, ", "), F.lit("")), F.lit("none")), F.lit("; notes cover="), F.col("cover")).alias("source"),
    )


def paper_lines(counts: DataFrame, titles: DataFrame) -> DataFrame:
    """paper_id and one line of its chunks by category, of rows (paper_id, category, n)."""
    items = F.array_join(F.array_sort(F.collect_list(F.concat("category", F.lit(":"), F.col("n").cast("string")))), " ")
    out = counts.groupBy("paper_id").agg(items.alias("items")).join(titles, "paper_id", "left")
    name = F.col("paper_id").cast("string")
    label = F.when(F.coalesce("title", F.lit("")) != "", F.concat(name, F.lit(" ("), F.col("title"), F.lit(")"))).otherwise(name)
    return out.select("paper_id", F.concat(label, F.lit(": "), F.col("items")).alias("line"))


def category_lines(counts: DataFrame) -> DataFrame:
    """category and its line of the table over all papers."""
    per = counts.groupBy("category").agg(F.sum("n").alias("n"), F.count_distinct("paper_id").alias("papers"))
    return per.select("category", F.format_string("  %-18s %4d  (papers: %d)", "category", "n", "papers").alias("line"))
