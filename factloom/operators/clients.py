"""Encoders and JSON clients from outside: where they are called, checked, repaired and retried.

An encoder is a function from a list of texts to a list of vectors, a client one from
(prompt, schema) to JSON text; both are picklable, run on the executors and are called with
batches.  Prompts are built as columns, so what is sent can be looked at before anything is.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..shipping import ship
from . import chunks as C

Encoder = Callable[[list[str]], list[list[float]]]
Client = Callable[[str, dict | None], str]

#: How a query is put to an encoder, batch sizes, retries.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "
SCORE_BATCH, JUDGE_BATCH, RETRIES, BACKOFF = 4, 8, 2, 5.0


class MalformedAnswer(ValueError):
    """An answer that isn't JSON of the shape asked for."""


class IncompleteAnswer(ValueError):
    """An answer that doesn't name each index that was sent exactly once."""


class Transient(RuntimeError):
    """A limit or server error that another try may get past."""


# ---- encoders ----


def encoded(texts: Column, encoder: Encoder) -> Column:
    """The encoder's vectors; an encoder that gives another number of vectors than texts is an error."""

    def run(part: pd.Series) -> pd.Series:
        found = encoder(part.fillna("").tolist()) if len(part) else []
        if len(found) != len(part):
            raise ValueError(f"{len(found)} vectors for {len(part)} texts")
        return pd.Series([list(map(float, v)) for v in found], index=part.index, dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(texts)


def encode_chunks(chunks: DataFrame, encoder: Encoder, text_for: Column | None = None) -> DataFrame:
    """``chunks`` with v; each distinct text is encoded once and joined back."""
    ship(chunks.sparkSession)
    keyed = chunks.withColumn("__text", F.col("text") if text_for is None else text_for)
    once = keyed.select("__text").distinct().withColumn("v", encoded(F.col("__text"), encoder))
    return keyed.join(once.withColumnRenamed("__text", "__t"), F.col("__text").eqNullSafe(F.col("__t")), "left").drop("__text", "__t")


def encode_query(query: str, encoder: Encoder) -> list[float]:
    return list(map(float, encoder([QUERY_PREFIX + query])[0]))


def semantic_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """``vectors`` (with v) with score, the product with the query's vector, which was encoded once; text isn't needed any more."""
    return vectors.withColumn("score", scores.dot(F.col("v"), F.array(*[F.lit(x) for x in query])))


def retrieve_local(docs: DataFrame, query: str, encoder: Encoder, k: int = 10, cap: int | None = None) -> DataFrame:
    """The k chunks of documents (paper_id, text) nearest to a query; no client is called."""
    found = semantic_scores(encode_chunks(C.chunk_words(docs), encoder), encode_query(query, encoder))
    return C.top_capped(found, k, cap, "paper_id", ["paper_id", "chunk_id"]).drop("v")


# ---- clients ----


def retried(call: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> str:
    """``call``, again after backoff x 2^n seconds while it raises Transient, ``retries`` times."""
    for attempt in range(retries + 1):
        try:
            return call()
        except Transient:
            if attempt == retries:
                raise
            sleep(backoff * 2**attempt)
    raise AssertionError("unreachable")


def unfenced(raw: str) -> str:
    """As text.strip_fence."""
    lines = raw.strip().split("\n")
    if len(lines) > 1 and lines[0].startswith("```") and lines[-1].strip() == "```":
        lines = lines[1:-1]
    body = "\n".join(lines).strip()
    return body[: body.rfind("}") + 1] if "}" in body else body


def repaired(client: Client, prompt: str, schema: dict | None, parse: Callable[[str], object], hint: str = "") -> object:
    """The parsed answer, or that of one repair request which carries the answer that couldn't be used; a second failure is raised."""
    raw = retried(lambda: client(prompt, schema))
    try:
        return parse(raw)
    except ValueError as error:
        again = f"{prompt}\nThe answer below could not be used ({error}). Answer again with one JSON object of the schema and nothing else. {hint}\n{raw}"
        return parse(retried(lambda: client(again, schema)))


def indexed(raw: str, key: str, expected: list[str], fields: dict[str, tuple[int, int]]) -> dict[str, dict]:
    """Answers {key: [{"chunk_id": index, ...}]} by index, each index once and scores in their ranges."""
    try:
        rows = json.loads(unfenced(raw))[key]
        found = {str(r["chunk_id"]): {name: r[name] for name in (*fields, "rationale") if name in r} for r in rows}
        fine = all(isinstance(r.get(name), int) and lo <= r[name] <= hi for r in found.values() for name, (lo, hi) in fields.items())
    except (TypeError, KeyError, ValueError) as error:
        raise MalformedAnswer(type(error).__name__) from None
    if not fine:
        raise MalformedAnswer("a score is missing or out of range")
    if len(rows) != len(found) or set(found) != set(expected):
        raise IncompleteAnswer(f"expected indexes {expected}")
    return found


def batch_prompt(query: str, task: str, order: list[str]) -> Column:
    """The prompt of a batch, as an aggregate: task, query, and each chunk with its index, section and text."""
    line = F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), F.coalesce("section", F.lit("n/a")), F.lit(": "), F.col("text"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("l")))), lambda x: x["l"])
    return F.concat(F.lit(f"{task}\nResearch idea: {query}\nEvidence chunks:\n"), F.array_join(lines, "\n\n"))


def _judged(chunks: DataFrame, query: str, client: Client, task: str, fields: dict[str, tuple[int, int]], key: str, size: int) -> DataFrame:
    ship(chunks.sparkSession)
    batches = C.batch_fixed(chunks, ["paper_id"], ["chunk_id"], size).withColumn("idx", F.col("idx") + 1)
    prompts = batches.groupBy("paper_id", "batch").agg(batch_prompt(query, task, ["idx"]).alias("prompt"), F.array_sort(F.collect_list(F.struct("idx", "chunk_id"))).alias("sent"))
    schema = f"paper_id {chunks.schema['paper_id'].dataType.simpleString()}, chunk_id string, {', '.join(f'{n} int' for n in fields)}, rationale string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for paper, prompt, sent in zip(part["paper_id"], part["prompt"], part["sent"], strict=True):
                ids = {str(x["idx"]): x["chunk_id"] for x in sent}
                answer = repaired(client, prompt, {"key": key, "fields": fields}, lambda raw, ids=ids: indexed(raw, key, list(ids), fields), f"Indexes: {list(ids)}.")
                rows += [(paper, ids[i], *(found[n] for n in fields), found.get("rationale")) for i, found in answer.items()]
            yield pd.DataFrame(rows, columns=["paper_id", "chunk_id", *fields, "rationale"])

    return prompts.mapInPandas(run, schema)


def score_batches(chunks: DataFrame, query: str, client: Client, size: int = SCORE_BATCH) -> DataFrame:
    """paper_id, chunk_id, utility_score (0 to 10), rationale of chunks (paper_id, chunk_id, section, text): every chunk exactly once, or an error."""
    return _judged(chunks, query, client, "Rate how much each chunk contributes to the research idea.", {"utility_score": (0, 10)}, "assessments", size)


def rcs(chunks: DataFrame, query: str, client: Client, size: int = SCORE_BATCH) -> DataFrame:
    """paper_id, chunk_id, relevance_score, quality_score (1 to 10), rationale, in the order in which evidence is shown."""
    found = _judged(chunks, query, client, "Summarise each chunk and rate its relevance and quality.", {"relevance_score": (1, 10), "quality_score": (1, 10)}, "assessments", size)
    return found.orderBy(F.desc("relevance_score"), F.desc("quality_score"), "chunk_id")


def evidence_pipeline(docs: DataFrame, query: str, encoder: Encoder, client: Client, k: int = 10) -> DataFrame:
    """Chunks of documents, the k nearest to the query, judged by the client."""
    return rcs(retrieve_local(docs, query, encoder, k).withColumn("section", F.lit(None).cast("string")), query, client)


def judge_batched(pairs: DataFrame, client: Client, size: int = JUDGE_BATCH) -> DataFrame:
    """query_id, rank, said (A, B or tie) of pairs (query_id, rank, first, second), ``size`` in a call; an answer of another length is an error."""
    ship(pairs.sparkSession)
    numbered = C.batch_fixed(pairs, ["query_id"], ["rank"], size)
    line = F.concat(F.lit("A: "), F.col("first"), F.lit("\nB: "), F.col("second"))
    sent = numbered.groupBy("query_id", "batch").agg(F.array_sort(F.collect_list(F.struct("idx", "rank", line.alias("l")))).alias("sent"))
    schema = f"query_id {pairs.schema['query_id'].dataType.simpleString()}, rank {pairs.schema['rank'].dataType.simpleString()}, said string"

    def parse(raw: str, n: int) -> list[str]:
        try:
            found = [v["winner"] for v in json.loads(unfenced(raw))["verdicts"]]
        except (TypeError, KeyError, ValueError) as error:
            raise MalformedAnswer(type(error).__name__) from None
        if len(found) != n or not set(found) <= {"A", "B", "tie"}:
            raise IncompleteAnswer(f"{n} verdicts were asked for")
        return found

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for query, lines in zip(part["query_id"], part["sent"], strict=True):
                prompt = "Which text of each pair is better evidence?\n" + "\n\n".join(x["l"] for x in lines)
                said = repaired(client, prompt, {"verdicts": len(lines)}, lambda raw, n=len(lines): parse(raw, n))
                rows += [(query, x["rank"], s) for x, s in zip(lines, said, strict=True)]
            yield pd.DataFrame(rows, columns=["query_id", "rank", "said"])

    return sent.mapInPandas(run, schema)


def judge_single(pairs: DataFrame, client: Client) -> DataFrame:
    """The same, one pair in a call."""
    return judge_batched(pairs, client, 1)


def synthesised(sections: DataFrame, claims: DataFrame, client: Client) -> DataFrame:
    """section_index, title, report of an outline's sections (section_index, title, purpose, claim_ids): each from its own claims (claim_id, text), one call, one repair.

    A report without ``[claim-N]`` marks, with marks of other claims, or with headings isn't taken.
    """
    ship(sections.sparkSession)
    from . import notes as N

    scoped = sections.select("section_index", F.explode("claim_ids").alias("claim_id")).distinct().join(claims.select("claim_id", "text"), "claim_id")
    listed = scoped.groupBy("section_index").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text"))).alias("allowed"))
    rows = sections.select("section_index", "title", "purpose").join(listed, "section_index", "left")
    heading, marker = N.HEADING, N.MARKER

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        def parse(raw: str, allowed: set[str]) -> str:
            try:
                report = str(json.loads(unfenced(raw))["report"])
            except (TypeError, KeyError, ValueError) as error:
                raise MalformedAnswer(type(error).__name__) from None
            cited = set(re.findall(marker, report))
            if not cited or cited - allowed or re.search(heading, report):
                raise IncompleteAnswer("cite supplied claims only, at least one, without headings")
            return report

        for part in parts:
            out = []
            for index, title, purpose, allowed in zip(part["section_index"], part["title"], part["purpose"], part["allowed"], strict=True):
                known = {x["claim_id"]: x["text"] for x in (allowed if allowed is not None else [])}
                prompt = f"Write the section {title}: {purpose}\n" + "\n".join(f"[{c}] {t}" for c, t in known.items())
                out.append((index, title, repaired(client, prompt, {"report": "string"}, lambda raw, known=known: parse(raw, set(known)))))
            yield pd.DataFrame(out, columns=["section_index", "title", "report"])

    return rows.mapInPandas(run, f"section_index {sections.schema['section_index'].dataType.simpleString()}, title string, report string")
