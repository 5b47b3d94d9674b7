"""The training-data operators as queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, common, decontaminate, jaccard, langid, licences, mixing, quality, repeats, secretscan, sharding, topk, toxicity, whitening

Query = Callable[[SparkSession, str], DataFrame]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.id_remainder("doc_id", 4) == 2
    return langid.identify(common.table(spark, sf_dir, "documents"), ~held_out, held_out)


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(common.table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.id_remainder("doc_id", 5) == 0
    return toxicity.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ~held_out, held_out)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = common.id_remainder("doc_id", 5) == 0
    return quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"), ~held_out, held_out)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(common.table(spark, sf_dir, "documents"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(common.table(spark, sf_dir, "documents"))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(common.table(spark, sf_dir, "embeddings"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placed(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_mix_sources, op2_decontaminate, op3_language_id, op4_repeated_passages, op5_toxicity, op6_quality, op7_secret_scan, op8_ngram_jaccard, op9_exact_topk, op10_licence_scan, op11_filter_audit, op12_whitening, op13_sharding)}

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw
  FROM documents),
per AS (
  SELECT source, sum(size) AS source_size,
         CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight
  FROM sized GROUP BY source),
ordered AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place FROM per),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM ordered),
firsts AS (SELECT min(place) AS first FROM filled WHERE level * weight <= cap),
plans AS (
  SELECT source, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN first IS NOT NULL AND place >= first
              THEN least((SELECT level FROM filled WHERE place = (SELECT first FROM firsts)) * weight, CAST(cap AS DOUBLE))
              ELSE CAST(cap AS DOUBLE) END AS target
  FROM filled, firsts),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plans),
rates AS (SELECT *, target - whole * source_size AS part FROM parts),
running AS (
  SELECT s.*, r.source_size, r.target, r.whole, r.part,
         sum(size) OVER (PARTITION BY s.source ORDER BY draw, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
cuts AS (SELECT source, min(substr(draw, 1, 4)) AS cut FROM (SELECT source, draw, upto, part,
            max(upto) OVER (PARTITION BY source, substr(draw, 1, 4)) AS bucket_upto FROM running) WHERE bucket_upto > part GROUP BY source),
drawn AS (
  SELECT r.*, CASE WHEN c.cut IS NULL THEN part > 0 WHEN substr(draw, 1, 4) < c.cut THEN true
                   WHEN substr(draw, 1, 4) = c.cut THEN upto <= part ELSE false END AS extra
  FROM running r LEFT JOIN cuts c ON r.source IS NOT DISTINCT FROM c.source),
gaps AS (SELECT source, CAST(floor(any_value(part) + 0.5 - coalesce(sum(size) FILTER (extra), 0)) AS BIGINT) AS gap FROM drawn GROUP BY source),
ranked AS (
  SELECT d.source, d.doc_id, d.draw, d.size, d.extra, g.gap, CAST(floor(log2(d.size)) AS INTEGER) AS class,
         row_number() OVER (PARTITION BY d.source, d.extra, floor(log2(d.size)) ORDER BY d.draw, d.size) AS nth
  FROM drawn d JOIN gaps g ON d.source IS NOT DISTINCT FROM g.source WHERE d.size > 0 AND g.gap <> 0),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size >= 2 * gap, nth, extra, class) AS turn FROM ranked WHERE nth <= 14),
tried AS (
  SELECT source, any_value(gap) AS gap, [[0]] || list([CASE WHEN extra THEN -size ELSE size END] ORDER BY turn) AS adds
  FROM turns WHERE turn <= 14 GROUP BY source),
sums AS (
  SELECT source, list_transform(list_reduce(adds, lambda acc, x: list_concat(acc, list_transform(acc, lambda y: y + x[1]))), lambda z: abs(gap - z)) AS away FROM tried),
best AS (SELECT source, list_position(away, list_min(away)) - 1 AS best FROM sums),
swaps AS (
  SELECT t.source, t.draw, t.size, t.extra, count(*) AS copies FROM turns t JOIN best b ON t.source IS NOT DISTINCT FROM b.source
  WHERE t.turn <= 14 AND (b.best >> CAST(t.turn - 1 AS INTEGER)) & 1 = 1 GROUP BY ALL),
named AS (
  SELECT d.*, s.copies, row_number() OVER (PARTITION BY d.source, d.draw, d.size, d.extra) <= coalesce(s.copies, 0) AS swapped
  FROM drawn d LEFT JOIN swaps s ON d.source IS NOT DISTINCT FROM s.source AND d.draw = s.draw AND d.size = s.size AND d.extra = s.extra)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size > 0 THEN whole + CAST(extra <> swapped AS BIGINT) ELSE 0 END * size AS BIGINT) AS taken
FROM named
""",
    "op9_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""",
    "op11_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(words) < 200 AS INTEGER)
         + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
         + 4 * CAST(100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS INTEGER)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(first < texts.doc_id, false) AS INTEGER) AS fails
  FROM texts LEFT JOIN known ON texts.doc_id = known.doc_id),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
  FROM orders, range(1, 6) AS r(step)),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM failed GROUP BY ALL),
found AS (
  SELECT part, filter_order, step, own,
         CAST(coalesce(sum(n) FILTER (fails & (own | before) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (fails & own <> 0 AND fails & before <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (fails = own), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(n_good) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(n_toxic) FILTER (fails & own <> 0 AND fails & before = 0), 0) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found
""",
}
