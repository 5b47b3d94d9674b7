"""Scores to decisions: blends, shrunk means, quotas, screening, downloads, integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import round1
from ..storage import saved


def agg_functional(scores: DataFrame, max_weight: float = 0.7) -> DataFrame:
    """utility, the blend of largest and mean score to one place; score_tenths, (7 x max x n + 3 x sum) / n; n; chunk ids in order."""
    n, most, total = F.count("*"), F.max("utility"), F.sum("utility")
    blend = F.lit(max_weight) * most.cast("double") + F.lit(1 - max_weight) * (total / n)
    out = scores.groupBy("paper_id").agg(blend.alias("__blend"), ((7 * most * n + 3 * total) / n).alias("score_tenths"), n.alias("n_samples"), F.sort_array(F.collect_list("chunk_id")).alias("citations"))
    return out.select("paper_id", round1(F.col("__blend")).alias("utility"), "score_tenths", "n_samples", "citations")


def agg_shrunk(scores: DataFrame, column: str, prior: float = 5.5, weight: float = 1.0) -> DataFrame:
    """(n x mean + weight x prior) / (n + weight) for each paper, to one place."""
    n = F.count("*").cast("double")
    blend = (n * (F.sum(column) / n) + F.lit(weight * prior)) / (n + F.lit(weight))
    return scores.groupBy("paper_id").agg(blend.alias("__blend")).select("paper_id", round1(F.col("__blend")).alias("shrunk"))


def quota_threshold(scored: DataFrame, by: str, quota: Column, threshold: float) -> DataFrame:
    """rank within ``by``, include (rank <= quota and score >= threshold) and the reasons against; a shortfall isn't filled."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "paper_id"))
    out = scored.withColumn("rank", place).withColumn("include", (F.col("rank") <= quota) & (F.col("score") >= threshold))
    reasons = F.array_compact(F.array(F.when(F.col("score") < threshold, "threshold_not_met"), F.when(F.col("rank") > quota, "quota_not_selected")))
    return out.withColumn("reasons", F.array_join(reasons, ","))


def threshold_only(scored: DataFrame, threshold: float) -> DataFrame:
    """As :func:`quota_threshold` with all papers in one group whose size is the quota.

    No task holds all papers; see :func:`globally_ranked`.
    """
    out = globally_ranked(scored, [-F.col("score"), F.col("paper_id")])
    include = F.col("score") >= threshold
    return out.withColumn("include", include).withColumn("reasons", F.when(include, "").otherwise("threshold_not_met"))


#: Rows of a part that one task ranks; bounds of parts come from about ``SAMPLED`` rows for each, ``MOST_PARTS`` at most.
ROWS_A_PART, SAMPLED, MOST_PARTS = 200_000, 20, 2000


def sampled_part(keyed: DataFrame, n: int, parts: int) -> Column:
    """Between which of up to ``parts`` bounds column ``__key`` lies; the bounds come from rows chosen by hash, the same in every reading."""
    chance = F.pmod(F.xxhash64("__key"), F.lit(1 << 20)) < F.lit(max(1, (SAMPLED * parts << 20) // max(1, n)))
    sample = [r[0] for r in keyed.filter(chance).select("__key").orderBy("__key").collect()]
    kinds = [f.dataType for f in keyed.schema["__key"].dataType.fields]
    places = sorted({len(sample) * k // parts for k in range(1, parts)})
    bounds = [F.struct(*[F.lit(v).cast(k) for v, k in zip(sample[i], kinds, strict=True)]) for i in places if i < len(sample)]
    # as deep as the logarithm of the number of bounds
    def among(lo: int, hi: int) -> Column:
        middle = (lo + hi) // 2
        return F.lit(lo) if lo == hi else F.when(F.col("__key") > bounds[middle], among(middle + 1, hi)).otherwise(among(lo, middle))

    return among(0, len(bounds))


def globally_ranked(rows: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """``name``: the place of each row in ``order`` over the whole table (or within ``by``), without a window over all of it.

    ``order`` are ascending keys that end in a unique one, none of them null.  The rows are saved with their key,
    so what they come from is computed once; parts, in order of ``by`` and key, hold ``ROWS_A_PART`` rows or so each, however many are
    in one group or tie in all but the last key.  Rows are numbered within a part, and the rows of the parts before are added.
    """
    by = by or []
    keyed = saved(rows.withColumn("__key", F.struct(*by, *order)))
    n = keyed.count()
    if n <= ROWS_A_PART:
        return keyed.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy("__key")).cast("int")).drop("__key")
    dealt = keyed.withColumn("__part", sampled_part(keyed, n, min(MOST_PARTS, -(-n // ROWS_A_PART))))
    local = dealt.withColumn("__local", F.row_number().over(W.partitionBy(*by, "__part").orderBy("__key")))
    sizes = dealt.groupBy(*by, "__part").agg(F.count("*").alias("__size")).withColumnsRenamed({c: f"__by_{c}" for c in by}).withColumnRenamed("__part", "__p")
    earlier = W.partitionBy(*[f"__by_{c}" for c in by]).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    same = F.col("__part") == F.col("__p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return local.join(before, same).withColumn(name, (F.col("__before") + F.col("__local")).cast("int")).select(*rows.columns, name)


def compare_retrieval(lexical: DataFrame, embedding: DataFrame, judged: DataFrame, least: float = 0.5) -> DataFrame:
    """Of two methods' chunks (query_id, chunk_id) for each query: how many both and one alone found, mean scores, verdict.

    ``judged`` has query_id, chunk_id and score; a method without a scored chunk is said to have none.
    """
    key = ["query_id", "chunk_id"]
    both = lexical.withColumn("__l", F.lit(True)).join(embedding.withColumn("__e", F.lit(True)), key, "full").join(judged, key, "left")
    in_l, in_e = F.col("__l").isNotNull(), F.col("__e").isNotNull()
    out = both.groupBy("query_id").agg(F.count_if(in_l & in_e).alias("overlap"), F.count_if(in_l & ~in_e).alias("only_lexical"), F.count_if(~in_l & in_e).alias("only_embedding"), F.avg(F.when(in_l, F.col("score"))).alias("avg_lexical"), F.avg(F.when(in_e, F.col("score"))).alias("avg_embedding"))
    return out.withColumn("verdict", mean_verdict(F.col("avg_lexical"), F.col("avg_embedding"), least))


def mean_verdict(lexical: Column, embedding: Column, least: float = 0.5) -> Column:
    """Which method's mean score is better by ``least``; a method without a scored chunk is said to have none."""
    gap = embedding - lexical
    out = F.when(lexical.isNull() & embedding.isNull(), "comparable (no scored chunks)").when(lexical.isNull(), "embedding better (lexical had no scored chunks)")
    out = out.when(embedding.isNull(), "lexical better (embedding had no scored chunks)")
    return out.when(gap >= least, "embedding better").when(gap <= -least, "lexical better").otherwise("comparable")


def first_by(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: the first decision wins."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("__n = 1").drop("__n")


def last_by(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: the latest state."""
    return first_by(rows, key, [F.desc(order)])


def missing(expected: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(returned, key, "left_anti")


def unknown(expected: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    return returned.join(expected, key, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def exactly_once(supplied: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were not returned exactly once, with both counts."""
    a, b = supplied.groupBy(*key).agg(F.count("*").alias("supplied")), returned.groupBy(*key).agg(F.count("*").alias("returned"))
    return a.join(b, key, "full").fillna(0, ["supplied", "returned"]).filter("supplied <> 1 or returned <> 1")


def until_target(candidates: DataFrame, by: str, order: list[str], target: int, start: Column | None = None) -> DataFrame:
    """Rows that are tried: those before which fewer than ``target`` succeeded (``start`` counts as earlier successes)."""
    before = F.coalesce(F.sum(F.col("success").cast("int")).over(W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return candidates.withColumn("__before", before + (start if start is not None else F.lit(0))).filter(F.col("__before") < target).drop("__before")


def keep_maybe_fill(screened: DataFrame, by: str, target: int) -> DataFrame:
    """All ``keep`` rows, then ``maybe`` rows by rank until ``target`` succeeded."""
    kept = screened.withColumn("__kept", F.sum(((F.col("priority") == "keep") & F.col("success")).cast("int")).over(W.partitionBy(by)))
    maybe = until_target(kept.filter("priority = 'maybe'"), by, ["rank"], target, F.col("__kept"))
    return kept.filter("priority = 'keep'").unionByName(maybe).drop("__kept")


def overall_verdict(lexical_wins: Column, embedding_wins: Column, valid: Column, least: int = 3) -> Column:
    """The verdict on one query by the share of decided pairs that each method wins."""
    rate = F.try_divide(embedding_wins, embedding_wins + lexical_wins)
    return F.when(valid < least, "insufficient").when(rate >= 0.6, "embedding better").when(rate <= 0.4, "lexical better").otherwise("comparable")


def pair_winner(said: Column, shown_as_a: Column) -> Column:
    """The method that a judge's ``A``, ``B`` or ``tie`` stands for, given the method that was shown as A."""
    other = F.when(shown_as_a == "lexical", "embedding").otherwise("lexical")
    return F.when(said == "tie", "tie").when(said == "A", shown_as_a).otherwise(other)


def display_order(seed: int, place: Column) -> Column:
    """Which method a valid pair shows as A: a coin for each ``place`` of a query, the same in every run."""
    coin = F.pmod(F.xxhash64(F.lit(seed), place), F.lit(2))
    return F.when(coin == 0, "embedding").otherwise("lexical")


def pair_verdicts(judged: DataFrame, by: str) -> DataFrame:
    """Counts of pairs by kind and winner, the share that embedding wins of those decided, and the verdict, for each query."""
    kind, winner = F.col("kind"), F.col("winner")
    counts = {"valid_pairs": kind == "valid", "same_chunk_ties": kind == "same_chunk", "unpaired": kind == "unpaired"}
    counts |= {"embedding_wins": winner == "embedding", "lexical_wins": winner == "lexical", "judge_ties": winner == "tie"}
    out = judged.groupBy(by).agg(*[F.count_if(test).alias(name) for name, test in counts.items()])
    rate = F.try_divide("embedding_wins", F.col("embedding_wins") + F.col("lexical_wins"))
    return out.withColumn("win_rate_embedding", rate).withColumn("verdict", overall_verdict(F.col("lexical_wins"), F.col("embedding_wins"), F.col("valid_pairs")))


def pair_overall(verdicts: DataFrame) -> DataFrame:
    """The method that wins more queries."""
    out = verdicts.agg(F.count_if(F.col("verdict") == "lexical better").alias("lexical"), F.count_if(F.col("verdict") == "embedding better").alias("embedding"))
    return out.withColumn("overall", F.when(F.col("embedding") > F.col("lexical"), "embedding better").when(F.col("lexical") > F.col("embedding"), "lexical better").otherwise("comparable overall"))


def pair_ranked(lexical: DataFrame, embedding: DataFrame) -> DataFrame:
    """query_id, rank, both chunk ids, kind: unpaired, same_chunk or valid."""
    pairs = lexical.withColumnRenamed("chunk_id", "lexical_chunk").join(embedding.withColumnRenamed("chunk_id", "embedding_chunk"), ["query_id", "rank"], "full")
    kind = F.when(F.col("lexical_chunk").isNull() | F.col("embedding_chunk").isNull(), "unpaired").when(F.col("lexical_chunk") == F.col("embedding_chunk"), "same_chunk").otherwise("valid")
    return pairs.withColumn("kind", kind)


def number_claims(claims: DataFrame, papers: str, order: list[str]) -> DataFrame:
    """claim_no, consecutive over papers in order: each paper's count is summed up, then its own numbers added.

    The running sum is over one row for each paper, so no task holds all claims.
    """
    counts = claims.groupBy(papers).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy(papers).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(papers, before.alias("__before"))
    own = F.row_number().over(W.partitionBy(papers).orderBy(*order))
    return claims.withColumn("__own", own).join(offsets, papers).withColumn("claim_no", F.col("__before") + F.col("__own")).drop("__own", "__before")


def token_window(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """used: the tokens of a key's events in the ``seconds`` up to each event."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    frame = W.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("used", F.sum("tokens").over(frame))


def request_gaps(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """gap: seconds since the key's event before; nth: its number of the day."""
    by = W.partitionBy(key).orderBy(*order)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    day = W.partitionBy(key, F.to_date("ts")).orderBy(*order)
    return events.withColumn("gap", (at - F.lag(at).over(by)) / 1e6).withColumn("nth", F.row_number().over(day))
