"""Budgets, caches and resumed work: what a run has to remember, as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decisions import last_by


def lookup_cache(wanted: DataFrame, run: str, key: str, order: str, budget: int = 40) -> DataFrame:
    """The lookups that a run makes: one for each key, at its first row, and no more than ``budget``."""
    firsts = wanted.filter(F.col(key).isNotNull()).groupBy(run, key).agg(F.min(order).alias(order))
    return firsts.withColumn("__n", F.row_number().over(W.partitionBy(run).orderBy(order, key))).filter(F.col("__n") <= budget).drop("__n")


def retry_budget(attempts: DataFrame, run: str, order: str, budget: int = 160, most: int = 2, longest: float = 30.0) -> DataFrame:
    """status of each of (attempt, delay): first, exhausted, deferred, retry, or over_budget after ``budget`` retries of the run."""
    asks = (F.col("attempt") > 1) & (F.col("attempt") <= most + 1) & (F.col("delay") <= longest)
    spent = F.sum(asks.cast("int")).over(W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    status = F.when(F.col("attempt") == 1, "first").when(F.col("attempt") > most + 1, "exhausted").when(F.col("delay") > longest, "deferred").when(spent <= budget, "retry").otherwise("over_budget")
    return attempts.withColumn("status", status)


def provider_headers(calls: DataFrame, key: str, order: str, remaining: str, estimate: Column) -> DataFrame:
    """left: what the provider last said remains, or the local estimate before it says anything."""
    said = F.last(remaining, ignorenulls=True).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return calls.withColumn("left", F.coalesce(said, estimate))


def checkpointed(work: DataFrame, done: DataFrame, key: str, manifest: str) -> DataFrame:
    """state of each piece of work: completed where ``done`` has it under the same manifest, else pending."""
    had = done.groupBy(key, manifest).agg(F.lit(True).alias("__had"))
    return work.join(had, [key, manifest], "left").withColumn("state", F.when(F.col("__had"), "completed").otherwise("pending")).drop("__had")


def merge_resume(prior: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Fresh rows replace prior ones of the same key."""
    both = prior.withColumn("__at", F.lit(0)).unionByName(fresh.withColumn("__at", F.lit(1)))
    return last_by(both, key, "__at").drop("__at")


def attempt_counts(log: DataFrame) -> DataFrame:
    """Counters over a log of attempts (reason, requested): one row."""
    reason, asked = F.col("reason"), F.col("requested")
    return log.agg(
        F.count("*").alias("attempts"),
        F.count_if(asked).alias("http_attempts"),
        F.count_if(reason == "lookup_not_found").alias("lookup_not_found"),
        F.count_if(reason.isin("network_error", "identity_rejected") & asked).alias("fetched"),
        F.count_if((reason == "network_error") & asked).alias("fetch_failed"),
        F.count_if(reason == "identity_rejected").alias("identity_rejected"),
        F.count_if(reason == "budget_exhausted").alias("budget_skipped"),
    )


def download_stats(log: DataFrame, requested: int) -> DataFrame:
    """What came of each paper's attempts, counted over papers, and shares; a share of nothing is 0, the success rate then null."""
    reason = F.col("reason")
    per = log.groupBy("paper_id").agg(
        F.bool_or(reason == "downloaded").alias("ok"),
        F.bool_or(reason == "duplicate_reused").alias("dup"),
        F.bool_or(reason.isin("network_error", "lookup_not_found")).alias("net"),
        F.bool_or(reason == "no_oa_url").alias("oa"),
        F.bool_or("requested").alias("asked"),
    )
    ok, dup, net, oa = (F.col(c) for c in ("ok", "dup", "net", "oa"))
    out = per.agg(
        F.count("*").alias("candidates_available"),
        F.count_if(~oa).alias("with_oa_link"),
        F.count_if("asked").alias("attempted"),
        F.count_if(ok).alias("downloaded"),
        F.count_if(~ok & net).alias("failed_network"),
        F.count_if(~ok & ~net & oa).alias("failed_no_oa"),
        F.count_if(~ok & ~net & ~oa & ~dup).alias("failed_other"),
        F.count_if(~ok & ~net & ~oa & dup).alias("duplicate_reused"),
    )
    share = lambda a, b: F.coalesce(F.round(F.try_divide(a, b), 3), F.lit(0.0))
    out = out.withColumn("shortfall", F.greatest(F.lit(0), F.lit(requested) - F.col("downloaded") - F.col("duplicate_reused")))
    out = out.withColumn("oa_ratio_candidates", share(F.col("with_oa_link"), F.col("candidates_available"))).withColumn("oa_ratio_attempted", share(F.col("downloaded"), F.col("attempted")))
    return out.withColumn("validated_pdf_success_rate", F.try_divide("downloaded", "attempted"))


def event_log(events: DataFrame, run: str, stage: str, order: str) -> DataFrame:
    """seq: each event's number in its run; so_far: how many of its stage the run has had, as a snapshot at that event shows."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(run).orderBy(order))).withColumn("so_far", F.count("*").over(W.partitionBy(run, stage).orderBy(order)))


def run_status(events: DataFrame, run: str, stage: str, order: str, last: str) -> DataFrame:
    """status of each run, completed or failed, and for failed ones the stage at which it stood, without details."""
    done = F.bool_or(F.col(stage) == last)
    stood = F.concat(F.max_by(stage, order), F.lit(": processing failed (details omitted)"))
    return events.groupBy(run).agg(F.when(done, "completed").otherwise("failed").alias("status"), F.when(~done, stood).alias("error"))


def usage(calls: DataFrame, label: str, order: str, reserve: float = 800.0, least: float = 384.0) -> DataFrame:
    """scale and reserve of each label after its calls (chars, prompt, completion): each is half of what it was and half of what is measured.

    Every step needs the one before, so a label's calls are folded in order in one row.
    """
    steps = F.array_sort(F.collect_list(F.struct(order, "chars", "prompt", "completion")))
    start = F.struct(F.lit(None).cast("double").alias("scale"), F.lit(reserve).alias("reserve"))

    def step(held: Column, x: Column) -> Column:
        measured = x["prompt"] / x["chars"]
        left = F.greatest(F.lit(least), F.bround(0.5 * held["reserve"] + 0.5 * x["completion"] * 1.25, 0))
        return F.struct((0.5 * F.coalesce(held["scale"], measured) + 0.5 * measured).alias("scale"), left.alias("reserve"))

    folded = calls.groupBy(label).agg(F.aggregate(steps, start, step).alias("u"))
    return folded.select(label, F.col("u.scale").alias("scale"), F.col("u.reserve").alias("reserve"))
