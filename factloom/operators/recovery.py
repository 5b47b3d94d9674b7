"""Recovery of full texts in rounds over a frontier of locations.

Each round takes, for every paper without a confirmed full text, the next location that it
hasn't tried (by canonical URL), fetches all of them at once, judges what came and saves what
it did.  Links found in a page join the frontier of the next round.  A round is a table of its
own, so a run that stopped goes on after its last whole round and asks nobody twice.

Order: the provider's PDF, other locations with a PDF by ``place``, a landing page if no links
are known, then links in their pages' order.  Links are taken from the provider's and the landing page
only.  Beyond the provider's, ``budget`` URLs are tried; a paper's rounds are no more than that and one.

Defined results: a location without a usable URL is tried and fails as ``invalid_url``; of
locations with one canonical URL the first counts; papers without a location have no attempt; rows that repeat a
location or paper change nothing; without papers no round is saved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..shipping import ship
from ..sources.fetching import Fetched, FetchError, Fetcher
from . import identity

PROVIDER, LOCATION, LANDING, LINK = "provider", "location", "landing_page", "html_pdf"
STAGES = {PROVIDER: 0, LOCATION: 1, LANDING: 2, LINK: 3}
ATTEMPTS = "paper_id {0}, round int, source string, url string, key string, reason string, status int, final_url string, content_type string, format string, identity string, sha256 string, content binary, links array<string>"
_FETCHED = "body binary, reason string, status int, final_url string, content_type string"

#: From rows with ``content``, ``url`` and paper_id to rows with format and identity besides.
Judge = Callable[[DataFrame], DataFrame]


def fetched(rows: DataFrame, fetcher: Fetcher) -> DataFrame:
    """``rows`` (with url) with body, reason, status, final_url and content_type; errors by class or reason."""
    ship(rows.sparkSession)

    def one(url: str | None) -> tuple:
        if not url:
            return None, "invalid_url", None, None, None
        try:
            got = fetcher(url)
            got = got if isinstance(got, Fetched) else Fetched(got, url)
            fine = got.status < 400
            return (got.body if fine else None), ("transport_success" if fine else "http_error"), got.status, got.final_url, got.content_type
        except FetchError as error:
            return None, error.reason, error.status, None, None
        except TimeoutError:
            return None, "timeout", None, None, None
        except Exception as error:  # noqa: BLE001 - what a fetcher raises is logged by class
            return None, type(error).__name__, None, None, None

    names = [x.split()[0] for x in _FETCHED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = pd.DataFrame([one(u) for u in frame["__fetch"]], columns=names).astype({"status": "Int32"})
            yield pd.concat([frame.drop(columns="__fetch").reset_index(drop=True), got], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    marked = rows.withColumn("__fetch", F.when(urls.is_http_url(F.col("url")), F.col("url")))
    return marked.mapInPandas(run, f"{fields}, {_FETCHED}")


def due(locations: DataFrame, attempts: DataFrame, budget: int) -> DataFrame:
    """paper_id, source, url, key of the next attempt of each paper; ``locations`` has paper_id, source, place and url."""
    stage = F.coalesce(*[F.when(F.col("source") == name, F.lit(n)) for name, n in STAGES.items()])
    links = attempts.filter(F.size("links") > 0).select("paper_id", F.lit(LINK).alias("source"), "round", F.posexplode("links").alias("at", "url"))
    links = links.select("paper_id", "source", (F.col("round") * 1_000_000 + F.col("at")).cast("long").alias("place"), "url")
    frontier = locations.select("paper_id", "source", F.col("place").cast("long").alias("place"), "url").unionByName(links)
    frontier = frontier.withColumn("key", F.coalesce(urls.canonical_url(F.col("url")), "url", F.lit(""))).withColumn("stage", stage)
    frontier = frontier.groupBy("paper_id", "key").agg(F.min_by(F.struct("stage", "place", "source", "url"), F.struct("stage", "place", "url")).alias("x")).select("paper_id", "key", "x.*")
    per = attempts.groupBy("paper_id").agg(F.bool_or(F.col("reason") == "downloaded").alias("done"), F.count_if(F.col("source") != PROVIDER).alias("extra"), F.bool_or(F.size("links") > 0).alias("linked"))
    left = frontier.join(attempts.select("paper_id", "key"), ["paper_id", "key"], "left_anti").join(per, "paper_id", "left")
    left = left.filter(~F.coalesce("done", F.lit(False)) & ((F.col("source") == PROVIDER) | (F.coalesce("extra", F.lit(0)) < budget)))
    left = left.filter(~((F.col("source") == LANDING) & F.coalesce("linked", F.lit(False))))
    return left.groupBy("paper_id").agg(F.min_by(F.struct("source", "url", "key"), F.struct("stage", "place", "key")).alias("x")).select("paper_id", "x.*")


def judged(rows: DataFrame, judge: Judge, number: int) -> DataFrame:
    """The attempts of a round: bodies decoded, pages told from PDFs and read for links, PDFs judged."""
    body = identity.decoded(F.col("body"))
    rows = rows.withColumn("__d", F.when(F.col("reason") == "transport_success", body)).withColumn("content", F.col("__d.body"))
    rows = rows.withColumn("reason", F.coalesce("__d.reason", "reason")).drop("__d", "body")
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    page = F.col("content").isNotNull() & head.rlike(r"(?i)<(?:!doctype\s+html|html|head|meta|a)\b") & ~F.substring(head, 1, 1024).contains("%PDF-")
    found = judge(rows).withColumn("__page", page)
    links = F.when(F.col("__page") & F.col("source").isin(PROVIDER, LANDING), urls.pdf_links(F.decode("content", "UTF-8"), F.coalesce("final_url", "url"))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("links", links)  # not in the select below, where ``content`` could be taken for the new one
    confirmed = (F.col("format") == "valid_pdf") & (F.col("identity") == "confirmed") & (F.col("reason") == "transport_success")
    why = F.when(F.col("reason") != "transport_success", F.col("reason")).when(confirmed, "downloaded").when(F.col("__page"), "html_response")
    why = why.when(F.col("format") == "valid_pdf", F.col("identity")).otherwise(F.col("format"))
    return found.select(
        "paper_id", F.lit(number).alias("round"), "source", urls.sanitize_url(F.col("url")).alias("url"), "key", why.alias("reason"), "status", urls.sanitize_url(F.col("final_url")).alias("final_url"), "content_type",
        F.when(F.col("__page"), "html").otherwise(F.col("format")).alias("format"), "identity", F.when(confirmed, F.sha2("content", 256)).alias("sha256"), F.when(confirmed, F.col("content")).alias("content"), "links",
    )


def saved_rounds(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame, int]:
    """(attempts of all whole rounds in the folder, their number)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/round={n + 1}/_SUCCESS")):
        n += 1
    if not n:
        return spark.createDataFrame([], ATTEMPTS.format(kind)), 0
    return spark.read.schema(ATTEMPTS.format(kind)).parquet(*[f"{folder}/round={k}" for k in range(1, n + 1)]), n


def recover(locations: DataFrame, fetcher: Fetcher, judge: Judge, folder: str, budget: int = 3) -> DataFrame:
    """All attempts for the papers of ``locations``; one of reason ``downloaded`` ends a paper and has its content."""
    spark, kind = locations.sparkSession, locations.schema["paper_id"].dataType.simpleString()
    while True:
        attempts, n = saved_rounds(spark, folder, kind)
        if n > budget:
            return attempts
        now = due(locations, attempts, budget)
        if now.isEmpty():
            return attempts
        judged(fetched(now, fetcher), judge, n + 1).write.mode("overwrite").parquet(f"{folder}/round={n + 1}")


def outcomes(locations: DataFrame, attempts: DataFrame) -> DataFrame:
    """paper_id, outcome (downloaded, recovery_exhausted, or no_oa_url without a provider's PDF), rounds and source of each paper with a location."""
    last = attempts.groupBy("paper_id").agg(F.bool_or(F.col("reason") == "downloaded").alias("done"), F.max("round").alias("rounds"), F.max(F.when(F.col("reason") == "downloaded", F.col("source"))).alias("source"))
    offered = locations.groupBy("paper_id").agg(F.bool_or(F.col("source") == PROVIDER).alias("offered"))
    out = offered.join(last, "paper_id", "left")
    what = F.when(F.coalesce("done", F.lit(False)), "downloaded").when(~F.col("offered") & F.col("rounds").isNull(), "no_oa_url").otherwise("recovery_exhausted")
    return out.select("paper_id", what.alias("outcome"), F.coalesce("rounds", F.lit(0)).alias("rounds"), "source")
