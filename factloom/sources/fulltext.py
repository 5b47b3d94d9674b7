"""Files and bodies: PDF inputs, page text, fetched bodies, settings.  Parsers and fetchers come from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, MutableMapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from ..shipping import ship

Parser = Callable[[bytes], list[str]]
LEAST_PAGE = 20


def expand_inputs(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """path, length, content of the PDFs named or in folders named, each file once; none at all is an error."""
    found = None
    for name in inputs:
        reader = spark.read.format("binaryFile")
        part = (reader if name.lower().endswith(".pdf") else reader.option("pathGlobFilter", "*.pdf")).load(name).select("path", "length", "content")
        found = part if found is None else found.unionByName(part)
    if found is None or not found.limit(1).count():
        raise ValueError("no PDF files in the inputs")
    return found.dropDuplicates(["path"])


def page_texts(files: DataFrame, parsers: list[Parser]) -> DataFrame:
    """paper_id, page_number (from 1), text, method of files (path, content): pages of 20 characters or more by the first parser that gives any.

    A file without any has one row with page_number null and the error's class in ``method``.
    """
    ship(files.sparkSession)

    def one(content: bytes) -> tuple[list[tuple[int, str]], str]:
        failed = "NoText"
        for number, parse in enumerate(parsers, 1):
            try:
                pages = [(i, t.strip()) for i, t in enumerate(parse(content), 1) if t and len(t.strip()) >= LEAST_PAGE]
            except Exception as error:  # noqa: BLE001 - any parser may fail in any way; the next one is tried
                failed = type(error).__name__
                continue
            if pages:
                return pages, f"parser {number}"
        return [], failed

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, content in zip(part["paper_id"], part["content"], strict=True):
                pages, method = one(content)
                rows += [(name, i, t, method) for i, t in pages] or [(name, None, None, method)]
            yield pd.DataFrame(rows, columns=["paper_id", "page_number", "text", "method"]).astype({"page_number": "Int32"})

    named = files.select(text.default_paper_id(F.col("path")).alias("paper_id"), "content")
    return named.mapInPandas(run, "paper_id string, page_number int, text string, method string")


def fetch_bodies(attempts: DataFrame, fetcher: Callable[[str], bytes]) -> DataFrame:
    """``attempts`` (with url) with body and reason: transport_success, invalid_url, or the error's class."""
    ship(attempts.sparkSession)
    schema = T.StructType([T.StructField("body", T.BinaryType()), T.StructField("reason", T.StringType())])

    def run(links: pd.Series) -> pd.DataFrame:
        rows: list[tuple[bytes | None, str]] = []
        for link in links:
            try:
                rows.append((fetcher(link), "transport_success") if link else (None, "invalid_url"))
            except Exception as error:  # noqa: BLE001 - what a fetcher raises is logged by class
                rows.append((None, type(error).__name__))
        return pd.DataFrame(rows, columns=["body", "reason"])

    fine = F.when(urls.is_http_url(F.col("url")), F.col("url"))
    return attempts.withColumn("__f", F.pandas_udf(run, schema)(fine)).select(*attempts.columns, "__f.body", "__f.reason")


def load_env(path: str | Path, environment: MutableMapping[str, str], only: set[str] | None = None) -> Mapping[str, str]:
    """Sets KEY=VALUE lines of a file that aren't set already (and are in ``only``); quotes round values and comments are left out."""
    found: dict[str, str] = {}
    if Path(path).is_file():
        for line in map(str.strip, Path(path).read_text(encoding="utf-8").splitlines()):
            key, sign, value = line.partition("=")
            if sign and not line.startswith("#") and key.strip() and (only is None or key.strip() in only) and key.strip() not in environment:
                found[key.strip()] = environment[key.strip()] = value.strip().strip('"').strip("'")
    return found
