"""Provider searches: URLs, a paced fetch on the executors, and a data source over it.

Nothing here opens a connection by itself: a fetcher, a picklable function from a URL to JSON
text, comes from outside.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

Fetcher = Callable[[str], str]

#: End points, fields, pace.
OPENALEX_URL = "https://api.openalex.org/works"
OPENALEX_FIELDS = "id,title,authorships,publication_year,abstract_inverted_index,primary_location,locations,cited_by_count,best_oa_location,doi"
S2_URL = "https://api.semanticscholar.org/graph/v1/paper/search"
S2_FIELDS = "title,abstract,year,authors,externalIds,citationCount,openAccessPdf,venue,publicationVenue,url"
S2_PACE = 2.0


@dataclass(frozen=True)
class Request:
    query: str
    limit: int = 100
    year_from: int | None = None
    year_to: int | None = None
    venues: tuple[str, ...] = ()


class Retryable(RuntimeError):
    """What a fetcher raises where another try may help; ``after`` is the delay that the server asked for."""

    def __init__(self, message: str = "", after: float | None = None) -> None:
        super().__init__(message)
        self.after = after


def openalex_url(r: Request) -> str:
    """Search text, limit, fields and date range, all for the provider to apply."""
    dates = [f"{name}:{year}-{day}" for name, year, day in (("from_publication_date", r.year_from, "01-01"), ("to_publication_date", r.year_to, "12-31")) if year is not None]
    return f"{OPENALEX_URL}?" + urlencode({"search": r.query, "per-page": r.limit, "select": OPENALEX_FIELDS} | ({"filter": ",".join(dates)} if dates else {}))


def s2_url(r: Request) -> str:
    """The same with a year range and venues."""
    parameters: dict[str, str | int] = {"query": r.query, "fields": S2_FIELDS, "limit": r.limit}
    if (r.year_from, r.year_to) != (None, None):
        parameters["year"] = f"{'' if r.year_from is None else r.year_from}-{'' if r.year_to is None else r.year_to}"
    if r.venues:
        parameters["venue"] = ",".join(r.venues)
    return f"{S2_URL}?{urlencode(parameters)}"


def url_column(build: Callable[[Request], str], query: Column, limit: Column, year_from: Column, year_to: Column) -> Column:
    """The request URL of each row."""

    def run(q: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        year = lambda y: None if pd.isna(y) else int(y)
        return pd.Series([build(Request(text, int(size), year(x), year(y))) for text, size, x, y in zip(q, n, a, b, strict=True)], dtype=object)

    return F.pandas_udf(run, T.StringType())(query, limit, year_from, year_to)


PROVIDERS: dict[str, tuple[Callable[[Request], str], str, float]] = {"openalex": (openalex_url, "results", 0.0), "semantic_scholar": (s2_url, "data", S2_PACE)}


YEARS = {"openalex": "publication_year", "semantic_scholar": "year"}


class Paced:
    """A fetcher with ``pace`` seconds between calls and ``tries`` tries, the delay asked for or 2^n seconds between these."""

    def __init__(self, fetcher: Fetcher, pace: float, tries: int = 3, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.fetcher, self.pace, self.tries, self.clock, self.sleep = fetcher, pace, tries, clock, sleep
        self.last: float | None = None

    def __call__(self, url: str) -> str:
        for attempt in range(self.tries):
            if self.last is not None and (wait := self.pace - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.fetcher(url)
            except Retryable as error:
                if attempt == self.tries - 1:
                    raise
                self.sleep(2.0**attempt if error.after is None else error.after)
        raise AssertionError("unreachable")


def records(provider: str, request: Request, fetcher: Fetcher) -> list[str]:
    """One search's records, each a JSON line; a request is sent once the pace allows."""
    url, key, _ = PROVIDERS[provider]
    return [json.dumps(r) for r in json.loads(fetcher(url(request))).get(key) or []]


class _Search(InputPartition):
    def __init__(self, number: int, request: dict) -> None:
        super().__init__(number)
        self.number, self.request = number, request


class _Reader(DataSourceReader):
    """Reads the searches; filters on year and query_id are the searches' own: a range of years goes into the URL, other queries aren't asked."""

    def __init__(self, provider: str, requests: list[dict], fetcher: Fetcher, pace: float) -> None:
        self.provider, self.requests, self.fetcher, self.pace = provider, requests, fetcher, pace
        self.low: int | None = None
        self.high: int | None = None
        self.known = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """What isn't about year or query_id is left to Spark."""
        for f in filters:
            if not self._take(f):
                yield f

    def _take(self, f: Filter) -> bool:
        match f:
            case EqualTo(("query_id",), str(query)):
                self.requests = [r for r in self.requests if r["query"] == query]
            case In(("query_id",), queries):
                self.requests = [r for r in self.requests if r["query"] in queries]
            case IsNotNull(("query_id",)):
                pass
            case IsNotNull(("year",)):
                self.known = True
            case EqualTo(("year",), int(year)):
                self._between(year, year)
            case GreaterThanOrEqual(("year",), int(year)):
                self._between(year, None)
            case GreaterThan(("year",), int(year)):
                self._between(year + 1, None)
            case LessThanOrEqual(("year",), int(year)):
                self._between(None, year)
            case LessThan(("year",), int(year)):
                self._between(None, year - 1)
            case _:
                return False
        return True

    def _between(self, low: int | None, high: int | None) -> None:
        self.low, self.high = _latest(self.low, low), _earliest(self.high, high)

    def partitions(self) -> list[_Search]:
        years = lambda r: {"year_from": _latest(r["year_from"], self.low), "year_to": _earliest(r["year_to"], self.high)}
        asked = [r | years(r) for r in self.requests]
        asked = [r for r in asked if None in (r["year_from"], r["year_to"]) or r["year_from"] <= r["year_to"]]
        # a paced provider is asked from one task, as a pace holds for all requests
        return [_Search(0, {"all": asked})] if self.pace or not asked else [_Search(i, {"all": [r]}) for i, r in enumerate(asked)]

    def read(self, partition: _Search) -> Iterator[tuple[str, str, int | None]]:
        fetcher = Paced(self.fetcher, self.pace)
        for r in partition.request["all"]:
            for line in records(self.provider, Request(**(r | {"venues": tuple(r["venues"])})), fetcher):
                year = json.loads(line).get(YEARS[self.provider])
                year = year if isinstance(year, int) else None
                # the provider goes by dates, the filter by the record's year
                if self._wanted(year):
                    yield r["query"], line, year

    def _wanted(self, year: int | None) -> bool:
        if year is None:
            return not self.known and self.low is None and self.high is None
        return (self.low is None or year >= self.low) and (self.high is None or year <= self.high)


def _latest(a: int | None, b: int | None) -> int | None:
    return max((x for x in (a, b) if x is not None), default=None)


def _earliest(a: int | None, b: int | None) -> int | None:
    return min((x for x in (a, b) if x is not None), default=None)


def source(fetcher: Fetcher, pace: float | None = None) -> type[DataSource]:
    """The data source ``scholarly``: options provider and requests (JSON); columns query_id, value and year."""

    class Scholarly(DataSource):
        @classmethod
        def name(cls) -> str:
            return "scholarly"

        def schema(self) -> str:
            return "query_id string, value string, year int"

        def reader(self, schema) -> DataSourceReader:
            provider = self.options["provider"]
            return _Reader(provider, json.loads(self.options["requests"]), fetcher, PROVIDERS[provider][2] if pace is None else pace)

    return Scholarly


def search(spark: SparkSession, provider: str, requests: list[Request], fetcher: Fetcher, pace: float | None = None) -> DataFrame:
    """query_id, value and year, the landed records of some searches; filters on year and query_id go to the provider.

    Each has a query_id, so the filter here drops nothing.  It is there because a plan without any filter would go by
    those that an earlier plan of the same frame has pushed; who loads the format alone has to add one too.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(source(fetcher, pace))
    found = spark.read.format("scholarly").option("provider", provider).option("requests", json.dumps([asdict(r) for r in requests])).load()
    return found.filter(F.col("query_id").isNotNull())
