"""Filters of a provider search go into its requests."""

import json
from pathlib import Path
from urllib.parse import parse_qs, urlsplit

import pytest

from factloom.sources import providers
from factloom.sources.providers import Request


def stand_in(log):
    """Answers with the years 2015 to 2024 within what the URL asks for, and one record of a year that it doesn't."""

    def fetch(url):
        with Path(log).open("a") as out:
            out.write(url + "\n")
        given = parse_qs(urlsplit(url).query)
        low, high = 2015, 2024
        for part in given.get("filter", [""])[0].split(","):
            low = int(part[-10:-6]) if part.startswith("from") else low
            high = int(part[-10:-6]) if part.startswith("to") else high
        if "year" in given:
            a, b = given["year"][0].split("-")
            low, high = int(a or low), int(b or high)
        rows = [{"id": f"W{y}", "publication_year": y, "year": y} for y in [*range(low, high + 1), 1999]] + [{"id": "none"}]
        return json.dumps({"results": rows, "data": rows})

    return fetch


@pytest.mark.parametrize(("provider", "sent"), [("openalex", "filter=from_publication_date%3A2020-01-01%2Cto_publication_date%3A2022-12-31"), ("semantic_scholar", "year=2020-2022")])
def test_years_are_pushed(spark, tmp_path, provider, sent):
    log = tmp_path / "calls"
    found = providers.search(spark, provider, [Request("a"), Request("b", year_from=2021), Request("c", year_to=2010)], stand_in(log), 0.0).filter("year >= 2020 and year < 2023")
    plan = found._jdf.queryExecution().toString()
    assert " Filter " not in plan.split("== Physical Plan ==")[1]  # all of it is the source's
    assert sorted((r["query_id"], r["year"]) for r in found.collect()) == [("a", 2020), ("a", 2021), ("a", 2022), ("b", 2021), ("b", 2022)]
    calls = sorted(log.read_text().split())
    assert len(calls) == 2 and sent in calls[0] and "2021" in calls[1]


def test_queries_are_pushed_and_other_filters_stay(spark, tmp_path):
    log = tmp_path / "calls"
    every = providers.search(spark, "openalex", [Request("a"), Request("b"), Request("c")], stand_in(log), 0.0)
    assert {r["query_id"] for r in every.filter("query_id in ('a', 'c')").collect()} == {"a", "c"} and len(log.read_text().split()) == 2
    assert every.filter("query_id = 'b' and value like '%W2020%'").count() == 1 and len(log.read_text().split()) == 3
    assert every.filter("query_id = 'nothing'").count() == 0 and len(log.read_text().split()) == 3
    assert every.count() == 36 and every.filter("year is null").count() == 3


def test_years_that_exclude_each_other(spark, tmp_path):
    log = tmp_path / "calls"
    none = providers.search(spark, "semantic_scholar", [Request("a")], stand_in(log), 0.0).filter("year > 2022 and year <= 2022")
    assert none.count() == 0 and not log.exists()
