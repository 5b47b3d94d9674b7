"""Recovery in rounds: order, budget, loops, what a stopped run does again, and the limits of a fetch."""

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.operators import recovery
from factloom.sources.fetching import Fetched, FetchError, HttpFetcher

GOOD, BAD = b"%PDF-1.7 good", b"%PDF-1.7 bad"
SCHEMA = "paper_id string, source string, place int, url string"


def judge(rows):
    body = F.decode(F.substring("content", 1, 64), "ISO-8859-1")
    return rows.withColumn("format", F.when(body.startswith("%PDF-"), "valid_pdf").otherwise("not_pdf")).withColumn("identity", F.when(body.endswith("good"), "confirmed").otherwise("mismatch"))


def web(pages, log):
    """A fetcher that notes each call in a file, as it runs in tasks."""

    def fetch(url):
        with Path(log).open("a") as out:
            out.write(url + "\n")
        got = pages[url] if url in pages else FetchError("http_error", 404)
        if isinstance(got, Exception):
            raise got
        return got

    return fetch


@pytest.fixture
def run(spark, tmp_path):
    def do(rows, pages, budget=3, folder="rounds"):
        log = tmp_path / "calls"
        found = recovery.recover(spark.createDataFrame(rows, SCHEMA), web(pages, log), judge, f"{tmp_path}/{folder}", budget)
        attempts = sorted((r["paper_id"], r["round"], r["source"], r["reason"]) for r in found.collect())
        return attempts, log.read_text().split() if log.exists() else [], found

    return do


def html(*links):
    return b"<html>" + b"".join(f'<a href="{x}">PDF</a>'.encode() for x in links)


def test_each_paper_stops_at_its_first(run):
    rows = [("a", "provider", 0, "https://e.org/a"), ("a", "location", 1, "https://e.org/a2"), ("b", "location", 2, "https://e.org/b2"), ("b", "location", 1, "https://e.org/b1"), ("b", "landing_page", 3, "https://e.org/b3")]
    attempts, calls, found = run(rows, {"https://e.org/a": GOOD, "https://e.org/b1": BAD, "https://e.org/b2": Fetched(GOOD, "https://f.org/x?token=1", 200, "application/pdf")})
    assert attempts == [("a", 1, "provider", "downloaded"), ("b", 1, "location", "mismatch"), ("b", 2, "location", "downloaded")]
    assert sorted(calls) == ["https://e.org/a", "https://e.org/b1", "https://e.org/b2"]
    last = found.filter("paper_id = 'b' and round = 2").collect()[0]
    assert last["final_url"] == "https://f.org/x" and last["content_type"] == "application/pdf" and bytes(last["content"]) == GOOD and len(last["sha256"]) == 64


def test_links_enter_the_next_round(run):
    pages = {"https://e.org/land": html("first.pdf", "/second.pdf"), "https://e.org/first.pdf": html("third.pdf"), "https://e.org/second.pdf": GOOD}
    attempts, calls, _ = run([("a", "landing_page", 0, "https://e.org/land")], pages)
    # a link's own page isn't read for links
    assert attempts == [("a", 1, "landing_page", "html_response"), ("a", 2, "html_pdf", "html_response"), ("a", 3, "html_pdf", "downloaded")]
    assert calls == ["https://e.org/land", "https://e.org/first.pdf", "https://e.org/second.pdf"]


def test_loops_and_budget(run):
    attempts, calls, _ = run([("a", "provider", 0, "https://e.org/land"), ("b", "provider", 0, "https://e.org/many")], {"https://e.org/land": html("/land#x.pdf", "https://E.org/land"), "https://e.org/many": html(*[f"{i}.pdf" for i in range(10)])})
    assert [x for x in attempts if x[0] == "a"] == [("a", 1, "provider", "html_response")]
    assert [x[3] for x in attempts if x[0] == "b"] == ["html_response", "http_error", "http_error", "http_error"]
    assert len(calls) == 5 and len(set(calls)) == 5


def test_landing_page_only_without_links(run):
    pages = {"https://e.org/p": html("x.pdf"), "https://e.org/x.pdf": BAD}
    attempts, calls, _ = run([("a", "provider", 0, "https://e.org/p"), ("a", "landing_page", 1, "https://e.org/land")], pages)
    assert calls == ["https://e.org/p", "https://e.org/x.pdf"] and attempts[-1] == ("a", 2, "html_pdf", "mismatch")


def test_a_stopped_run_asks_nobody_twice(spark, tmp_path):
    rows = [("a", "provider", 0, "https://e.org/1"), ("a", "location", 1, "https://e.org/2"), ("b", "provider", 0, "https://e.org/3")]
    data, pages, log, folder = spark.createDataFrame(rows, SCHEMA), {"https://e.org/1": BAD, "https://e.org/2": GOOD, "https://e.org/3": GOOD}, tmp_path / "calls", f"{tmp_path}/rounds"
    first = recovery.judged(recovery.fetched(recovery.due(data, recovery.saved_rounds(spark, folder, "string")[0], 3), web(pages, log)), judge, 1)
    first.write.parquet(f"{folder}/round=1")
    # a round that was cut off has no _SUCCESS and is done again
    first.filter("false").write.parquet(f"{folder}/round=2")
    Path(f"{folder}/round=2/_SUCCESS").unlink()
    for _ in range(2):
        found = recovery.recover(data, web(pages, log), judge, folder)
    assert sorted(log.read_text().split()) == ["https://e.org/1", "https://e.org/2", "https://e.org/3"]
    assert {(r["paper_id"], r["outcome"], r["rounds"], r["source"]) for r in recovery.outcomes(data, found).collect()} == {("a", "downloaded", 2, "location"), ("b", "downloaded", 1, "provider")}


def test_awkward_locations(run, spark):
    rows = [("a", "provider", 0, None), ("a", "location", 1, "ftp://e.org/x"), ("b", "location", 0, "https://e.org/t"), ("b", "location", 0, "https://e.org/t"), ("c", "location", 0, "https://e.org/empty")]
    attempts, calls, found = run(rows, {"https://e.org/t": TimeoutError(), "https://e.org/empty": b""})
    assert attempts == [("a", 1, "provider", "invalid_url"), ("a", 2, "location", "invalid_url"), ("b", 1, "location", "timeout"), ("c", 1, "location", "empty_content")]
    assert sorted(calls) == ["https://e.org/empty", "https://e.org/t"]
    assert run([], {}, folder="none")[0] == []
    seen = {r["paper_id"]: r["outcome"] for r in recovery.outcomes(spark.createDataFrame([*rows, ("d", "location", 0, "https://e.org/n")], SCHEMA), found).collect()}
    assert seen == {"a": "recovery_exhausted", "b": "recovery_exhausted", "c": "recovery_exhausted", "d": "no_oa_url"}


class _Site(BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        self.seen.append((self.path, self.headers.get("Authorization"), self.headers.get("Host")))
        if self.path.startswith("/hop"):
            n = int(self.path[4:])
            self.send_response(302)
            self.send_header("Location", f"/hop{n - 1}" if n else "/end")
            self.end_headers()
        elif self.path == "/away":
            self.send_response(301)
            self.send_header("Location", f"http://localhost:{self.server.server_port}/end")
            self.end_headers()
        elif self.path == "/gone":
            self.send_error(404)
        else:
            self.send_response(200)
            self.send_header("Content-Type", "text/plain")
            self.end_headers()
            self.wfile.write(b"x" * (5000 if self.path == "/large" else 3))

    def log_message(self, *_):
        pass


@pytest.fixture
def site():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    _Site.seen = []
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_http_limits(site):
    fetch = HttpFetcher({"Authorization": "secret"}, most_bytes=1000)
    assert fetch(f"{site}/end") == Fetched(b"xxx", f"{site}/end", 200, "text/plain")
    assert fetch(f"{site}/hop4").final_url == f"{site}/end"
    for path, reason in (("hop5", "too_many_redirects"), ("large", "content_too_large"), ("gone", "http_error")):
        with pytest.raises(FetchError) as error:
            fetch(f"{site}/{path}")
        assert error.value.reason == reason
    with pytest.raises(FetchError, match="invalid_url"):
        fetch("file:///etc/passwd")
    _Site.seen.clear()
    assert fetch(f"{site}/away").final_url.startswith("http://localhost")
    assert [a for _, a, _ in _Site.seen] == ["secret", None]
