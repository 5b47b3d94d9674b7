"""Sequential folds, outside clients, sources and sinks against values worked out by hand."""

import itertools
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunks as C
from factloom.operators import clients as K
from factloom.operators import decisions as D
from factloom.operators import identity as I
from factloom.operators import notes as N
from factloom.sources import fulltext, providers, sinks


def test_bounded_places():
    assert C.bounded_places(["a", "b"], 5) == [0, 1]
    assert C.bounded_places(list("aaaabc"), 4) == [0, 1, 4, 5]
    assert C.bounded_places(list("abcd"), 2) == [0, 1]
    # 0 and 7 first; then of 1-6 the first, of 2-6 the second of two at stride 2, of 2, 3, 5, 6 the third at stride 1
    assert C.bounded_places(list("aaaaaaab"), 5) == [0, 1, 4, 5, 7]


def test_bounded_keeps_every_section(spark):
    random.seed(1)
    for _ in range(100):
        names = [random.choice("abcd") for _ in range(random.randrange(1, 30))]
        cap = random.randrange(1, 12)
        found = C.bounded_places(names, cap)
        assert found == sorted(set(found)) and len(found) == min(cap, len(names))
        firsts = [names.index(n) for n in dict.fromkeys(names)]
        assert set(firsts[:cap]) <= set(found)


def test_note_batches():
    assert C.halved("x" * 100, 10) == ["x" * 25] * 4
    with pytest.raises(ValueError):
        C.halved("x" * 30, 2)
    found = C.note_batches(["m", "r", "m"], ["a" * 20, "b" * 100, "c" * 20], 10)
    assert [(b, i, len(t)) for b, i, t in found] == [(0, 0, 20), (0, 2, 20), (1, 1, 25), (2, 1, 25), (3, 1, 25), (4, 1, 25)]


def test_sequential_queries(spark, sf_dir):
    from factloom.plans import queries as core

    kept = core.QUERIES["bounded_chunks"](spark, sf_dir).groupBy("paper_id").count().agg(F.max("count")).collect()[0][0]
    assert kept == 6
    batches = core.QUERIES["batch_tokens_notes"](spark, sf_dir)
    assert batches.groupBy("paper_id", "batch").agg(F.sum(F.length("piece")).alias("n")).filter("(n + 3) / 4 > 61").count() == 0
    whole = batches.groupBy("chunk_id").agg(F.sum(F.length("piece")).alias("n"))
    chunks = core.QUERIES["chunk_sections"](spark, sf_dir).select("chunk_id", F.length("text").alias("m"))
    assert whole.join(chunks, "chunk_id", "full").filter("not n <=> m").count() == 0
    shown = {r["shown"] for r in core.QUERIES["display_order"](spark, sf_dir).collect()}
    assert shown == {"lexical", "embedding"}


def test_pack_equals_a_plain_fold():
    random.seed(3)
    word = lambda: random.choice(["aa", "b", "|", "cc"])
    for _ in range(300):
        paragraphs = []
        for _ in range(random.randrange(6)):
            if random.random() < 0.2:
                paragraphs.append("| x |\n| y |")
            else:
                paragraphs.append(" ".join(word() for _ in range(random.randrange(1, 15))))
        parts = C.pack("\n\n".join(paragraphs), 8, 2)
        kept = [w for p in parts for w in p.split()]
        # nothing but overlaps and short ends of windows is added or lost
        assert set(kept) <= {w for p in paragraphs for w in p.split()} and (not paragraphs or parts)
        for p in parts:
            longest = max((len(x.split()) for x in p.split("\n\n") if not C.is_table_block(x)), default=0)
            assert longest <= 8


@pytest.mark.parametrize("part", [200_000, 40])
def test_global_rank_equals_window(spark, monkeypatch, part):
    """As one part and as many; ties in all but the last key, and a null group, are dealt out too."""
    monkeypatch.setattr(D, "ROWS_A_PART", part)
    rows = spark.createDataFrame([(i, float(random.Random(i).randrange(20)) if i % 2 else 0.0, [None, "g", "g", "h"][i % 4]) for i in range(3000)], "id long, score double, grp string").repartition(5)
    found = D.globally_ranked(rows, [-F.col("score"), F.col("id")]).collect()
    want = {r["id"]: k for k, r in enumerate(sorted(found, key=lambda r: (-r["score"], r["id"])), 1)}
    assert len(found) == 3000 and {r["id"]: r["rank"] for r in found} == want
    found = D.globally_ranked(rows, [-F.col("score"), F.col("id")], by=["grp"]).collect()
    assert len(found) == 3000
    for g in (None, "g", "h"):
        mine = sorted((r for r in found if r["grp"] == g), key=lambda r: (-r["score"], r["id"]))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))


def test_parts_of_ranks_grow_with_the_rows(spark, monkeypatch):
    rows = spark.range(4000).withColumn("__key", F.struct(F.lit(0).alias("tie"), F.col("id")))
    for parts in (2, 40):
        sizes = [r["count"] for r in rows.groupBy(D.sampled_part(rows, 4000, parts).alias("p")).count().collect()]
        assert len(sizes) == parts and max(sizes) < 3 * 4000 / parts


def test_repair_and_retry():
    calls = []

    def client(prompt, schema):
        calls.append(prompt)
        return "nonsense" if len(calls) == 1 else '```json\n{"rows": [{"chunk_id": "1", "s": 3}]}\n```'

    parse = lambda raw: K.indexed(raw, "rows", ["1"], {"s": (0, 10)})
    assert K.repaired(client, "ask", None, parse) == {"1": {"s": 3}} and len(calls) == 2 and "nonsense" in calls[1]
    with pytest.raises(K.MalformedAnswer):
        K.repaired(lambda p, s: "nonsense", "ask", None, parse)
    for raw in ('{"rows": []}', '{"rows": [{"chunk_id": "1", "s": 3}, {"chunk_id": "1", "s": 3}]}', '{"rows": [{"chunk_id": "2", "s": 3}]}'):
        with pytest.raises(K.IncompleteAnswer):
            parse(raw)
    with pytest.raises(K.MalformedAnswer):
        parse('{"rows": [{"chunk_id": "1", "s": 11}]}')
    tries, slept = itertools.count(), []

    def flaky():
        if next(tries) < 2:
            raise K.Transient
        return "ok"

    assert K.retried(flaky, sleep=slept.append) == "ok" and slept == [5.0, 10.0]
    with pytest.raises(K.Transient):
        K.retried(lambda: (_ for _ in ()).throw(K.Transient()), retries=1, sleep=lambda s: None)


def test_encoder_count(spark):
    rows = spark.createDataFrame([("a",), ("bb",)], "text string")
    with pytest.raises(Exception, match="1 vectors for 2 texts"):
        K.encode_chunks(rows.coalesce(1), lambda texts: [[1.0]]).collect()


def test_synthesised(spark):
    sections = spark.createDataFrame([(1, "One", "why", ["claim-1", "claim-2"]), (2, "Two", "how", ["claim-3"])], "section_index int, title string, purpose string, claim_ids array<string>")
    claims = spark.createDataFrame([("claim-1", "a"), ("claim-2", "b"), ("claim-3", "c")], "claim_id string, text string")

    def client(prompt, schema):
        if "claim-3" in prompt and "could not be used" not in prompt:
            return '{"report": "Says [claim-1]."}'
        return '{"report": "Says [claim-%s]."}' % ("3" if "claim-3" in prompt else "2")

    found = {r["section_index"]: r["report"] for r in K.synthesised(sections, claims, client).collect()}
    assert found == {1: "Says [claim-2].", 2: "Says [claim-3]."}
    with pytest.raises(Exception, match="IncompleteAnswer"):
        K.synthesised(sections, claims, lambda p, s: '{"report": "No marks."}').collect()


def test_directions_by_hand(spark):
    assessed = spark.createDataFrame([("a", 7.0, True), ("b", 6.0, True), ("c", 5.0, False)], "paper_id string, utility double, include boolean")
    evidence = spark.createDataFrame([("a", "a1"), ("b", "b1"), ("c", "c1")], "paper_id string, chunk_id string")
    claims = spark.createDataFrame([("b", "b2", "limitations"), ("c", "c2", "limitations"), ("a", "a1", "method")], "paper_id string, chunk_id string, aspect string")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(N.directions(assessed, evidence, claims)) == [("convergence", "a", "a1"), ("convergence", "b", "b1"), ("limitations", "b", "b2")]
    assert rows(N.directions(assessed.filter("paper_id <> 'b'"), evidence, claims.filter("aspect <> 'limitations'"))) == [("fallback", "a", "a1")]
    assert rows(N.directions(assessed.filter("paper_id = 'c'"), evidence, claims)) == []


def test_provider_urls():
    r = providers.Request("graph nets", 5, 2020, None, ("KDD", "ACL"))
    assert providers.openalex_url(r) == f"https://api.openalex.org/works?search=graph+nets&per-page=5&select={providers.OPENALEX_FIELDS.replace(',', '%2C')}&filter=from_publication_date%3A2020-01-01"
    assert providers.s2_url(r).endswith("&limit=5&year=2020-&venue=KDD%2CACL") and "year" not in providers.s2_url(providers.Request("x")).split("fields")[0]


def test_pace_and_tries():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    answers = iter([providers.Retryable(after=3.0), providers.Retryable(), "fine"])

    def fetch(url):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert providers.Paced(fetch, 2.0, clock=lambda: now[0], sleep=sleep)("u") == "fine"
    assert slept == [3.0, 2.0]  # the delay asked for covers the pace; the second is 2 ** 1
    with pytest.raises(providers.Retryable):
        providers.Paced(lambda u: (_ for _ in ()).throw(providers.Retryable()), 0.0, clock=lambda: now[0], sleep=sleep)("u")


def test_search_source(spark):
    def fetch(url):
        key = "data" if "semanticscholar" in url else "results"
        return json.dumps({key: [{"id": url.split("=")[1].split("&")[0]}, {"id": "x"}]})

    requests = [providers.Request("one"), providers.Request("two")]
    for provider in ("openalex", "semantic_scholar"):
        rows = sorted(map(tuple, providers.search(spark, provider, requests, fetch, 0.0).select("query_id", "value").collect()))
        assert rows == [("one", '{"id": "one"}'), ("one", '{"id": "x"}'), ("two", '{"id": "two"}'), ("two", '{"id": "x"}')]


def test_files_and_bodies(spark, tmp_path):
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1 two pages")
    (tmp_path / "a.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = fulltext.expand_inputs(spark, [str(tmp_path), str(tmp_path / "a.pdf")])
    assert files.count() == 2
    with pytest.raises(Exception):
        fulltext.expand_inputs(spark, [])

    def strict(content):
        if not content.startswith(b"%PDF"):
            raise OSError
        return ["short", "a page of more than twenty letters"]

    found = {r["paper_id"]: (r["page_number"], r["method"]) for r in fulltext.page_texts(files, [lambda c: [], strict]).collect()}
    assert found == {"b.pdf": (2, "parser 2"), "a.pdf": (None, "OSError")}

    def fetch(url):
        if "bad" in url:
            raise TimeoutError
        return b"body"

    rows = spark.createDataFrame([("https://e.org/x",), ("https://e.org/bad",), ("ftp://e.org",), (None,)], "url string")
    assert [(r["body"], r["reason"]) for r in fulltext.fetch_bodies(rows.coalesce(1), fetch).collect()] == [(b"body", "transport_success"), (None, "TimeoutError"), (None, "invalid_url"), (None, "invalid_url")]
    large = spark.createDataFrame([(bytearray(I.MOST_BYTES + 1),), (None,)], "b binary")
    assert [r[0] for r in large.coalesce(1).select(I.decoded(F.col("b"))["reason"]).collect()] == ["content_too_large", "empty_content"]


def test_load_env(tmp_path):
    (tmp_path / ".env").write_text("# note\nA = '1'\nB=2\nC\nD=\"x=y\"\n")
    environment = {"B": "kept"}
    fulltext.load_env(tmp_path / ".env", environment, {"A", "B", "D"})
    assert environment == {"B": "kept", "A": "1", "D": "x=y"} and fulltext.load_env(tmp_path / "none", environment) == {}


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "out")
    papers = spark.createDataFrame([("p", "https://u:x@e.org/a?token=1&id=2", None)], "paper_id string, url string, pdf_url string")
    events = spark.createDataFrame([("p", 1)], "paper_id string, seq int")
    at = datetime(2026, 10, 2)
    assert sinks.write_papers(papers, events, out, at) == "papers_20261002_000000_000000"
    found = sinks.published(spark, out, "papers", "papers")
    assert found.schema == papers.schema and found.collect()[0]["url"] == "https://e.org/a?id=2"
    assert sinks.published(spark, out, "papers", "events").collect() == events.collect()
    sections = spark.createDataFrame([(2, "b"), (1, "a")], "section_index int, report string")
    sinks.write_report(sections, out, " A  title ", at)
    assert [tuple(r) for r in sinks.published(spark, out, "report", "sections").orderBy("section_index").collect()] == [(1, "a", "A title"), (2, "b", "A title")]
    sinks.write_stats(spark.createDataFrame([(1,)], "n int"), out)
    assert sinks.published(spark, out, "stats", "stats").collect()[0]["n"] == 1
    with pytest.raises(FileExistsError):
        sinks.write_papers(papers, events, out, at)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, out, "nothing", "papers")


def test_a_failing_task_leaves_what_was_published(spark, tmp_path, capsys):
    """The second table's task fails: neither new table shows, nothing is left of them, the old ones read as before."""
    out = str(tmp_path / "out")
    rows = lambda n: spark.range(n).withColumn("url", F.lit("https://e.org")).withColumn("pdf_url", F.lit(None).cast("string"))
    sinks.write_papers(rows(3), spark.range(2), out, datetime(2026, 1, 1))
    broken = spark.range(4).select(F.raise_error(F.lit("secret-key")).alias("id"))
    assert sinks.saved("papers", sinks.write_papers, rows(5), broken, out, datetime(2026, 1, 2)) is None
    said = capsys.readouterr().err
    assert "Failed to save papers" in said and "secret-key" not in said
    assert sinks.published(spark, out, "papers", "papers").count() == 3 and sinks.published(spark, out, "papers", "events").count() == 2
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["papers_20260101_000000_000000"]
    # a writer that died before it published leaves a folder that no reader sees
    rows(9).write.json(f"{out}/papers_20260101_120000_000000/papers")
    assert sinks.published(spark, out, "papers", "papers").count() == 3
    for day in (3, 4, 5):
        sinks.write_papers(rows(day), spark.range(1), out, datetime(2026, 1, day))
    assert sinks.publications(spark, out, "papers") == ["papers_20260104_000000_000000", "papers_20260105_000000_000000"]
    assert sinks.published(spark, out, "papers", "papers").count() == 5
