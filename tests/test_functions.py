"""Scalar functions and operators on small fixtures."""

from pyspark.sql import functions as F

from factloom.functions import scores, sections, text, urls
from factloom.operators import batching
from factloom.operators import chunks as C
from factloom.operators import decisions as D
from factloom.operators import papers as P


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_identifiers(spark):
    rows = [
        ("https://arxiv.org/abs/2101.00001v2", "arxiv:2101.00001"),
        ("https://arxiv.org/pdf/2113.00001.pdf", None),
        ("https://aclanthology.org/2020.acl-main.1.pdf", "acl:2020.acl-main.1"),
        ("https://openreview.net/forum?id=abc_1", "openreview:abc_1"),
        ("https://openreview.net/forum?id=a&id=b", None),
        ("ftp://arxiv.org/abs/2101.00001", None),
        ("not a url", None),
        (None, None),
    ]
    found = spark.createDataFrame(rows, "u string, want string").select("want", urls.id_from_url(F.col("u")).alias("got")).collect()
    assert [r["got"] for r in found] == [r["want"] for r in found]


def test_urls(spark):
    u = F.col("u")
    assert one(spark, urls.canonical_url(u), u="HTTPS://Example.org:443/a?b=2&a=1#x") == "https://example.org/a?a=1&b=2"
    assert one(spark, urls.canonical_url(u), u="https://www.arxiv.org/pdf/2101.00001.pdf") == "https://arxiv.org/pdf/2101.00001"
    assert one(spark, urls.sanitize_url(u), u="https://me:pw@h.org/p?id=3&sig=abc#f") == "https://h.org/p?id=3"
    assert one(spark, urls.is_http_url(u), u="https://me@h.org/p") is False
    assert one(spark, urls.derived_pdf(u), u="acl:P19-1001") == "https://aclanthology.org/P19-1001.pdf"


def test_text(spark):
    t = F.col("t")
    assert one(spark, text.norm_doi(t), t=" https://doi.org/10.1/AbC ") == "10.1/abc"
    assert one(spark, text.norm_doi(t), t="doi:") is None
    assert one(spark, text.norm_title(t), t="  A b \n C ") == "a b c"
    assert one(spark, text.norm_nfkc(t), t="ﬁne Straße-1") == "finestrasse1"
    assert one(spark, text.query_terms(t), t="The art of RAG, the art") == ["art", "rag"]
    assert one(spark, text.strip_fence(t), t="```json\n{\"a\": 1}\nmore\n```") == '{"a": 1}'
    assert one(spark, text.safe_filename(t), t="10.1/..a b_") == "10.1_..a_b.pdf"
    assert one(spark, text.is_table(t), t="| a |\n| b |") is True
    assert one(spark, text.limitation_cue(t), t="This remains unexplored.") is True
    assert one(spark, text.norm_doc_id(t), t=" [doc_3] ") == "DOC_3"


def test_scores(spark):
    assert [one(spark, scores.duration_seconds(F.col("t")), t=t) for t in ("12", "500ms", "3s", "2m", "x")] == [12.0, 0.5, 3.0, 120.0, None]
    assert one(spark, scores.provider_error(F.col("t"), F.col("c")), t="retry in 3s", c=429) == ("retry_after", 3.0)
    assert one(spark, scores.provider_error(F.col("t"), F.col("c"))["kind"], t="5 requests per day", c=429) == "daily_quota"
    assert one(spark, scores.provider_error(F.col("t"), F.col("c"))["kind"], t="overloaded", c=500) == "service"
    assert one(spark, scores.citation_score(F.col("c")), c=5000) == 1.0


def test_round1(spark):
    import random

    random.seed(2)
    values = [x / 20 for x in range(200)] + [random.random() * 10 for _ in range(500)] + [0.7 * m + (1 - 0.7) * (t / n) for n in range(1, 5) for m in range(11) for t in range(m, m * n + 1)]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(scores.round1(F.col("x"))).collect()]
    assert found == [round(v, 1) for v in values]


def test_rounding_decides(spark):
    """Nine scores of 6 shrink to 5.95, which is 6.0 and included; tied utilities go by id."""
    rows = spark.createDataFrame([("a", f"a{i}", 6) for i in range(9)], "paper_id string, chunk_id string, utility int")
    assert D.agg_shrunk(rows, "utility").collect()[0]["shrunk"] == 6.0
    rows = spark.createDataFrame([("p", "1", 8), ("p", "2", 7), ("q", "3", 7)], "paper_id string, chunk_id string, utility int")
    assert {r["paper_id"]: r["utility"] for r in D.agg_functional(rows).collect()} == {"p": round(0.7 * 8 + (1 - 0.7) * 7.5, 1), "q": 7.0}


def test_verdicts(spark):
    rows = [("q", k, w) for k, w in [("valid", "embedding"), ("valid", "lexical"), ("valid", "embedding"), ("valid", "tie"), ("same_chunk", None), ("unpaired", None)]] + [("r", "valid", "lexical")] + [("s", "valid", "tie")] * 3
    found = {r["q"]: r for r in D.pair_verdicts(spark.createDataFrame(rows, "q string, kind string, winner string"), "q").collect()}
    assert found["q"]["verdict"] == "embedding better" and found["q"]["judge_ties"] == 1 and found["r"]["verdict"] == "insufficient" and found["s"]["verdict"] == "comparable"
    assert D.pair_overall(spark.createDataFrame([("tie",), ("lexical better",)], "verdict string")).collect()[0]["overall"] == "lexical better"


def test_sections(spark):
    cases = [("3 Methods", "method"), ("2.1 Method", "other"), ("Limitations", "limitations"), ("References Cited", "references"), ("Appendix A", "appendix")]
    assert [one(spark, sections.heading_class(F.col("h"))["name"], h=h) for h, _ in cases] == [c for _, c in cases]
    category = lambda s, t="plain": one(spark, sections.category(F.col("s"), F.col("t")), s=s, t=t)
    assert category("Paper > 2 Method > 2.1 Ranking") == "method"
    assert category("Experiments", "we use three datasets") == "evaluation_setup"
    assert category("Experiments") == "results"
    assert category("Paper > Appendix > A.1 Additional Results") == "results"
    assert category("Paper > Appendix > C.2 Extra Proof") == "other"
    assert category("", "Abstract\nwords") == "context"
    assert one(spark, sections.merge_numbered(F.col("s")), s="2.1.3 X") == "2"
    assert one(spark, sections.canonical_section(F.col("s")), s="Our Approach") == "method"


def test_venues():
    assert "nips" in P.venue_tokens(None)
    assert P.venue_tokens(["none"]) == []
    assert P.venue_tokens(["NIPS"]) == sorted(["neurips", "nips", "annualconferenceonneuralinformationprocessingsystems"])


def test_chunk_words(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(471))), (2, "a b c"), (3, None), (4, " ".join("x" * 1 for _ in range(250)))], "paper_id long, text string")
    found = {r["chunk_id"]: len(r["text"].split()) for r in C.chunk_words(docs).collect()}
    assert found == {"1-p1-1-c1": 250, "1-p1-1-c2": 250, "1-p1-1-c3": 31, "4-p1-1-c1": 250}


def test_chunk_sections(spark):
    body = "# Paper\n\nSome words stand here at first.\n\n## 2 Method\n\nWe rank all papers by their score.\n\n| a |\n| b |\n\n## Noise\n\n_x_\n\n## Results\n\nEverything went as it should have gone."
    rows = C.chunk_sections(spark.createDataFrame([(1, body), (2, None)], "paper_id long, text string")).orderBy("ord").collect()
    assert [(r["chunk_id"], r["section"]) for r in rows] == [("1-c1", "Paper"), ("1-c2", "Paper > 2 Method"), ("1-c3", "Paper > Results")]


def test_batch_tokens(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([5, 5, 5, 20, 1])], "paper_id long, ord long, tokens long")
    found = batching.batch_tokens(rows, "paper_id", ["ord"], 10).orderBy("ord").collect()
    assert [r["batch"] for r in found] == [0, 0, 1, 2, 3]


def test_quota(spark):
    rows = spark.createDataFrame([("a", "q", 9.0), ("b", "q", 7.0), ("c", "q", 7.0), ("d", "r", 5.0)], "paper_id string, query string, score double")
    found = {r["paper_id"]: (r["include"], r["reasons"]) for r in D.quota_threshold(rows, "query", F.lit(2), 6.0).collect()}
    assert found == {"a": (True, ""), "b": (True, ""), "c": (False, "quota_not_selected"), "d": (False, "threshold_not_met")}


def test_cap_equals_greedy(spark):
    import random

    random.seed(1)
    rows = [(i, random.randrange(4), float(random.randrange(6))) for i in range(60)]
    want, used = [], {}
    for i, p, s in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if used.get(p, 0) < 3 and len(want) < 10:
            used[p] = used.get(p, 0) + 1
            want.append(i)
    found = C.top_capped(spark.createDataFrame(rows, "chunk_id long, paper_id long, score double"), 10, 3, "paper_id", ["paper_id", "chunk_id"]).collect()
    assert sorted(r["chunk_id"] for r in found) == sorted(want)


def test_partitioning_does_not_matter(spark, sf_dir):
    from factloom.sources import adapters

    papers = adapters.papers(spark, sf_dir)
    a = P.filter_chain(papers, P.FilterPolicy(2016)).select("paper_id", "pos").collect()
    b = P.filter_chain(papers.repartition(7, "title"), P.FilterPolicy(2016)).select("paper_id", "pos").collect()
    assert sorted(a) == sorted(b)


def test_venue_automaton(spark):
    """One pass for thousands of tokens finds what a token at a time does; names don't run together."""
    from factloom.operators import venues as V

    rows = [(1, ["Proc. of the Intl. Conf. on Learning Representations (ICLR)"]), (2, ["Journal of Things", "ACL 2020"]), (3, []), (4, None), (5, ["icl", "r"]), (6, [None, "ICLR"])]
    data = spark.createDataFrame(rows, "id int, names array<string>")
    tokens = ["iclr", "acl", *(f"token{i}" for i in range(3000))]
    found = {r["id"]: list(r["t"]) for r in data.select("id", V.found_tokens(F.col("names"), tokens).alias("t")).collect()}
    assert found == {1: ["iclr"], 2: ["acl"], 3: [], 4: [], 5: [], 6: ["iclr"]}
    for some in (["iclr", "acl"], tokens):
        assert {r["id"]: r["ok"] for r in data.select("id", V.allowed(F.col("names"), some).alias("ok")).collect()} == {i: bool(t) for i, t in found.items()}
    assert data.filter(V.allowed(F.col("names"), [])).count() == 6


def test_venues_resolved(spark):
    from factloom.operators import venues as V

    wanted = spark.createDataFrame([(1, "N.I.P.S."), (1, "My Workshop"), (2, "tyop"), (3, ""), (3, None), (4, "neurips"), (4, "NIPS")], "id int, name string")
    found = {}
    for r in V.resolved(wanted, V.aliases(spark), "id").collect():
        found.setdefault(r["id"], set()).add(r["token"])
    nips = {"neurips", "nips", "annualconferenceonneuralinformationprocessingsystems"}
    assert found == {1: nips | {"myworkshop"}, 4: nips}
