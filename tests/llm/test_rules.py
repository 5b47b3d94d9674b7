"""Rules of single operators that the larger tests don't reach: licences round notices, speech, contexts of secrets, short texts, passages that stay."""

import random
import re
from functools import lru_cache
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from factloom.llm import common, langid, licences, repeats, secretscan, toxicity

from .test_operators import every_segmentation, frame


def larger(spark):
    if not Path("/root/testdata/sf0.01").is_dir():
        pytest.skip("no test tables")
    return common.table(spark, "/root/testdata/sf0.01", "documents")


def edited(text, draw, times=2):
    """``text`` with some words exchanged."""
    words = text.split()
    for i in draw.sample(range(1, len(words)), times):
        words[i] = f"edit{i}"
    return " ".join(words)


def test_licence_kept_round_its_notice():
    """A long template, two words of it changed, is found although a short notice in it is nearer to its own template."""
    draw, found = random.Random(4), licences.Templates(licences.TEMPLATES, licences.LEAST_DICE)
    long = [name for name, text in licences.TEMPLATES.items() if len(text.split()) >= 30]
    assert len(long) >= 8
    for name in long:
        for _ in range(5):
            text = edited(licences.TEMPLATES[name], draw)
            assert name in {m[0] for m in found.matches(f"before it {text} and after")}, text
    notice = licences.TEMPLATES["Apache-2.0-notice"]
    text = licences.TEMPLATES["Apache-2.0"].replace("compliance", "agreement")
    assert {"Apache-2.0", "Apache-2.0-notice"} <= {m[0] for m in found.matches(text)}
    assert [m[0] for m in found.matches(notice)] == ["Apache-2.0-notice"]


def test_nearer_template_of_one_place_only():
    found = licences.Templates({"A": "alpha beta gamma delta epsilon zeta", "B": "alpha beta gamma delta epsilon eta"}, 0.8)
    assert [m[0] for m in found.matches("x alpha beta gamma delta epsilon zeta y")] == ["A"]


def test_colon_before_speech():
    g = toxicity.SEED_MODEL.grammar
    score = lambda text: max(g.clauses(text))
    plain = score("you are an idiot")
    for said in ("He said: you are an idiot", "She told the whole room: you are an idiot", 'the sign: "you are an idiot"', "Er sagte: you are an idiot"):
        assert score(said) < plain, said
    assert score("look here: you are an idiot") == plain  # no one is reported
    assert len(g.clauses("you idiot: you moron")) == 2


@pytest.mark.parametrize("phrase", ["won't be", "can't be", "cannot be", "shouldn't be", "wouldn’t be", "couldn't be", "isn't", "aren't", "don't be", "cant be", "not be"])
def test_contracted_negations(phrase):
    g = toxicity.SEED_MODEL.grammar
    assert max(g.clauses(f"you {phrase} an idiot")) < max(g.clauses("you be an idiot"))


def test_kept_columns_may_not_clash(spark):
    data = frame(spark, [(1, "you idiot")])
    with pytest.raises(ValueError):
        toxicity.score(data, toxicity.SEED_MODEL, ("doc_id", "score"))
    with pytest.raises(ValueError):
        langid.predict(data, langid.fit(data, F.lit(True)), ("doc_id", "score"))


CONTEXTS = ["password := {x8$kQ2!vLp}", "'password' => '{x8$kQ2!vLp}'", "pass={x8$kQ2!vLp}", "mysqldump --password {x8$kQ2!vLp} all", "<password>{x8$kQ2!vLp}</password>", "mysql://root:{x8$kQ2!vLp}@db/1"]
CONTEXTS += ["Authorization: Bearer {eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0}", "--db-token {x8$kQ2!vLp}", '<conn dbPassword="{x8$kQ2!vLp}"/>', "<client_secret type='a'> {x8$kQ2!vLp} </client_secret>", "postgresql+psycopg://u:{q7#Zk9!pW}@h:5432/d"]


def test_secrets_in_other_contexts(spark):
    texts = [x.replace("{", "").replace("}", "") for x in CONTEXTS]
    found = {r["doc_id"]: r["spans"].split(",") for r in secretscan.scan(frame(spark, list(enumerate(texts)))).collect()}
    for i, x in enumerate(CONTEXTS):
        assert f"guess:{x.index('{')}:{x.index('}') - 1}" in found[i], x
    clean = {r["doc_id"]: r["text"] for r in secretscan.redact(frame(spark, list(enumerate(texts)))).collect()}
    for i, x in enumerate(CONTEXTS):
        assert re.search(r"\{(.*?)\}", x)[1] not in clean[i], clean[i]
    prose = ["a mountain pass: beautiful in the morning", "bearer of good news", "see http://example.org:8080/path@2x", "the pass = everyone", "He used --password without thinking", "<password>your password</password>", "compass=x8$kQ2!vLp"]
    assert [secretscan.guess_spans(t) for t in prose] == [[]] * len(prose)


def test_guess_spans_on_documents(spark, sf_dir):
    """Guess spans of every document, a credential line put into it: the value is one if the cheapest of all its segmentations is costly."""
    draw = random.Random(12)
    parts, cost = ["password", "g@rden", "1999", "aaaa", "abcd", "qwer", "zz9", "x", "Q", "$k", "#7", "ab"], lru_cache(None)(lambda value, rank: every_segmentation(value, dict(rank)))
    docs, want = [], {}
    for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        value = "".join(draw.choice(parts) for _ in range(4))[:10]
        head = f"{r['text'] or ''}\n{draw.choice(('password', 'db_secret', 'api-key'))}{draw.choice((': ', ' = ', '=', ' := ', ' => '))}"
        docs.append((r["doc_id"], f"{head}{value}\nrest"))
        want[r["doc_id"]] = (len(head), value)
    data = frame(spark, docs)
    words = secretscan.corpus_words(data)
    rank = tuple((w, k) for w, k in secretscan.ranks(words).items() if len(w) <= 10)
    seen = set()
    for r in secretscan.scan(data).collect():
        at, value = want[r["doc_id"]]
        spans = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s]
        costly = cost(value, rank) >= secretscan.LEAST_COST
        assert any(a <= at and at + len(value.rstrip(".,;:)]}>\"'")) <= b for a, b in spans) or not costly, value
        assert (f"guess:{at}:{at + len(value)}" in r["spans"].split(",")) <= costly, value
        seen.add(costly)
    assert seen == {True, False}


def test_no_labelled_text_is_rejected(spark):
    """At a size with very short texts too."""
    docs = larger(spark)
    lettered = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in langid.accepted(docs, langid.fit(docs, F.lit(True))).collect()} == lettered
    bound = [langid.needed_cosine(n) for n in range(2000)]
    assert bound == sorted(bound) and bound[5] < 0.05 and max(b - a for a, b in zip(bound, bound[1:], strict=False)) < 0.021


def passages(text, n=50):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_strip_keeps_a_copy_of_every_passage(spark):
    """Also where a span joins passages that are first held by different documents."""
    draw = random.Random(8)
    some = lambda n: [f"s{draw.randrange(10**7)}" for _ in range(n)]
    blocks = [some(60) for _ in range(6)]
    rows = [(1, " ".join(blocks[0])), (2, " ".join(blocks[1] + blocks[0])), (3, " ".join(blocks[1]))]
    for i in range(4, 30):
        parts = [some(draw.randrange(30))]
        for _ in range(draw.randrange(1, 4)):
            b = blocks[draw.randrange(6)]
            parts += [b[draw.randrange(10) :], some(draw.randrange(12))]
        rows.append((i, " ".join(sum(parts, []))))
    docs = frame(spark, rows).repartition(3)
    after = {r["doc_id"]: r["text"] for r in repeats.strip(docs, repeats.find(docs)).collect()}
    assert len(after) == len(rows)
    holders = {}
    for d, t in rows:
        for p in passages(t):
            holders.setdefault(p, []).append(d)
    repeated = {p: sorted(h) for p, h in holders.items() if len(h) > 1}
    assert repeated and all(p in passages(after[h[0]]) for p, h in repeated.items())
    # a word that only passages first held elsewhere cover is gone
    for d, t in rows:
        w = t.split()
        stay, go = set(), set()
        for i in range(len(w) - 49):
            p = tuple(x.lower() for x in w[i : i + 50])
            if p in repeated:
                (stay if repeated[p][0] == d else go).update(range(i, i + 50))
        assert after[d].split() == [x for i, x in enumerate(w) if i not in go - stay], d
    assert after[2].split() == blocks[1] and after[3] == "" and after[1] == rows[0][1]
