"""What queries shuffle and how they go on at larger tables, and the odd rows that go with it."""

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.functions import text
from factloom.operators import batching
from factloom.operators import chunks as C
from factloom.operators import providers as R
from factloom.plans import queries as core


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_inverted_index_in_its_row(spark, tmp_path):
    rows = [(1, "b a b\tc a b"), (2, ""), (3, None), (4, "one")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    index = {r[0]: r[1] for r in docs.select("doc_id", R.inverted_index(text.words(F.col("text")))).collect()}
    assert index == {1: {"a": [1, 4], "b": [0, 2, 5], "c": [3]}, 2: {}, 3: {}, 4: {"one": [0]}}
    found = core.QUERIES["abstract_round_trip"](spark, str(tmp_path))
    assert {r[0]: r[1] for r in found.collect()} == {1: "b a b c a b", 2: "", 3: None, 4: "one"}
    assert "Exchange" not in plan(found)


@pytest.mark.parametrize("name", ["chunk_sections", "min_words", "prep_docs", "group_by_section"])
def test_ends_of_sections(spark, tmp_path, name):
    """After twelve paragraphs of 20 words an end of 1 to 19 words, 4 to 10 of which 250 words have room for."""
    spark.createDataFrame([(n, " ".join(["word"] * (10 * n))) for n in range(239, 262)] + [(1, "x"), (2, ""), (3, None)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    found, con = core.QUERIES[name](spark, str(tmp_path)), duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(core.ORACLE_SQL[name])
    assert sorted(tuple(r) for r in found.select(*[d[0] for d in want.description]).collect()) == sorted(want.fetchall())


def test_pack_by_paragraphs():
    body = "\n\n".join(["a b c d e"] * 3 + ["x y"])
    assert C.pack(body, 250, most_paragraphs=2) == ["a b c d e\n\na b c d e", "a b c d e\n\nx y"]
    assert C.pack(body, 10, 2) == C.pack(body, 10, 2, most_paragraphs=9) and len(C.pack(body, 250)) == 1


def test_papers_are_folded_without_a_frame_each(spark, sf_dir):
    made = core.QUERIES["chunk_sections"](spark, sf_dir).withColumn("aspect", C.aspect()).collect()
    papers = {}
    for r in sorted(made, key=lambda r: r["ord"]):
        papers.setdefault(r["paper_id"], []).append(r)
    kept, batches = core.QUERIES["bounded_chunks"](spark, sf_dir), core.QUERIES["batch_tokens_notes"](spark, sf_dir)
    want = {(k, p[i]["chunk_id"]) for k, p in papers.items() for i in C.bounded_places([r["aspect"] for r in p], 6)}
    assert {tuple(r) for r in kept.collect()} == want
    want = sorted((k, b, p[i]["chunk_id"], t) for k, p in papers.items() for b, i, t in C.note_batches([r["aspect"] for r in p], [r["text"] for r in p], 60))
    assert sorted(tuple(r) for r in batches.collect()) == want
    assert "FlatMapGroups" not in plan(kept) + plan(batches)


def test_batches_of_many_keys(spark, sf_dir):
    """Keys that are whole in a piece aren't gathered one by one."""
    rows = spark.range(3000).select((F.col("id") / 3).cast("long").alias("name"), F.col("id").alias("at"), F.lit(40).alias("tokens"))
    found = batching.batch_tokens(rows, "name", ["at"], 100, 5)
    assert [tuple(r) for r in found.groupBy("batch").count().orderBy("batch").collect()] == [(0, 2000), (1, 1000)]
    seen = plan(found)
    assert "SortMergeJoin" not in seen and "BroadcastHashJoin" in seen


def test_chunks_are_cut_once(spark, sf_dir):
    """Assessments, packs, notes and their numbers come from one saved table of chunks."""
    for name in ("scoped_notes", "join_sources", "join_claim_paper"):
        seen = core.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in seen
