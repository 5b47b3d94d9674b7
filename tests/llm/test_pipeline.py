"""The pipeline's stages against plain versions of their decisions."""

import re

from factloom.llm import common, secretscan

from .test_operators import brute_components


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "deduplicate", "decontaminate", "secrets", "mix"]
    docs = common.table(spark, sf_dir, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}
    component, _ = brute_components(list(rows.items()))
    rows = {d: t for d, t in rows.items() if component[d] == d}
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [plain(r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    rows = {d: t for d, t in rows.items() if not any(i in plain(t) for i in items)}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == set(rows)
    stage = docs
    for name, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, sf_dir)
        assert stage.columns == docs.columns, name
    kept = {r["doc_id"]: r["text"] for r in stage.collect()}
    assert set(kept) == set(rows)
    assert not any(secretscan.base_spans(t) for t in kept.values())
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in kept.items()}
    assert {d: r["size"] for d, r in out.items()} == words
    assert sum(r["taken"] for r in out.values()) <= sum(words.values()) * 1.01


def test_stages_on_awkward_documents(spark, sf_dir, tmp_path):
    """Nulls in every column, empty, blank, very short and very long texts, repeated rows and ids, other columns: each stage's result is defined."""
    import corpus_pipeline

    long = " ".join(["Ning the and of her", *(f"thand{i % 700} attion the reing of and then" for i in range(9000))])
    rows = [(1, None), (2, ""), (3, " \n"), (4, "!!! 12"), (5, long), (6, long), (7, "The and of attion, the reing thand of then."), (7, "The and of attion, the reing thand of then."), (None, "An attion of the reing and thand."), (8, None, None, None)]
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), 1, 0.5, "x") for r in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, label int, score double, `a b` string")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, sf_dir)
        if name != "mix":
            assert docs_out.columns == docs.columns, name
        docs_out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted((r["doc_id"] or -1) for r in docs.collect())
    # texts without a letter go; of equal texts and of repeated ids one stays; a null id is a document of its own
    assert kept == {"language": [-1, 5, 6, 7, 7], "deduplicate": [-1, 5, 7], "decontaminate": [-1, 5, 7], "secrets": [-1, 5, 7], "mix": [-1, 5, 7]}


def test_stages_on_an_empty_table(spark, sf_dir):
    import corpus_pipeline

    docs = common.table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0, name
        docs = docs if name == "mix" else out


def test_clashing_columns_are_errors(spark, sf_dir):
    import pytest
    from pyspark.sql import functions as F

    from factloom.llm import jaccard

    docs = common.table(spark, sf_dir, "documents")
    for name in ("__dedup_id", "__bloom_hash"):
        with pytest.raises(ValueError):
            jaccard.deduplicate(docs.withColumn(name, F.lit(1)))
