"""The engine's relations from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C

SECTION_NAMES = ["Abstract", "1 Introduction", "2 Related Work", "3 Method", "4 Experiments", "5 Results", "6 Limitations", "References", "Appendix"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, title (up to the first full stop), abstract, year, citation_count, venue, query_group, ord, lang."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    return d.select(
        i.alias("paper_id"),
        F.substring_index("text", ".", 1).alias("title"),
        F.col("text").alias("abstract"),
        (2015 + i % 12).cast("int").alias("year"),
        F.when(i % 7 != 0, (i * 37) % 1500).cast("int").alias("citation_count"),
        F.col("source").alias("venue"),
        (i % 4).alias("query_group"),
        i.alias("ord"),
        "lang",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, chunk_id, ord, text, section, utility of word windows; sections go round by ordinal."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")
    names = F.array(*[F.lit(x) for x in SECTION_NAMES])
    return C.chunk_words(docs).withColumn("section", F.element_at(names, ((F.col("ord") - 1) % len(SECTION_NAMES) + 1).cast("int"))).withColumn("utility", (F.col("paper_id") * 13 + F.col("ord") * 7) % 11)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("paper_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id and priority: keep for good and clean rows, reject for toxic ones, maybe for others."""
    labels = read(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("paper_id"), F.when(F.col("toxic") == 1, "reject").when(F.col("quality") == 1, "keep").otherwise("maybe").alias("priority"))
