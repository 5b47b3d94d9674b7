"""Filter interaction audit: what five document filters do to each other in every order.

A relational word pipeline: texts are dealt out by document, words exploded, counted by
(document, word) and then by document for totals and distinct words, which needs no
shuffle of the words themselves.  The flags that need no words are joined to those counts
from the outside, and so are the first holders of each text and the labels.  One
aggregation by part then has 32 conditional counts, one for each set of filters that a
document fails (and 32 each for good and toxic ones), from which all orders follow.

Filters: A under ``least_words`` words; B fewer than half of the words distinct; C over 2
capitals A-Z in 100 code points; D a symbol of ``#$%&*|``; E the same text as a document of
smaller id anywhere in the table.

Skew: rows are reduced before each join; a document's words go by its id, its text's
digest and the partition it was read from, so that rows repeated word for word spread too; texts
that over a thousandth of all rows share (at most a thousand) are looked up by broadcast, and
rows without an id are kept out of the joins by id.

Defined results: a null text is an empty one (no words, fails A); a null source is the part
'' together with the empty source; rows that repeat a doc_id are documents of their own, and
neither they nor rows without an id fail E for each other's sake, only for a smaller id; a
label of any row of ``labels`` with that id counts, rows without an id have none; a text of
any length is one document; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
#: Texts held by more than one in so many rows, at most as many, are looked up by broadcast.
HOT_SHARE = 1000


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def _failing(letter: str, failed: Column) -> Column:
    return F.when(failed, F.lit(_bit(letter))).otherwise(F.lit(0))


def word_totals(docs: DataFrame) -> DataFrame:
    """__id, __digest, n_words, n_distinct: one row for each (doc_id, text) that has a word.  ``docs`` has these and __text."""
    key = ["__id", "__digest", "__read"]
    dealt = docs.select("__id", "__digest", F.spark_partition_id().alias("__read"), "__text").repartition(*key)
    words = dealt.select(*key, F.explode(F.split("__text", BLANKS)).alias("__word")).filter("__word <> ''")
    counted = words.groupBy(*key, "__word").agg(F.count("*").alias("__n"))
    # rows that repeat one document word for word in one partition count together: distinct words are the same, totals a multiple
    totals = counted.groupBy(*key).agg(F.sum("__n").alias("n_words"), F.count("*").alias("n_distinct"))
    return totals.groupBy("__id", "__digest").agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, scratch: Scratch, least_words: int = 200) -> DataFrame:
    """doc_id, part, fails (bits in order of ``FILTERS``) and copies, the number of equal rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").alias("__id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("__digest"), text.alias("__text"))
    capitals = 100 * F.regexp_count("__text", F.lit("[A-Z]")) > 2 * F.char_length("__text")
    plain = _failing("C", capitals) + _failing("D", F.col("__text").rlike(r"[#$%&*|]"))
    rows = scratch.save(read.select("__id", "part", "__digest", plain.alias("fails")).groupBy("__id", "part", "__digest", "fails").agg(F.count("*").alias("copies")))
    # a total of m equal rows is m times that of one
    same = rows.groupBy("__id", "__digest").agg(F.sum("copies").alias("m"))
    counts = word_totals(read).withColumnsRenamed({"__id": "__i", "__digest": "__d"})
    counts = same.join(counts, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left")
    n, distinct = F.coalesce(F.col("n_words") / F.col("m"), F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    wordy = counts.select(F.col("__id").alias("__i"), F.col("__digest").alias("__d"), (_failing("A", n < least_words) + _failing("B", 100 * distinct < 50 * n)).alias("__wordy"))
    rows = rows.join(wordy, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")), "left").select(*rows.columns, "__wordy")
    return _with_first(scratch.save(rows), scratch).select(
        F.col("__id").alias("doc_id"), "part", (F.col("fails") + F.col("__wordy") + _failing("E", F.coalesce(F.col("__first") < F.col("__id"), F.lit(False)))).alias("fails"), "copies"
    )


def _with_first(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` with __first, the smallest id that has the row's text if several rows have it."""
    texts = rows.groupBy(F.col("__digest").alias("__d")).agg(F.min("__id").alias("__first"), F.count("*").alias("__held")).filter("__held > 1")
    texts = scratch.save(texts)
    many = rows.count() // HOT_SHARE + 1
    hot, rest = texts.filter(F.col("__held") > many), texts.filter(F.col("__held") <= many)
    same = F.col("__digest") == F.col("__d")
    marked = rows.join(F.broadcast(hot), same, "left").drop("__d").withColumnRenamed("__first", "__hot").drop("__held")
    # rows of hot texts have their answer: they stay out of the shuffle by text
    cold = marked.filter("__hot is null").join(rest, same, "left").select(*rows.columns, "__first")
    return cold.unionByName(marked.filter("__hot is not null").select(*rows.columns, F.col("__hot").alias("__first")))


def _with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with good and toxic, true where a label of the id says so."""
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__i")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    named = rows.filter("doc_id is not null").join(known, F.col("doc_id") == F.col("__i"), "left").drop("__i")
    named = named.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return named.unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def interactions(rows: DataFrame) -> DataFrame:
    """part, and arrays n, good and toxic of 32 counts: documents by the set of filters that they fail.  One row for each part."""
    held = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.sum(F.when(which & (F.col("fails") == mask), F.col("copies")).otherwise(F.lit(0))).alias(f"{name}{mask}") for name, which in held.items() for mask in range(32)]
    return rows.groupBy("part").agg(*counts).select("part", *[F.array(*[F.col(f"{name}{mask}") for mask in range(32)]).alias(name) for name in held])


def _total(counts: str, wanted) -> Column:
    """The sum of the counts of those masks for which ``wanted``."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(wanted(m), F.element_at(counts, m + 1)).otherwise(F.lit(0)))


def orders(found: DataFrame) -> DataFrame:
    """All orders and steps of the counts of ``interactions``: what each step keeps, removes and loses."""
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = found.withColumn("filter_order", F.explode(every)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, locate({}, '" + FILTERS + "') - 1)"
    own = F.expr(bit.format("substring(filter_order, step, 1)"))
    before = F.expr(f"aggregate(sequence(1, 5), 0, (acc, k) -> acc | if(k < step, {bit.format('substring(filter_order, k, 1)')}, 0))")
    steps = steps.withColumns({"own": own, "before": before})
    own, before = F.col("own"), F.col("before")
    meets = lambda m, mask: m.bitwiseAND(mask) != 0
    removed = lambda m: meets(m, own) & ~meets(m, before)
    # of a set of k filters each is the first one in 120 / k orders
    share = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.lit(0).cast("long"), lambda acc, m: acc + F.when(meets(m, own), F.element_at("n", m + 1) * (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(F.lit(0)))
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        _total("n", lambda m: ~meets(m, own.bitwiseOR(before))).alias("kept"),
        _total("n", removed).alias("removed"),
        _total("n", lambda m: meets(m, own) & meets(m, before)).alias("redundant"),
        _total("n", lambda m: m == own).alias("unique_fails"),
        _total("good", removed).alias("good_lost"),
        _total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, least_words: int = 200) -> DataFrame:
    """part, filter_order, step and the counts of that step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    scratch = Scratch(docs.sparkSession)
    return orders(scratch.save(interactions(_with_labels(failures(docs, scratch, least_words), labels))))
