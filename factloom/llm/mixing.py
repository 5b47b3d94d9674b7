"""Mixing sources to target weights: capped water-filling and seeded repetitions.

The mix holds ``share`` times all words.  Each source gets words in proportion to its
weight, up to ``most_epochs`` times its own size; what is above is reshared by weight among
the others until none is above.  A source's documents are then taken whole
``floor(target / size)`` times, and some of them once more: those of smallest seeded hash as
far as the target goes, changed by the best of all subsets of up to ``SWAPS`` documents of
different sizes that come in or go out.

Everything is DataFrame code.  Per source, the hash cut is found from sums by the first 8
bits of the hash, then by 16, then among the rows of one such bucket, so no task gathers a
source.

Defined results: a null text counts 0 words and is taken 0 times; a null source is a source
of its own, last in order; rows that repeat a doc_id are drawn together but for the cut and
the swaps, which take them one by one; a very long text is one document, taken whole or not at
all; an empty table gives no rows; other columns are ignored by :func:`mix` and kept by :func:`sampled`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SWAPS = 14  # documents of a source whose subsets are tried


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def plan(sizes: DataFrame, weights: DataFrame, share: float = 1.0, most_epochs: int = 3) -> DataFrame:
    """source, source_size, target by capped water-filling; ``weights`` has source and weight, ``sizes`` source and size.

    The level at which the fill ends: with sources in order of cap/weight, the first k are
    at their caps for the smallest k that leaves all others below theirs.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.join(weights.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    cap = F.col("source_size") * F.lit(most_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    filled = per.withColumn("cap", cap).withColumn("level", level).withColumn("place", F.row_number().over(order))
    # sources before the first that is below its cap stand at theirs; that one's level holds for the rest
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("place"))).over(everything)
    filled = filled.withColumn("first", first).withColumn("final", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything))
    below = F.col("first").isNotNull() & (F.col("place") >= F.col("first"))
    target = F.when(below, F.least(F.col("final") * F.col("weight"), F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return filled.select("source", "source_size", target.alias("target"))


def cyclic_weights(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Each source's weight: ``weights`` over and over, by order of name, null last.  One row for each source."""
    at = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % F.lit(len(weights))
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int"))
    return sizes.select("source").distinct().select("source", pick.alias("weight"))


def _with(rows: DataFrame, of_source: DataFrame) -> DataFrame:
    """Columns of each row's source, null being a source too."""
    return rows.join(of_source.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")


def _cut(rows: DataFrame, targets: DataFrame, bucket: Column, name: str) -> DataFrame:
    """``targets`` with the bucket of hashes in which a source's running words pass its part, and the words ``before`` it."""
    sums = rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    running = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    passed = _with(sums, targets).withColumn("upto", F.col("before") + F.sum("words").over(running)).filter("upto > part")
    found = passed.groupBy("source").agg(F.min("bucket").alias(name), F.min(F.col("upto") - F.col("words")).alias("before"))
    return _with(targets.drop("before"), found)


def mix(docs: DataFrame, weights: DataFrame | None = None, share: float = 1.0, most_epochs: int = 3, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every row."""
    scratch = Scratch(docs.sparkSession)
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw.alias("draw")))
    targets = plan(sized, cyclic_weights(sized) if weights is None else weights, share, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("part", (F.col("target") - F.col("whole") * F.col("source_size")).cast("double")).withColumn("before", F.lit(0).cast("long"))
    # the hash bucket of each source's cut, by two digits and then by four
    coarse = scratch.save(_cut(sized, scratch.save(targets), F.substring("draw", 1, 2), "cut2"))
    inside = _with(sized, coarse.select("source", "cut2")).filter(F.substring("draw", 1, 2) == F.col("cut2")).select(*sized.columns)
    cut = scratch.save(_cut(inside, coarse, F.substring("draw", 1, 4), "cut"))
    rows = _with(sized, cut).withColumn("bucket", F.substring("draw", 1, 4))
    so_far = W.partitionBy("source").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, 0)
    edge = rows.filter("bucket = cut").withColumn("extra", F.col("before") + F.sum("size").over(so_far) <= F.col("part"))
    rest = rows.filter("cut is null or bucket <> cut").withColumn("extra", F.col("cut").isNull() & (F.col("part") > 0) | F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)))
    drawn = scratch.save(rest.unionByName(edge))
    swapped = _with_swaps(drawn, scratch)
    times = F.when(F.col("size") > 0, F.col("whole") + (F.col("extra") != F.col("swapped")).cast("long")).otherwise(F.lit(0)).cast("long")
    return swapped.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def _with_swaps(drawn: DataFrame, scratch: Scratch) -> DataFrame:
    """``drawn`` with ``swapped``: which rows change sides so that their source comes nearest to its part.

    Of each source ``SWAPS`` rows may: one of each size class (power of two) inside and
    outside the mix, then a second one of each, and so on, those of twice the gap or more
    last.  All their 2 ** SWAPS sums are tried.
    """
    gap = drawn.groupBy("source").agg(F.floor(F.first("part") + 0.5 - F.coalesce(F.sum(F.when(F.col("extra"), F.col("size"))), F.lit(0))).cast("long").alias("gap"))
    gap = scratch.save(gap.filter("gap <> 0"))
    cls = F.floor(F.log2("size")).cast("int")
    # a filter on row_number is done in each task first, so a large source isn't gathered
    ranked = drawn.filter("size > 0").select("source", "size", "draw", "extra", cls.alias("class"))
    ranked = ranked.withColumn("nth", F.row_number().over(W.partitionBy("source", "extra", "class").orderBy("draw", "size"))).filter(F.col("nth") <= SWAPS)
    ranked = ranked.join(gap.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    turn = W.partitionBy("source").orderBy(F.col("size") >= 2 * F.col("gap"), "nth", "extra", "class")
    tried = ranked.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= SWAPS)
    tried = tried.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("extra"), -F.col("size")).otherwise(F.col("size")).alias("adds"), "draw", "size", "extra"))).alias("tried"))
    sums = F.aggregate("tried", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.transform(acc, lambda y: y + x["adds"])))
    away = F.transform(sums, lambda x: F.abs(F.col("gap") - x))
    best = tried.withColumn("away", away).withColumn("best", F.array_position("away", F.array_min("away")) - 1)
    swaps = best.select("source", "best", F.explode("tried").alias("x")).filter("shiftright(best, x.turn - 1) & 1 = 1")
    swaps = swaps.groupBy(F.col("source").alias("__s"), F.col("x.draw").alias("__d"), F.col("x.size").alias("__z"), F.col("x.extra").alias("__e")).agg(F.count("*").alias("copies"))
    # rows that repeat one id and size are told apart by number
    marked = drawn.join(scratch.save(swaps), F.col("source").eqNullSafe(F.col("__s")) & (F.col("draw") == F.col("__d")) & (F.col("size") == F.col("__z")) & (F.col("extra") == F.col("__e")), "left")
    same = W.partitionBy("source", "draw", "size", "extra").orderBy(F.lit(0))
    named = marked.filter("copies is not null").withColumn("swapped", F.row_number().over(same) <= F.col("copies"))
    columns = [*drawn.columns, "swapped"]
    return marked.filter("copies is null").withColumn("swapped", F.lit(False)).select(*columns).unionByName(named.select(*columns))


def sampled(docs: DataFrame, epoch: str = "epoch", **options) -> DataFrame:
    """All columns of the rows that the mix takes, and ``epoch``, 1 to the number of times: one row for each time.

    Rows that repeat a doc_id are taken as often as the one taken most.  An ``epoch`` column
    of the input is an error; name another then.
    """
    if epoch in docs.columns:
        raise ValueError(f"the input has a column {epoch} already")
    taken = mix(docs, **options).filter("times > 0").groupBy(F.col("doc_id").alias("__mix_id")).agg(F.max("times").alias("__mix_times"))
    kept = docs.join(taken, docs["doc_id"].eqNullSafe(F.col("__mix_id")))
    return kept.withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col("__mix_times").cast("int")))).select(*docs.columns, epoch)
