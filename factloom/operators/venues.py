"""Venues as a dimension: names and aliases of conferences, and which of very many tokens a reported name holds.

Names are compared by their token, letters a-z and digits in lower case.  A token matches a name that holds it
anywhere, as providers write "Proceedings of ... (ICLR)".  All tokens are looked for in one pass
over a name, by an automaton that each task builds once from the broadcast tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from . import papers as P

#: Up to so many tokens a chain of comparisons is cheaper than a task's own process.
FEW_TOKENS = 16


def aliases(spark: SparkSession) -> DataFrame:
    """conference, name, token of every way in which a conference is written; place orders a conference's names."""
    rows = [(c, n, P._clean(n), k) for c, names in P.VENUES.items() for k, n in enumerate((c, *names))]
    return spark.createDataFrame(rows, "conference string, name string, token string, place int")


def found_tokens(names: Column, tokens: list[str]) -> Column:
    """Those of ``tokens`` that any name of an array holds, sorted; an empty array for null."""
    wanted = sorted({t for t in tokens if t})

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in wanted:
            automaton.add_word(t, t)
        if wanted:
            automaton.make_automaton()
        for batch in batches:
            yield batch.map(lambda x: sorted({t for _, t in automaton.iter(x)}) if x and wanted else [])

    # one string for all names, so that no token spans two of them
    joined = F.array_join(F.transform(names, text.norm_venue), "|")
    return run(F.coalesce(joined, F.lit("")))


def allowed(names: Column, tokens: list[str] | tuple[str, ...]) -> Column:
    """Whether any name of an array holds any token; nothing is allowed for null and empty arrays, everything without tokens."""
    wanted = [t for t in tokens if t]
    if not wanted:
        return F.lit(True)
    if len(wanted) > FEW_TOKENS:
        return F.size(found_tokens(names, wanted)) > 0
    tokened = F.transform(names, text.norm_venue)
    return F.coalesce(F.exists(tokened, lambda n: F.array_contains(F.array(*[F.contains(n, F.lit(t)) for t in wanted]), True)), F.lit(False))


def of_paper(venue: Column, venues: Column | None = None) -> Column:
    """The names that a paper reports: all of ``venues`` (structs with name), or, where it has none, ``venue``."""
    own = F.array(venue)
    return own if venues is None else F.when(F.size(F.coalesce(venues, F.array())) > 0, F.transform(venues, lambda v: v["name"])).otherwise(own)


def named(reported: DataFrame, dimension: DataFrame, name: str = "name") -> DataFrame:
    """``reported`` with the conference that its name is, where it is one; a broadcast of the dimension, which holds some dozens of rows."""
    known = F.broadcast(dimension.select(F.col("token").alias("__token"), "conference").distinct())
    return reported.join(known, text.norm_venue(F.col(name)) == F.col("__token")).drop("__token")


def resolved(wanted: DataFrame, dimension: DataFrame, key: str, name: str = "name") -> DataFrame:
    """key and token: what to filter by for each key's wanted names.

    A known name stands for all ways in which its conference is written, an unknown one for itself; a key
    all of whose names are unknown has no row, so nothing is filtered for it.
    """
    named_rows = wanted.select(key, text.norm_venue(F.col(name)).alias("__t")).filter("__t <> ''").distinct()
    tokens = F.broadcast(dimension.select(F.col("token").alias("__k"), "conference").distinct())
    marked = named_rows.join(tokens, F.col("__t") == F.col("__k"), "left")
    known = marked.filter("conference is not null").select(key, "conference").distinct()
    expanded = known.join(F.broadcast(dimension.select("conference", "token").distinct()), "conference").select(key, "token")
    unknown = marked.filter("conference is null").join(known.select(key).distinct(), key, "left_semi").select(key, F.col("__t").alias("token"))
    return expanded.unionByName(unknown).distinct()
