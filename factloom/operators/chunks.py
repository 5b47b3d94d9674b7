"""Chunking, evidence ranking, stratified samples and coverage packs of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import sections, text
from ..shipping import ship


def chunk_words(docs: DataFrame, size: int = 250, overlap: int = 30, least: int = 4, key: str = "paper_id") -> DataFrame:
    """Windows of ``size`` words, ``overlap`` shared; none after one that reaches the end, none under ``least`` words."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than the window")
    step = size - overlap
    split = docs.withColumn("__words", text.words(F.col("text"))).withColumn("__n", F.size("__words"))
    split = split.filter(F.col("__n") >= least).withColumn("__s", F.explode(F.sequence(F.lit(0), F.col("__n") - 1, F.lit(step))))
    kept = split.filter(((F.col("__s") == 0) | (F.col("__s") - step + size < F.col("__n"))) & (F.col("__n") - F.col("__s") >= least))
    number = (F.col("__s") / step).cast("long") + 1
    out = kept.withColumn("ord", number).withColumn("text", F.array_join(F.slice("__words", F.col("__s") + 1, F.lit(size)), " "))
    return out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("-p1-1-c"), number.cast("string"))).drop("__words", "__n", "__s")


def evidence_lexical(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k chunks with the most term occurrences, at most 3 for each term; ties by paper_id, chunk_id; zero scores stay."""
    low = F.lower("text")
    count = lambda t: F.least(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long"), F.lit(3))
    return chunks.withColumn("score", sum((count(t) for t in terms), F.lit(0)).cast("long")).orderBy(F.desc("score"), "paper_id", "chunk_id").limit(k)


def top_capped(scored: DataFrame, k: int, cap: int | None, per: str, tie: list[str]) -> DataFrame:
    """The k best by score, at most ``cap`` for each value of ``per``: the same rows that a greedy walk would take."""
    if cap is not None:
        scored = scored.withColumn("__place", F.row_number().over(W.partitionBy(per).orderBy(F.desc("score"), *tie))).filter(F.col("__place") <= cap).drop("__place")
    return scored.orderBy(F.desc("score"), *tie).limit(k)


def sample_top(scored: DataFrame, most: int) -> DataFrame:
    """Each paper's best chunks by score, ties by chunk_id."""
    return scored.withColumn("place", F.row_number().over(W.partitionBy("paper_id").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("place") <= most)


def sample_scoring(scored: DataFrame, most: int = 2) -> DataFrame:
    """The best ``method`` chunk, the best ``results`` chunk, then the next best, ``most`` in all for each paper."""
    best = W.partitionBy("paper_id", "category").orderBy(F.desc("score"), "chunk_id")
    slot = F.when((F.col("category") == "method") & (F.col("__c") == 1), 1).when((F.col("category") == "results") & (F.col("__c") == 1), 2).otherwise(3)
    marked = scored.withColumn("__c", F.row_number().over(best)).withColumn("__slot", slot)
    place = W.partitionBy("paper_id").orderBy("__slot", F.desc("score"), "chunk_id")
    return marked.withColumn("slot", F.row_number().over(place)).filter(F.col("slot") <= most).drop("__c", "__slot")


def sample_notes(scored: DataFrame, cap: int = 9) -> DataFrame:
    """One abstract (else one context) chunk, two of each evidence category, then ``other`` ones, ``cap`` in all."""
    per = W.partitionBy("paper_id")
    best = F.desc("score"), "chunk_id"
    front = F.when(F.col("is_abstract"), 0).when(F.col("category") == "context", 1).otherwise(2)
    marked = scored.withColumn("__front", front).withColumn("__first", (F.row_number().over(per.orderBy("__front", *best)) == 1) & (front < 2))
    marked = marked.withColumn("__c", F.row_number().over(W.partitionBy("paper_id", "category").orderBy(*best)))
    order = F.when(F.col("__first"), 0)
    for i, name in enumerate(["method", "evaluation_setup", "results", "limitations_future"]):
        order = order.when((F.col("category") == name) & (F.col("__c") <= 2), 1 + 2 * i + F.col("__c"))
    order = order.when(F.col("category") == "other", 20)
    kept = marked.withColumn("__order", order).filter("__order is not null")
    return kept.withColumn("slot", F.row_number().over(per.orderBy("__order", *best))).filter(F.col("slot") <= cap).drop("__front", "__first", "__c", "__order")


def region_priority(i: Column, refs: Column, app: Column, own: Column) -> Column:
    """A chunk's priority by where it stands to the first references and appendix chunks: its own before both."""
    appendix, references = F.lit(sections.APPENDIX_PRIORITY), F.lit(sections.REFERENCES_PRIORITY)
    region = F.when(refs.isNull(), F.when(app.isNull() | (i <= app), own).otherwise(appendix))
    region = region.when(app.isNull(), F.when(i < refs, own).otherwise(references))
    region = region.when(refs < app, F.when(i < refs, own).when(i < app, references).otherwise(appendix))
    return region.otherwise(F.when(i < app, own).when(i < refs, appendix).otherwise(references))


def coverage_pack(chunks: DataFrame, most: int = 6) -> DataFrame:
    """Up to ``most`` chunks of each paper: by section priority if any heading is known, else evenly before the references.

    Needs paper_id, chunk_id, section, text, page_start, page_end; adds idx, the place in the document.
    """
    per = W.partitionBy("paper_id")
    order = per.orderBy(F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0)), "chunk_id")
    kind = sections.chunk_class(F.col("section"), F.col("text"))
    out = chunks.withColumn("idx", F.row_number().over(order) - 1).withColumn("__p", kind["priority"])
    out = out.withColumn("__refs", F.min(F.when(sections.is_noise(F.col("section"), F.col("text")), F.col("idx"))).over(per))
    out = out.withColumn("__app", F.min(F.when(sections.is_appendix_boundary(F.col("section"), F.col("text")), F.col("idx"))).over(per))
    out = out.withColumn("__known", F.max((F.col("__p") != sections.OTHER_PRIORITY).cast("int")).over(per) == 1)
    i, refs, app = F.col("idx"), F.col("__refs"), F.col("__app")
    region = region_priority(i, refs, app, F.col("__p"))
    before = F.coalesce(i < refs, F.lit(True)) | ((refs == 0) & (i == 0))
    out = out.withColumn("priority", region).withColumn("__body", before.cast("int")).withColumn("__count", F.sum("__body").over(per))
    stride = F.greatest(F.lit(1), F.floor(F.col("__count") / most))
    by_priority = F.row_number().over(per.orderBy("priority", F.coalesce("page_start", F.lit(0)), "idx")) <= most
    even = (F.col("__body") == 1) & (i % stride == 0) & (F.floor(i / stride) < most)
    return out.withColumn("__in", F.when(F.col("__known"), by_priority).otherwise(even)).filter("__in").drop("__p", "__refs", "__app", "__known", "__body", "__count", "__in")


def strided(rows: DataFrame, per: str, order: list[str], slots: int) -> DataFrame:
    """The first ``slots`` of every max(1, count // slots)-th row."""
    place, count = F.row_number().over(W.partitionBy(per).orderBy(*order)) - 1, F.count("*").over(W.partitionBy(per))
    marked = rows.withColumn("__i", place).withColumn("__stride", F.greatest(F.lit(1), F.floor(count / slots)))
    return marked.filter((F.col("__i") % F.col("__stride") == 0) & (F.floor(F.col("__i") / F.col("__stride")) < slots)).drop("__i", "__stride")


def batch_fixed(rows: DataFrame, per: list[str], order: list[str], size: int = 4) -> DataFrame:
    """batch and idx, from 0, of fixed batches in order."""
    place = F.row_number().over(W.partitionBy(*per).orderBy(*order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long")).withColumn("idx", (place % size).cast("long"))


def section_paths(markdown: list[str], least_chars: int = 20, most_words: int = 250, most_paragraphs: int | None = None) -> list[tuple[str, str]]:
    """(path, text) of a document's packed paragraphs, from its lines."""
    stack: list[tuple[int, str]] = []
    groups: list[tuple[str, list[str]]] = [("", [])]
    for line in markdown:
        marks = len(line) - len(line.lstrip("#"))
        if 1 <= marks <= 3 and line[marks : marks + 1] == " ":
            while stack and stack[-1][0] >= marks:
                stack.pop()
            stack.append((marks, line[marks:].strip()))
            groups.append((" > ".join(h for _, h in stack), []))
        else:
            groups[-1][1].append(line)
    out = []
    for path, lines in groups:
        for part in pack("\n".join(lines), most_words, most_paragraphs=most_paragraphs):
            if len(part.strip()) >= least_chars:
                out.append((path, part))
    return out


#: Where a text that lost its blank lines breaks: two spaces at a line's end.
_BREAK = re.compile(r"[ \t]{2,}\n|\n\n")


def is_table_block(paragraph: str) -> bool:
    lines = [x.strip() for x in paragraph.split("\n") if x.strip()]
    return len(lines) > 1 and all(x.startswith("|") for x in lines)


def slide_split(words: list[str], most: int, overlap: int, least: int = 4) -> list[str]:
    """Windows of ``most`` words, ``overlap`` shared, none after one that reaches the end; a rest under ``least`` only as the first."""
    starts = [s for s in range(0, len(words), most - overlap) if s == 0 or s - (most - overlap) + most < len(words)]
    return [" ".join(words[s : s + most]) for s in starts if s == 0 or len(words) - s >= least]


def pack(body: str, most: int, overlap: int = 30, least: int = 4, most_paragraphs: int | None = None) -> list[str]:
    """Paragraphs together up to ``most`` words: those under ``least`` go with what is held, tables stay whole, longer ones are cut in windows.

    With ``most_paragraphs`` a part also ends when it holds so many and one of ``least`` words or more follows.
    """
    if not 0 <= overlap < most:
        raise ValueError("overlap must be smaller than the window")
    parts: list[str] = []
    held: list[str] = []
    size = 0
    for paragraph in filter(None, map(str.strip, _BREAK.split(body))):
        words = paragraph.split()
        table = paragraph.startswith("|") and is_table_block(paragraph)
        full = size + len(words) > most or (most_paragraphs is not None and len(held) >= most_paragraphs)
        if len(words) >= least and held and full:
            parts.append("\n\n".join(held))
            held, size = [], 0
        if len(words) > most and not table:
            parts += slide_split(words, most, overlap)
        else:
            held.append(paragraph)
            size += len(words)
    return [*parts, "\n\n".join(held)] if held else parts


_TABLE = "| 1 | 2 |\n| 3 | 4 |"
#: Bodies and how they are packed in parts of 8 words, 2 shared, worked out by hand; `` ## `` between parts.
PACK_CASES = [
    ("a b c d\n\ne f g h", "a b c d\n\ne f g h"),
    ("a b c d e\n\nf g h i", "a b c d e ## f g h i"),
    ("x\n\na b c d", "x\n\na b c d"),
    ("a b c d e f g h\n\nx y", "a b c d e f g h\n\nx y"),
    ("a b c d e f g h i j k l", "a b c d e f g h ## g h i j k l"),
    ("a b c d e f g h i", "a b c d e f g h"),
    (f"a b c d e f\n\n{_TABLE}\n\ng h i j", f"a b c d e f ## {_TABLE} ## g h i j"),
    ("a b c d  \ne f g h i", "a b c d ## e f g h i"),
    ("a b\n\nc d e f g h i j k l", "a b ## c d e f g h i j ## i j k l"),
    ("", ""),
]


def slid_column(body: Column) -> Column:
    """Windows of 8 words, 2 shared, with `` | `` between them."""
    return F.pandas_udf(lambda bodies: bodies.map(lambda x: " | ".join(slide_split(x.split(), 8, 2))), T.StringType())(body)


def packed_column(body: Column) -> Column:
    return F.pandas_udf(lambda bodies: bodies.map(lambda x: " ## ".join(pack(x or "", 8, 2))), T.StringType())(body)


def chunk_sections(docs: DataFrame, most_words: int = 250, key: str = "paper_id", most_paragraphs: int | None = None) -> DataFrame:
    """key, chunk_id, ord, section, text of Markdown documents; short groups don't use up a number."""
    ship(docs.sparkSession)
    source = docs.select(key, "text")
    schema = f"{key} {source.schema[key].dataType.simpleString()}, chunk_id string, ord long, section string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(k, f"{k}-c{n}", n, path or None, body) for k, t in zip(part[key], part["text"], strict=True) for n, (path, body) in enumerate(section_paths((t or "").split("\n"), most_words=most_words, most_paragraphs=most_paragraphs), 1)]
            yield pd.DataFrame(rows, columns=[key, "chunk_id", "ord", "section", "text"])

    return source.mapInPandas(run, schema)


def prepared(chunks: DataFrame, least_words: int = 4, title: Column | None = None) -> DataFrame:
    """Chunks that are worth reading: no references or acknowledgments, appendix chunks only of an evidence category, four words or more."""
    section, body = F.col("section"), F.col("text")
    return chunks.filter(~sections.is_noise(section, body) & sections.appendix_kept(section, body, title) & (text.word_count(body) >= least_words))


def aspect(title: Column | None = None) -> Column:
    """The group of a chunk: its top section, numbered ones by number, ``other`` without any."""
    return sections.merge_numbered(F.coalesce(sections.top_section(F.col("section"), title), F.lit("other")))


def grouped_by_section(chunks: DataFrame, title: Column | None = None) -> DataFrame:
    """aspect and grp, the number of the group, from 1, by where it first stands in the paper."""
    out = chunks.withColumn("aspect", aspect(title))
    out = out.withColumn("__first", F.min("ord").over(W.partitionBy("paper_id", "aspect")))
    return out.withColumn("grp", F.dense_rank().over(W.partitionBy("paper_id").orderBy("__first"))).drop("__first")


def bounded_places(aspects: list[str], cap: int) -> list[int]:
    """Places of up to ``cap`` chunks of a paper: the first of each aspect, then in turns one more of each, spread over what is left of it."""
    if len(aspects) <= cap:
        return list(range(len(aspects)))
    left: dict[str, list[int]] = {}
    for i, name in enumerate(aspects):
        left.setdefault(name, []).append(i)
    chosen, taken = [g.pop(0) for g in left.values()][:cap], dict.fromkeys(left, 0)
    while len(chosen) < cap:
        for name, rest in left.items():
            if rest and len(chosen) < cap:
                stride = max(1, len(rest) // (taken[name] + 1))
                spread = range(0, len(rest), stride)[: taken[name] + 1]
                chosen.append(rest.pop(spread[-1]))
                taken[name] += 1
    return sorted(chosen)


def _folded(marked: DataFrame, fold: Callable[[list[tuple]], Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """Rows that ``fold`` makes of each paper's rows in order of ord; ``marked`` begins with paper_id.

    Papers go by in sorted partitions and are held one at a time, with no frame for each of them.
    """
    ship(marked.sparkSession)
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = chain.from_iterable(fold(list(paper)) for _, paper in groupby(rows, key=itemgetter(0)))
        while part := list(islice(made, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], schema=kinds)

    return marked.repartition("paper_id").sortWithinPartitions("paper_id", "ord").mapInArrow(run, schema)


def bounded(chunks: DataFrame, cap: int, title: Column | None = None) -> DataFrame:
    """Up to ``cap`` chunks of each paper by :func:`bounded_places`; a paper's chunks are folded in one task."""
    marked = chunks.select("paper_id", "chunk_id", "ord", aspect(title).alias("aspect"))
    return _folded(marked, lambda paper: (paper[i] for i in bounded_places([row[3] for row in paper], cap)), marked.schema)


def halved(body: str, budget: int, least: int = 20) -> list[str]:
    """A text cut in halves, and these again, until each takes up to ``budget`` estimated tokens."""
    out, todo = [], [body]
    while todo:
        piece = todo.pop()
        if (len(piece) + 3) // 4 <= budget:
            out.append(piece)
            continue
        middle = len(piece) // 2
        if middle < least:
            raise ValueError(f"a budget of {budget} tokens is too small")
        todo += [piece[middle:], piece[:middle]]
    return out


def note_batches(aspects: list[str], texts: list[str], budget: int) -> list[tuple[int, int, str]]:
    """(batch, place of the chunk, piece of text): by aspect in order of appearance, pieces in order, up to ``budget`` tokens in a batch."""
    out: list[tuple[int, int, str]] = []
    number = -1
    for name in dict.fromkeys(aspects):
        number, used = number + 1, 0
        for i, body in enumerate(texts):
            for piece in halved(body, budget) if aspects[i] == name else ():
                if used and (used + len(piece) + 3) // 4 > budget:
                    number, used = number + 1, 0
                out.append((number, i, piece))
                used += len(piece)
    return out


def batch_notes(chunks: DataFrame, budget: int = 2500, title: Column | None = None) -> DataFrame:
    """paper_id, batch, chunk_id, piece: a paper's chunks by section in batches under a token budget; a paper is folded in one task."""
    marked = chunks.select("paper_id", "chunk_id", "ord", "text", aspect(title).alias("aspect"))
    schema = T.StructType([marked.schema["paper_id"], T.StructField("batch", T.LongType()), marked.schema["chunk_id"], T.StructField("piece", T.StringType())])

    def fold(paper: list[tuple]) -> Iterator[tuple]:
        return ((paper[i][0], b, paper[i][1], piece) for b, i, piece in note_batches([row[4] for row in paper], [row[3] for row in paper], budget))

    return _folded(marked, fold, schema)
