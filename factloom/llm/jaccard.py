"""Exact Jaccard join of word shingle sets with prefix trees.

Two documents link when 4 |A & B| >= 3 |A | B| over their sets of distinct 5-word shingles.
The result is each document's component: the smallest doc_id that links reach.

1. One pass counts shingles in a sketch of fixed size, which gives a global order, rare ones
   first.  Any fixed order gives the same result; this one keeps frequent shingles out.
2. One pass turns each text into a fingerprint (equal sets are one node from here on), a
   parity bitmap of 2,048 bits, and the first n - ceil(3n/4) + l shingles in that order, with
   l = 1 + n // 20: sets that link share at least the smaller one's l of these.  A node that
   shares fewer of them with all others together than any partner of its would need is out.
3. Nodes that share such a shingle, equal sets of nodes once, are compared by bitmap, those of a
   very common shingle block by block: the bits in which two bitmaps
   differ are at most the elements in which the sets do, and linked sets differ in at most
   (|A| + |B|) / 7.  What passes is kept as a spanning forest, never as all pairs, and the
   forest's components hold every link.  Large components are compared once more, sets of over
   1,500 shingles by bitmaps of 32,768 bits.
4. Each component's sets, by falling frequency in the component, go into a prefix tree.  A
   set walks it carrying the overlap of the path so far, leaves a subtree when what is left
   can't reach the least overlap, and when all below is in its own component already.
   Components of more than ``BLOCK`` sets or ``BLOCK_SHINGLES`` shingles are dealt out by pairs
   of blocks; where bitmaps are compared, blocks have ``BITMAP_BLOCK`` sets of any size.
5. Components of the verified links are the answer.

Fingerprints and shingles are 64-bit hashes; a wrong link by collision has a chance of about
n^2 / 2^65 for n distinct sets.

Defined results: a text of 1 to 4 words is one shingle; null, empty and blank texts have no
shingle and stand alone; a row without doc_id has no component (null) and links with
nothing; rows that repeat a doc_id are one node of the links; an empty table gives no rows;
other columns are ignored by :func:`components` and kept by :func:`deduplicate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from . import common
from .wordhash import mix64, ngram_hashes, shingle_set, text_buffers, word_chunks

BITS = 2048
WIDE_BITS, LONG = 1 << 15, 1500  # sets of over LONG shingles have a second bitmap
BLOCK = 2000  # sets of a component that are compared at once
BLOCK_SHINGLES = 1_000_000
BITMAP_BLOCK = 4000  # the same where only bitmaps are compared, whatever the sets' sizes
ROWS = 1 << 18  # rows of shared shingles that a task looks at together
SKETCH = 1 << 20
TOKEN_BLOCK = 2000  # nodes of a shingle that one task compares
NO_LABEL = -(1 << 63)
_PART = 1 << 12
_TOP = np.uint64(44)  # the sketch's place is the hash's first 20 bits


def linked(size_a: int, size_b: int, overlap: int) -> bool:
    return 7 * overlap >= 3 * (size_a + size_b) > 0


def sketch(docs: DataFrame, words: int = 5) -> np.ndarray:
    """Counts of shingles by the first 20 bits of their hash: SKETCH numbers, whatever the input's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(SKETCH, dtype=np.int64)
        for batch in batches:
            for c in word_chunks(*text_buffers(batch.column(0))):
                grams = ngram_hashes(c.hashes, words)
                if len(grams):
                    whole = np.ones(len(grams), dtype=bool)
                    for k in range(1, words):  # not across documents
                        inner = c.bounds[1:-1] - k
                        whole[inner[(inner >= 0) & (inner < len(grams))]] = False
                    sums += np.bincount((grams[whole] >> _TOP).astype(np.int64), minlength=SKETCH)
        parts = sums.reshape(-1, _PART)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "counts": pa.array([np.minimum(parts[i], 2**31 - 1).astype(np.int32).tobytes() for i in some], pa.binary())})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.minimum(sum(np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in frame["counts"]), 2**31 - 1)
        return pd.DataFrame({"part": [frame["part"].iloc[0]], "counts": [total.astype(np.int32).tobytes()]})

    out = np.zeros((SKETCH // _PART, _PART), dtype=np.int32)
    for r in common.arrow_map(docs.select("text"), count, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.reshape(-1)


def least_shared(n: int) -> int:
    """How many shingles of their prefixes two linked sets share, if the smaller one has n."""
    return 1 + n // 20


def prefix_length(n: int) -> int:
    return min(n, n - (3 * n + 3) // 4 + least_shared(n)) if n else 0


def fingerprint(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    total = np.add.reduce(mix64(shingles + np.uint64(0x632BE59BD9B4E019)), dtype=np.uint64)
    return int(mix64(np.array([total ^ np.uint64(len(shingles) * 0x9E3779B1)], dtype=np.uint64)).view(np.int64)[0])


def bitmap(shingles: np.ndarray, bits: int = BITS) -> bytes:
    """Parities of the numbers of elements that fall on each of ``bits`` bits."""
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def features(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, n, node, bits, wide, prefix; in each task only the first row of a node has bitmaps and prefix."""
    held = docs.sparkSession.sparkContext.broadcast(sketch(docs, words))
    source = docs.select("doc_id", F.col("text").alias("__text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, node long, bits binary, wide binary, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = held.value, set()
        for batch in batches:
            sizes, nodes, bits, wide, prefixes, lengths = [], [], [], [], [], [0]
            for c in word_chunks(*text_buffers(batch.column(1))):
                for i in range(len(c.bounds) - 1):
                    grams = shingle_set(c.hashes[c.bounds[i] : c.bounds[i + 1]], words)
                    n, first = len(grams), None
                    sizes.append(n)
                    nodes.append(fingerprint(grams) if n else None)
                    if n and nodes[-1] not in seen:
                        seen.add(nodes[-1])
                        order = np.argsort(counts[(grams >> _TOP).astype(np.int64)], kind="stable")
                        first = grams[order[: prefix_length(n)]]
                        prefixes.append(first)
                    bits.append(None if first is None else bitmap(grams))
                    wide.append(None if first is None or n <= LONG else bitmap(grams, WIDE_BITS))
                    lengths.append(lengths[-1] + (0 if first is None else len(first)))
            flat = np.concatenate(prefixes).view(np.int64) if prefixes else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), lists], names=["doc_id", "n", "node", "bits", "wide", "prefix"])

    return common.arrow_map(source, run, schema)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, node), the sets of two or more nodes that share a token: (token, node, times).

    Sets that are equal have one name, which stands in for their tokens, and ``times`` is how
    many of these there are: copies of a long text share hundreds of tokens, all with one set.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for batch in batches:
        parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= ROWS:
            tokens, nodes = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = int(np.searchsorted(tokens, tokens[-1]))  # the last token may go on
            if cut:
                yield _named_sets(tokens[:cut], nodes[:cut])
            parts, held = [(tokens[cut:], nodes[cut:])], 0
    if parts:
        yield _named_sets(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _named_sets(tokens: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
    """The sets of a run of whole tokens, each once."""
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (nodes[1:] != nodes[:-1])
    tokens, nodes = tokens[fresh], nodes[fresh]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, dtype=np.int64)
    lengths = np.diff(np.append(starts, len(tokens)))
    sums = np.add.reduceat(mix64(nodes.view(np.uint64) + np.uint64(0x632BE59BD9B4E019)), starts) if len(starts) else np.zeros(0, dtype=np.uint64)
    several = lengths > 1
    names = mix64(sums[several] ^ lengths[several].astype(np.uint64)).view(np.int64)
    names, first, times = np.unique(names, return_index=True, return_counts=True)
    starts, lengths = starts[several][first], lengths[several][first]
    rows = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    columns = (np.repeat(names, lengths), nodes[rows], np.repeat(times, lengths))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["token", "node", "times"])


class Forest:
    """Union-find over 64-bit names; ``edges`` are those that joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def known(self, x: int, label: int) -> None:
        """``x`` is in the tree of ``label``, by edges that were found before."""
        a, b = self.root(x), self.root(label)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join(self, a: int, b: int) -> None:
        a_root, b_root = self.root(a), self.root(b)
        if a_root != b_root:
            self.up[max(a_root, b_root)] = min(a_root, b_root)
            self.edges.append((a, b))


def _near(sizes: np.ndarray, bits: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of ``others`` that may link with ``i`` by size and bitmap."""
    differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1)
    small, large = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    return others[(7 * differ.astype(np.int64) <= sizes[others] + sizes[i]) & (4 * small >= 3 * large)]


def _compared(rows: DataFrame) -> DataFrame:
    """Edges between nodes of a token that may link, of rows (token, node, n, bits, label)."""
    return rows.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(_candidates, "a long, b long")


def _near_nodes(shared: DataFrame, bits: DataFrame, scratch: common.Scratch) -> DataFrame:
    """Edges that join all nodes which share a token and may link, of rows (token, node).

    The nodes of a token are compared in one task up to ``TOKEN_BLOCK`` of them.  More are dealt
    into blocks: first every block meets the first one, and what that joins gets a label.  Then
    those that are not of the token's most frequent label meet each other and those that are,
    block by block; nodes of one label are never compared again.
    """
    none = F.lit(None).cast("long")
    rows = shared.join(bits.select("node"), "node", "left_semi")
    hot = scratch.save(rows.groupBy("token").agg(F.count("*").alias("c")).filter(F.col("c") > TOKEN_BLOCK).select("token", F.ceil(F.col("c") / TOKEN_BLOCK).cast("int").alias("blocks")))
    with_bits = lambda x: x.join(bits, "node").select("token", "node", "n", "bits", "label")
    if not hot.limit(1).count():
        return scratch.save(_compared(with_bits(rows.withColumn("label", none))))
    group = lambda *parts: F.xxhash64("token", *parts).alias("token")
    cold = rows.join(hot, "token", "left_anti").select("token", "node", none.alias("label"))
    dealt = scratch.save(rows.join(hot, "token").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    met = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    leading = dealt.withColumn("with", F.explode(met)).select(group(F.lit("first"), "with"), "node", none.alias("label"))
    first = scratch.save(_compared(with_bits(cold.unionByName(leading))))
    labels = common.connected_components(first, scratch)
    named = scratch.save(dealt.join(labels, "node", "left").select("token", "node", "block", "blocks", F.coalesce("component", "node").alias("label")))
    counts = named.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = counts.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    others = main.filter(F.col("all") > F.col("most")).select("token", "main", F.ceil((F.col("all") - F.col("most")) / TOKEN_BLOCK).cast("int").alias("parts"))
    split = named.join(others, "token").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "node"), F.col("parts")).cast("int"))
    split = scratch.save(split.withColumn("is_main", F.col("label") == F.col("main")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = split.filter("not is_main")
    among = rest.withColumn("with", every("parts")).select(group(F.lit("rest"), F.least("part", "with"), F.greatest("part", "with")), "node", "label")
    against = rest.withColumn("with", every("blocks")).select(group(F.lit("main"), "part", "with"), "node", "label")
    mains = split.filter("is_main").withColumn("with", every("parts")).select(group(F.lit("main"), "with", "block"), "node", "label")
    second = scratch.save(_compared(with_bits(among.unionByName(against).unionByName(mains))))
    return first.unionByName(second)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the pairs of a token's nodes that may link; rows come sorted by token.  Nodes of one label count as joined."""
    forest, done = Forest(), set()
    for tokens, nodes, sizes, bits, labels in _whole_groups(batches):
        for x, label in set(zip(nodes[labels != NO_LABEL].tolist(), labels[labels != NO_LABEL].tolist(), strict=True)):
            forest.known(x, label)
        starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        lengths = np.diff(np.append(starts, len(tokens)))
        two = starts[lengths == 2]
        differ = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1).astype(np.int64)
        small, large = np.minimum(sizes[two], sizes[two + 1]), np.maximum(sizes[two], sizes[two + 1])
        two = two[(7 * differ <= small + large) & (4 * small >= 3 * large)]
        for x, y in np.unique(np.column_stack([nodes[two], nodes[two + 1]]), axis=0).tolist():
            forest.join(x, y)
        for lo, n in zip(starts[lengths > 2], lengths[lengths > 2], strict=True):
            name = hash(nodes[lo : lo + n].tobytes())  # a cluster comes once for each shingle that it shares
            if name not in done:
                done.add(name)
                _group(forest, nodes[lo : lo + n], sizes[lo : lo + n], bits[lo : lo + n])
        yield _edges(forest)


def _group(forest: Forest, nodes: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> None:
    roots = np.array([forest.root(x) for x in nodes.tolist()])
    for i in range(len(nodes) - 1):
        others = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
        near = _near(sizes, bits, i, others) if len(others) else others
        if len(near):
            for j in near.tolist():
                forest.join(int(nodes[i]), int(nodes[j]))
            roots[np.isin(roots, np.append(roots[near], roots[i]))] = forest.root(int(nodes[i]))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(tokens, nodes, sizes, bitmaps, labels) of sorted rows, never cut within a token."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
        label = batch.column("label").fill_null(NO_LABEL).to_numpy()
        part = [batch.column(c).to_numpy() for c in ("token", "node", "n")] + [bits, label]
        cut = int(np.searchsorted(part[0], part[0][-1]))  # the last token may go on
        if held and held[0][0][0] != part[0][0]:  # the token that was held has ended
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        if cut:
            held.append([x[:cut] for x in part])
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
        held.append([x[cut:] for x in part])
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _edges(forest: Forest) -> pa.RecordBatch:
    a, b = zip(*forest.edges, strict=True) if forest.edges else ((), ())
    forest.edges = []
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class PrefixTree:
    """Sets as paths of ranks, most common first, with equal beginnings stored once."""

    class Node:
        __slots__ = ("children", "hi", "least", "lo", "rest", "tokens")

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray) -> None:
        """``paths`` sorted as lists; sizes are those of the whole sets, of which a path may leave out what no other set has."""
        self.paths, self.sizes = paths, sizes
        self.root = self._build(0, len(paths), 0)

    def _build(self, lo: int, hi: int, depth: int) -> PrefixTree.Node:
        node = PrefixTree.Node()
        a, b = self.paths[lo], self.paths[hi - 1]
        k = min(len(a), len(b))
        differ = np.flatnonzero(a[depth:k] != b[depth:k])  # sorted: what first and last share, all do
        end = depth + int(differ[0]) if len(differ) else k
        node.tokens, node.lo, node.hi, node.children = a[depth:end], lo, hi, []
        node.least = int(self.sizes[lo:hi].min())
        node.rest = max(len(p) for p in self.paths[lo:hi]) - end
        i = lo
        while i < hi and len(self.paths[i]) == end:
            i += 1
        while i < hi:
            j, head = i + 1, self.paths[i][end]
            while j < hi and self.paths[j][end] == head:
                j += 1
            node.children.append(self._build(i, j, end))
            i = j
        return node

    def search(self, path: np.ndarray, size: int, marks: np.ndarray, skip: np.ndarray, found: list[int]) -> None:
        """Appends the places of sets that link with the one of this path; ``marks`` flags its ranks, ``skip`` places not asked for."""
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if skip[node.lo : node.hi].all():
                continue
            overlap += int(marks[node.tokens].sum())
            rest = min(node.rest, len(path) - overlap)
            if 7 * (overlap + rest) < 3 * (size + node.least):
                continue
            for i in range(node.lo, node.children[0].lo if node.children else node.hi):  # sets that end here
                if not skip[i] and linked(size, int(self.sizes[i]), overlap):
                    found.append(i)
            for child in node.children:
                stack.append((child, overlap))


def join_sets(sets: list[np.ndarray], sides: np.ndarray | None = None) -> np.ndarray:
    """Labels, equal for sets that links join; with ``sides`` (0 and 1) only links between the sides count."""
    labels = np.arange(len(sets))
    if len(sets) < 2:
        return labels
    tokens, index, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), dtype=np.int64)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    common_ones = int((counts > 1).sum())  # what one set alone has only adds to its size
    ends = np.cumsum([len(s) for s in sets])
    paths = [np.sort(r[r < common_ones]) for r in np.split(rank[index], ends[:-1])]
    order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">i8").tobytes())
    paths, sizes = [paths[i] for i in order], np.array([len(sets[i]) for i in order])
    side = None if sides is None else sides[order]
    tree, marks = PrefixTree(paths, sizes), np.zeros(common_ones, dtype=bool)
    names = np.arange(len(sets))  # label of each place
    for i, path in enumerate(paths):
        if side is not None and side[i]:
            continue
        skip = names == names[i]
        if side is None:
            skip[:i] = True
        else:
            skip |= side == 0
        if skip.all():
            continue
        marks[path] = True
        found: list[int] = []
        tree.search(path, int(sizes[i]), marks, skip, found)
        marks[path] = False
        for j in found:
            if names[j] != names[i]:
                names[names == names[j]] = names[i]
    labels[order] = names
    return labels


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _candidates, for the blocks of large components, long sets by their wide bitmaps."""
    forest = Forest()
    for group in common.sorted_groups(batches, ("component", "i", "j")):
        nodes, sizes, blocks = (group.column(c).to_numpy() for c in ("node", "n", "block"))
        first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), dtype=np.uint64).reshape(len(nodes), -1)
        raw = group.column("wide").to_pylist()
        long = np.array([w is not None for w in raw])
        wide = np.zeros((len(nodes), WIDE_BITS // 64), dtype=np.uint64)
        if long.any():
            wide[long] = np.frombuffer(b"".join(w for w in raw if w is not None), dtype=np.uint64).reshape(int(long.sum()), -1)
        roots = np.array([forest.root(x) for x in nodes.tolist()])
        for i in range(len(nodes) - 1):
            others = i + 1 + np.flatnonzero(roots[i + 1 :] != roots[i])
            if first != second:
                others = others[blocks[others] != blocks[i]]
            near = _near(sizes, bits, i, others) if len(others) else others
            if len(near) and long[i]:
                near = np.concatenate([near[~long[near]], _near(sizes, wide, i, near[long[near]])])
            if len(near):
                for j in near.tolist():
                    forest.join(int(nodes[i]), int(nodes[j]))
                roots[np.isin(roots, np.append(roots[near], roots[i]))] = forest.root(int(nodes[i]))
        yield _edges(forest)


def _large(members: DataFrame) -> DataFrame:
    """Members of the components that _dealt would split."""
    some = members.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("s")).filter((F.col("c") > BLOCK) | (F.col("s") > BLOCK_SHINGLES))
    return members.join(some.select("component"), "component", "left_semi")


def _dealt(members: DataFrame, most: int = BLOCK, most_shingles: int | None = BLOCK_SHINGLES) -> DataFrame:
    """component, node, block, i, j: members of (component, node, n) by pairs of blocks, most components being one."""
    parts = F.ceil(F.count("*") / F.lit(most))
    if most_shingles:
        parts = F.greatest(parts, F.ceil(F.sum("n") / F.lit(most_shingles)))
    blocks = members.groupBy("component").agg(parts.cast("int").alias("blocks"))
    dealt = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("component", "node", "block", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _verify(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in common.sorted_groups(batches, ("component", "i", "j")):
            if group.num_rows > 1:
                sets, nodes, blocks = [], [], []
                names, mine = group.column("node").to_pylist(), group.column("block").to_pylist()
                at = 0
                for c in word_chunks(*text_buffers(group.column("text"))):
                    for k in range(len(c.bounds) - 1):
                        grams = shingle_set(c.hashes[c.bounds[k] : c.bounds[k + 1]], words)
                        if fingerprint(grams) == names[at] and names[at] not in nodes[-1:]:  # not another text of a repeated id
                            sets.append(grams)
                            nodes.append(names[at])
                            blocks.append(mine[at])
                        at += 1
                first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
                sides = None if first == second else (np.array(blocks) != first).astype(np.int8)
                labels = join_sets(sets, sides)
                for x, label in zip(nodes, labels, strict=True):
                    forest.join(nodes[label_first(labels, label)], x)
            if len(forest.edges) > 10_000:
                yield _edges(forest)
        yield _edges(forest)

    return run


def label_first(labels: np.ndarray, label: int) -> int:
    return int(np.flatnonzero(labels == label)[0])


def components(docs: DataFrame, words: int = 5, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    scratch = scratch or common.Scratch(docs.sparkSession)
    common.ship(docs.sparkSession)
    seen = scratch.save(features(docs, words))
    nodes = scratch.save(seen.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc"), F.max("n").alias("n"), F.max("bits").alias("bits"), F.max("wide").alias("wide")))
    whole = scratch.save(seen.select("doc_id", F.col("n").alias("n_shingles"), "node"))
    postings = seen.filter("node is not null").select(F.explode("prefix").alias("token"), "node")
    shared = postings.repartition("token").sortWithinPartitions("token", "node").mapInArrow(_shared, "token long, node long, times long")
    shared = scratch.save(shared.groupBy("token", "node").agg(F.sum("times").alias("times")))
    scratch.drop(seen)
    # a partner has at least 3/4 of a node's shingles
    needed = 1 + F.floor(F.ceil(F.col("n") * 0.75) / 20)
    bits = scratch.save(shared.groupBy("node").agg(F.sum("times").alias("times")).join(nodes, "node").filter(F.col("times") >= needed).select("node", "n", "bits"))
    near = _near_nodes(shared.select("token", "node"), bits, scratch)
    scratch.drop(shared, bits)
    coarse = scratch.save(common.connected_components(near, scratch).join(nodes.select("node", "doc", "n"), "node"))
    # large components go in pairs of blocks; first by bitmaps alone, which leaves few of them large
    blocks = scratch.save(_dealt(_large(coarse), BITMAP_BLOCK, None).drop("blocks"))
    if blocks.limit(1).count():
        parts = blocks.join(nodes.select("node", "n", "bits", "wide"), "node").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
        finer = common.connected_components(scratch.save(parts.mapInArrow(_refine, "a long, b long")), scratch)
        small = coarse.join(blocks.select("node").distinct(), "node", "left_anti")
        fine = finer.join(nodes.select("node", "doc", "n"), "node")
        coarse = scratch.save(small.unionByName(fine.select(*small.columns)))
    dealt = _dealt(coarse)
    texts, _ = common.split_by_ids(docs.select(F.col("doc_id").alias("doc"), "text"), "doc", coarse, "doc")
    texts = texts.join(coarse.select("doc", "node"), "doc").select("node", "text")
    texts = dealt.join(texts, "node")
    links = texts.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(_verify(words), "a long, b long")
    joined = common.connected_components(scratch.save(links), scratch)
    least = joined.join(nodes.select("node", "doc"), "node")
    least = least.join(least.groupBy("component").agg(F.min("doc").alias("component_id")), "component").select("node", F.col("component_id").alias("linked"))
    named = scratch.save(nodes.select("node", "doc").join(least, "node", "left").select("node", F.coalesce("linked", "doc").alias("component_id")))
    placed = whole.filter("node is not null and doc_id is not null").join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = whole.filter("node is null or doc_id is null").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).alias("component_id"))
    return _same_id(placed.unionByName(alone))


def _same_id(rows: DataFrame) -> DataFrame:
    """Rows that repeat a doc_id with other texts take the smallest component of these."""
    again = rows.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("component_id").alias("__least"), F.max("component_id").alias("__most")).filter("c > 1 and __least <> __most").select(F.col("doc_id").alias("__id"), "__least")
    return rows.join(again, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "n_shingles", F.coalesce("__least", "component_id").alias("component_id"))


def deduplicate(docs: DataFrame, words: int = 5) -> DataFrame:
    """All columns of the documents that stay: one of each component, that of the smallest doc_id.

    Rows without doc_id stay.  Of rows that repeat the id that stays, that of the smallest
    text stays.  Only rows whose id may be one that goes or repeats are shuffled; the others
    pass where they are.
    """
    common.no_clash(docs.columns, ("__dedup_id", "__dedup_component", "__dedup_rows", "__dedup_stays", "__dedup_place"))
    scratch = common.Scratch(docs.sparkSession)
    found = components(docs, words, scratch)
    asked = found.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__dedup_id")).agg(F.min("component_id").alias("__dedup_component"), F.count("*").alias("__dedup_rows"))
    asked = scratch.save(asked.filter("__dedup_rows > 1 or __dedup_id <> __dedup_component").select("__dedup_id", (F.col("__dedup_id") == F.col("__dedup_component")).alias("__dedup_stays")))
    maybe, stay = common.split_by_ids(docs, "doc_id", asked, "__dedup_id")
    looked = maybe.join(asked, F.col("doc_id") == F.col("__dedup_id"), "left").filter(F.coalesce("__dedup_stays", F.lit(True)))
    first = W.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *[F.col(f"`{f.name}`").asc_nulls_first() for f in docs.schema.fields if isinstance(f.dataType, AtomicType)])
    again = looked.filter("__dedup_stays").withColumn("__dedup_place", F.row_number().over(first)).filter("__dedup_place = 1").select(*docs.columns)
    return stay.unionByName(looked.filter("__dedup_stays is null").select(*docs.columns)).unionByName(again)
