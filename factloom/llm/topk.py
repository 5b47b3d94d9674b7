"""Exact top-k by integer inner product with dual-tree search on cover trees.

Rows are put in order of their nearest of some pivots and of how near it is, so that what a
task holds points the same way; every ``TREE_ROWS`` of them are indexed in a cover tree
(centres with covering radii, halved from level to level).  The queries have a tree too, made
once for each block of them, and both are walked together: a pair of nodes is pruned when

    c_q . c_r + |c_q| R_r + |c_r| R_q + R_q R_r  <  the worst k-th score in the query node.

Queries go round in blocks of bounded size; a task keeps the k best rows of each query from
tree to tree, prunes by them and returns them at its end, and the k best of all tasks'
rows are the answer.  Scores are exact: components are integers,
and products are taken in float64 where they stay under 2**53, else in Python integers.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part; a vector of another length than the query scores against the queries of its own
length only; ties go to the smaller vec_id; repeated rows of one vec_id each count; fewer
than k candidates give what there is; a null vec_id takes no part; an empty table gives no
rows; other columns are ignored, whatever their names.  Scores outside 64 bits are an error, and
components whose 1,024-fold is beyond 2**63 count as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LEAF, QUERY_LEAF = 96, 24
CELLS = 1 << 21  # scores that are held at once
WORTH = 0.8  # a node is split if its points lie by this nearer to their new centres
TREE_ROWS = 8192
PIVOTS = 32
SLACK = 1 + 1e-9


class Node:
    __slots__ = ("centre", "children", "norm", "radius", "rows")

    def __init__(self, centre: np.ndarray, radius: float, rows: np.ndarray, children: list[Node]) -> None:
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt(centre @ centre))


def cover_tree(points: np.ndarray, rows: np.ndarray | None = None, leaf: int | None = None) -> Node:
    """A cover tree over ``points``, with up to ``leaf`` (LEAF) of them in a node without children: children lie within half the radius of their own centres, which are that far apart."""
    rows, leaf = np.arange(len(points)) if rows is None else rows, leaf or LEAF
    mine = points[rows]
    centre = mine[np.argmin(((mine - mine.mean(axis=0)) ** 2).sum(axis=1))]
    apart = np.sqrt(((mine - centre) ** 2).sum(axis=1))
    radius = float(apart.max()) * SLACK
    if len(rows) <= leaf or radius == 0.0:
        return Node(centre, radius, rows, [])
    share, nearest, owner, centres = radius / 2, apart, np.zeros(len(rows), dtype=np.int64), 1
    while nearest.max() > share and centres < 32:  # the farthest point becomes a centre, its nearest join it
        new = np.sqrt(((mine - mine[int(nearest.argmax())]) ** 2).sum(axis=1))
        owner[new < nearest] = centres
        nearest = np.minimum(nearest, new)
        centres += 1
    if nearest.mean() > WORTH * apart.mean():  # points without clusters, where no bound would ever prune
        return Node(centre, radius, rows, [])
    parts = [rows[owner == i] for i in range(centres)]
    parts = [p for p in parts if len(p)]
    if len(parts) == 1:
        return Node(centre, radius, rows, [])
    return Node(centre, radius, rows, [cover_tree(points, p, leaf) for p in parts])


class Search:
    """k best rows for each query; ``ids`` of rows and queries decide ties and exclude a query's own row."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None, tree: Node | None = None) -> None:
        """``floor``: scores below these, one for each query, are not asked for; ``tree``: the queries' own, if it is made already."""
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        order = np.argsort(ids, kind="stable")  # so that a smaller place means a smaller id
        self.q, self.qids, self.p, self.ids, self.k = queries, query_ids, points[order], ids[order], k
        most = max(float(np.abs(queries).max(initial=0)) * float(np.abs(points).max(initial=0)) * points.shape[1], 1.0)
        self.exact = most < 2.0**53
        self.scores = np.full((len(queries), k), -np.inf)
        self.places = np.full((len(queries), k), -1, dtype=np.int64)
        self.visited = 0
        if len(queries) and len(points):
            self.walk(tree or cover_tree(self.q, leaf=QUERY_LEAF), cover_tree(self.p))

    def bound(self, a: Node, b: Node) -> float:
        product = float(a.centre @ b.centre)
        value = product + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return value + 1e-9 * (a.norm + a.radius) * (b.norm + b.radius) + 1e-6

    def walk(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < np.maximum(self.scores[a.rows, -1], self.floor[a.rows]).min():
            return
        if not a.children and not b.children:
            self.leaf(a.rows, b.rows)
            return
        if a.children and (not b.children or a.radius > b.radius):
            for x in a.children:
                self.walk(x, b)
            return
        for x in sorted(b.children, key=lambda y: -self.bound(a, y)):
            self.walk(a, x)

    def leaf(self, mine: np.ndarray, others: np.ndarray) -> None:
        step = max(1, CELLS // len(mine))
        for lo in range(0, len(others), step):
            self.some(mine, others[lo : lo + step])

    def some(self, mine: np.ndarray, others: np.ndarray) -> None:
        """Scores all pairs and keeps each query's best."""
        self.visited += len(mine) * len(others)
        found = self.q[mine] @ self.p[others].T
        found[self.qids[mine][:, None] == self.ids[others][None, :]] = -np.inf
        better = found >= np.maximum(self.scores[mine, -1], self.floor[mine])[:, None]
        asked = np.flatnonzero(better.any(axis=1))
        if not len(asked):
            return
        some = np.flatnonzero(better.any(axis=0))
        mine, others, found = mine[asked], others[some], found[np.ix_(asked, some)]
        scores = np.concatenate([self.scores[mine], found], axis=1)
        places = np.concatenate([self.places[mine], np.broadcast_to(others, found.shape)], axis=1)
        last = np.where(places < 0, np.iinfo(np.int64).max, places)
        best = np.lexsort((last, -scores), axis=1)[:, : self.k]
        self.scores[mine] = np.take_along_axis(scores, best, axis=1)
        self.places[mine] = np.where(np.isfinite(self.scores[mine]), np.take_along_axis(places, best, axis=1), -1)

    def places_found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, row ids, scores)."""
        i, j = np.nonzero(self.places >= 0)
        return i, self.ids[self.places[i, j]], self.scores[i, j]

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, scores)."""
        i, ids, scores = self.places_found()
        return self.qids[i], ids, scores.astype(np.int64)


class Best:
    """The k best rows of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows of the queries at ``places``; scores are exact in float64."""
        i, j = np.nonzero(self.scores > -np.inf)
        places, ids, scores = np.concatenate([i, places]), np.concatenate([self.ids[i, j], ids]), np.concatenate([self.scores[i, j], scores.astype(np.float64)])
        order = np.lexsort((ids, -scores, places))
        places, ids, scores = places[order], ids[order], scores[order]
        fresh = np.concatenate([[True], places[1:] != places[:-1]]) if len(places) else np.zeros(0, dtype=bool)
        rank = np.arange(len(places)) - np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
        kept = rank < self.k
        self.scores[:], self.ids[:] = -np.inf, np.iinfo(np.int64).max
        self.scores[places[kept], rank[kept]], self.ids[places[kept], rank[kept]] = scores[kept], ids[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of queries, row ids, scores)."""
        i, j = np.nonzero(self.scores > -np.inf)
        return i, self.ids[i, j], self.scores[i, j].astype(np.int64)


def _wide(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[int], list[int], list[int]]:
    """The same for components too large for exact float64: Python integers, query by query."""
    out: tuple[list[int], list[int], list[int]] = ([], [], [])
    whole = [[int(x) for x in p] for p in points]
    for q, name in zip(queries, query_ids, strict=True):
        q = [int(x) for x in q]
        scored = sorted((-sum(a * b for a, b in zip(q, p, strict=True)), int(i)) for p, i in zip(whole, ids, strict=True) if i != name)[:k]
        for s, i in scored:
            out[0].append(int(name))
            out[1].append(i)
            out[2].append(-s)
    return out


def integers(vectors: DataFrame, scale: float = 1024.0) -> DataFrame:
    """vec_id and floor(scale * x) of every component, for vectors without null or non-finite components."""
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("double"))).alias("v")).filter("v is not null and vec_id is not null")


def batch_of(query_ids, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query_ids, ids, scores)], names=["query_id", "vec_id", "score"])


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of rows of one length, up to TREE_ROWS at a time, in order."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        flat, ids = batch.column("v"), batch.column("vec_id").to_numpy()
        lengths = np.diff(flat.offsets.to_numpy())
        values, starts = flat.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
        for length in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == length)
            parts = waiting.setdefault(length, [])
            parts.append((ids[at], values[starts[at][:, None] + np.arange(length)]))
            if sum(len(i) for i, _ in parts) >= TREE_ROWS or sum(map(len, waiting.values())) > 1000:
                yield tuple(np.concatenate(x) for x in zip(*waiting.pop(length), strict=True))
    for parts in waiting.values():
        yield tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of (vec_id, v) dealt out and sorted by their nearest pivot, by angle, and how near it is.  Some rows are the pivots."""
    pivots: dict[int, list[np.ndarray]] = {}
    for r in rows.orderBy(F.xxhash64(F.lit(common.SEED), "vec_id"), "vec_id").limit(PIVOTS).collect():
        v = np.array(r["v"])
        if norm := float(np.linalg.norm(v)):
            pivots.setdefault(len(v), []).append(v / norm)
    held = {length: np.stack(p) for length, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v")
            lengths = np.diff(flat.offsets.to_numpy())
            values, starts = flat.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
            cell, near = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows)
            for length, p in held.items():
                at = np.flatnonzero(lengths == length)
                if len(at):
                    found = values[starts[at][:, None] + np.arange(length)] @ p.T
                    cell[at], near[at] = found.argmax(axis=1), found.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), flat, pa.array(cell), pa.array(near)], names=["vec_id", "v", "cell", "near"])

    placed = common.arrow_map(rows.select("vec_id", "v"), run, "vec_id long, v array<double>, cell int, near double")
    order = ("cell", F.desc("near"), "vec_id")
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")


def _query_block(mine: pd.DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, Node]]:
    """ids, vectors and tree of the queries of each length."""
    out: dict[int, tuple[np.ndarray, np.ndarray, Node]] = {}
    lengths = mine["v"].map(len) if len(mine) else pd.Series(dtype=int)
    for length in sorted(set(lengths)):
        some = mine[lengths == length].sort_values("vec_id")
        vectors = np.stack(some["v"].to_list()).astype(np.float64)
        out[int(length)] = (some["vec_id"].to_numpy(np.int64), vectors, cover_tree(vectors, leaf=QUERY_LEAF))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score.  ``block`` queries are held by a task at a time."""
    spark = vectors.sparkSession
    scratch = common.Scratch(spark)
    plain = scratch.save(integers(vectors, scale))
    rows = scratch.save(in_order(plain))
    queries = plain.filter(is_query)
    n = queries.count()
    blocks = max(1, -(-n // (block // 2)))  # by hash, so at most about half full
    found = None
    for i in range(blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i).select("vec_id", "v").toPandas() if n else pd.DataFrame({"vec_id": [], "v": []})
        held = spark.sparkContext.broadcast(_query_block(mine))  # bounded by ``block``

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best = {length: Best(len(qids), k) for length, (qids, _, _) in held.value.items()}
            for ids, points in _by_length(batches):
                qids, q, tree = held.value.get(points.shape[1], (None, None, None))
                if q is None:
                    continue
                most = float(np.abs(q).max()) * float(np.abs(points).max(initial=0)) * points.shape[1]
                if most < 2.0**53:
                    seen = best[points.shape[1]]
                    seen.add(*Search(q, qids, points, ids, k, seen.scores[:, -1], tree).places_found())
                else:
                    yield batch_of(*_wide(q, qids, points, ids, k))
            for length, seen in best.items():
                places, others, scores = seen.rows()
                yield batch_of(held.value[length][0][places], others, scores)

        part = scratch.save(common.arrow_map(rows, search, "query_id long, vec_id long, score long"))
        held.destroy()
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
