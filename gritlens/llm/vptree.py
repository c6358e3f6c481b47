"""Nearest neighbours by vantage-point trees, one per shard.

Rows are dealt to shards of bounded size by hash. A shard's tree splits its points
by their angle to a vantage point, inner half and outer half, down to small
leaves, and keeps the least and largest angle of either half. A search skips a
half when the triangle inequality says that it is farther than the k-th nearest
so far; ``relax`` multiplies that bound. At 1 nothing nearer is ever skipped, the
search is exact; more skips more. The index is a table, a row per shard.

A stated set of queries is searched in blocks: a task takes a block of queries and
a few shards, goes through them one after another with what it has found so far,
and gives the k best of each query, which are then put together. Of equal vectors
only the k + 1 with the smallest ids can be among the nearest k of anything, so
the others are not indexed; a vector that a third of the rows share is k + 1 rows.

Rules for odd rows: vectors that are null, zero or hold a null or non-finite
component neither ask nor answer; vectors of different lengths do not meet. Rows
that repeat an id and its vector are one; an id with several vectors counts by the one
nearest to the query. A row is never its own neighbour, nor is
another row with its id. Null ids take no part. Without candidates a query has no
rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritlens.llm.store import Stage
from gritlens.llm.vectors import cosines, matrix, takes_part, unit

SHARD = 4096       # vectors of a tree, about
SHARDS_AT_ONCE = 4  # trees that a task goes through for a block of queries
BLOCK = 512        # queries of a block, about
LEAF = 64
RELAX = 1.5

RESULT = "query_id bigint, query_key bigint, vec_id bigint, score double"


class Tree:
    """Points in an order in which every node is a range."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.nodes: list[tuple] = []  # (low, high, middle, inner node, outer node, angles) or (low, high)
        self._unit = unit(points)
        self._build(0, len(points), leaf)
        self._unit = self._unit[self.order]

    def _angles(self, at: int, rows: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(np.einsum("ij,j->i", self._unit[rows], self._unit[at]), -1, 1))

    def _build(self, low: int, high: int, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append((low, high))
        if high - low <= leaf:
            return number
        rows = self.order[low:high]
        # of a few points, the one whose angles to the others differ most
        tried = rows[:: max(1, len(rows) // 5)][:5]
        vantage = max(tried.tolist(), key=lambda r: float(self._angles(r, rows).std()))
        rest = rows[rows != vantage]
        angle = self._angles(vantage, rest)
        ranked = np.argsort(angle, kind="stable")
        rest, angle = rest[ranked], angle[ranked]
        self.order[low], self.order[low + 1 : high] = vantage, rest
        half = len(rest) // 2
        bounds = (angle[0], angle[half - 1], angle[half], angle[-1])
        inner = self._build(low + 1, low + 1 + half, leaf)
        outer = self._build(low + 1 + half, high, leaf)
        self.nodes[number] = (low, high, inner, outer, bounds)
        return number

    def search(self, asked: "Asked", ids: np.ndarray, relax: float, rows: np.ndarray | None = None) -> None:
        """Improve ``asked`` with the points; ``ids`` and ``rows`` (their numbers) in the points' first order."""
        rows = np.arange(len(ids)) if rows is None else rows
        self._visit(0, np.arange(len(asked.unit)), asked, ids[self.order], rows[self.order], relax)

    def _visit(self, number: int, some: np.ndarray, asked: "Asked", ids: np.ndarray, rows: np.ndarray, relax: float) -> None:
        node = self.nodes[number]
        low, high = node[:2]
        if len(node) == 2:
            asked.meet(some, np.einsum("ij,kj->ik", asked.unit[some], self._unit[low:high]), ids[low:high], rows[low:high])
            return
        _, _, inner, outer, (a, b, c, d) = node
        cosine = np.einsum("ij,kj->ik", asked.unit[some], self._unit[low : low + 1])
        asked.meet(some, cosine, ids[low : low + 1], rows[low : low + 1])
        angle = np.arccos(np.clip(cosine[:, 0], -1, 1))
        halves = [(inner, np.maximum(np.maximum(a - angle, angle - b), 0)), (outer, np.maximum(np.maximum(c - angle, angle - d), 0))]
        if np.mean(halves[0][1]) > np.mean(halves[1][1]):
            halves.reverse()
        for child, bound in halves:
            going = some[bound * relax <= asked.reach(some) + 1e-12]
            if len(going):
                self._visit(child, going, asked, ids, rows, relax)


class Asked:
    """Queries and the k best ids of each so far, by cosine and then smaller id; an id counts by its best row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.unit, self.k = ids, vectors, unit(vectors), k
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.row = np.full((len(ids), k), -1)

    def reach(self, some: np.ndarray) -> np.ndarray:
        worst = self.score[some, -1]
        return np.where(np.isinf(worst), np.pi, np.arccos(np.clip(worst, -1, 1)))

    def meet(self, some: np.ndarray, cosine: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        cosine = np.where(ids[None, :] == self.ids[some][:, None], -np.inf, cosine)
        better = np.flatnonzero(cosine.max(axis=1) >= self.score[some, -1])
        if not len(better):
            return
        rows = some[better]
        score = np.concatenate([self.score[rows], cosine[better]], axis=1)
        found = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        row = np.concatenate([self.row[rows], np.broadcast_to(numbers, (len(rows), len(ids)))], axis=1)
        found = np.where(np.isinf(score), np.iinfo(np.int64).max, found)
        if len(np.unique(ids)) < len(ids) or np.isin(self.found[rows], ids).any():
            # of several rows of an id only the best has a place
            by_id = np.lexsort((-score, found), axis=1)
            sorted_ = np.take_along_axis(found, by_id, axis=1)
            again = np.zeros(found.shape, bool)
            np.put_along_axis(again[:, :], by_id[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
            score = np.where(again, -np.inf, score)
            found = np.where(again, np.iinfo(np.int64).max, found)
        best = np.lexsort((found, -score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, best, axis=1)
        self.found[rows] = np.take_along_axis(found, best, axis=1)
        self.row[rows] = np.take_along_axis(row, best, axis=1)


def _plant(table):
    """The tree of a shard as one row."""
    points = matrix(table.column("embedding"))
    tree = Tree(points)
    return pa.table({
        "dims": table.column("dims").slice(0, 1), "shard": table.column("shard").slice(0, 1),
        "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
        "points": pa.array([points.tobytes()], pa.binary()), "tree": pa.array([pickle.dumps((tree.order, tree.nodes))], pa.binary()),
    })


def _planted(points: np.ndarray, order: np.ndarray, nodes: list) -> Tree:
    tree = Tree.__new__(Tree)
    tree.order, tree.nodes, tree._unit = order, nodes, unit(points)[order]
    return tree


def _search(k: int, relax: float):
    def run(queries, shards):
        empty = pa.table({n: pa.array([], t) for n, t in zip(
            ("query_id", "query_key", "vec_id", "score"), (pa.int64(), pa.int64(), pa.int64(), pa.float64()))})
        if not queries.num_rows or not shards.num_rows:
            return empty
        vectors = matrix(queries.column("embedding"))
        asked = Asked(queries.column("vec_id").to_numpy(), vectors, k)
        met: list[np.ndarray] = []
        many = 0
        for ids, points, tree in zip(*(shards.column(c).to_pylist() for c in ("ids", "points", "tree"))):
            ids = np.frombuffer(ids, "<i8")
            points = np.frombuffer(points, np.float64).reshape(len(ids), -1)
            _planted(points, *pickle.loads(tree)).search(asked, ids, relax, np.arange(many, many + len(ids)))
            met.append(points)
            many += len(ids)
        query, rank = np.nonzero(~np.isinf(asked.score))
        found = asked.found[query, rank]
        if not len(found):
            return empty
        # the score that counts is the cosine of the vectors as they are
        score = cosines(vectors[query], np.concatenate(met)[asked.row[query, rank]])
        return pa.table({
            "query_id": asked.ids[query], "query_key": queries.column("query_key").to_numpy()[query],
            "vec_id": found, "score": score,
        })

    return run


def build_index(vectors: DataFrame, k: int, shard: int = SHARD) -> DataFrame:
    """(dims, shard, ids, points, tree) of all vectors (vec_id, embedding, dims)."""
    many = max(1, -(-vectors.count() // shard))
    equal = Window.partitionBy("dims", "embedding").orderBy("vec_id")
    first = vectors.withColumn("_rank", F.row_number().over(equal)).filter(F.col("_rank") <= k + 1).drop("_rank")
    # ids apart from hashes of vectors, so that neither a common vector nor a common id fills a shard
    dealt = first.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(many)).cast("int"))
    return dealt.groupBy("dims", "shard").applyInArrow(
        _plant, "dims int, shard int, ids binary, points binary, tree binary"
    )


def nearest(embeddings: DataFrame, asks: Column, k: int = 5, relax: float = RELAX, shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row that ``asks`` holds for."""
    stage = Stage(embeddings.sparkSession, "vptree")
    valid = embeddings.filter(takes_part("embedding") & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", F.size("embedding").alias("dims"), asks.alias("asks")
    )
    distinct = stage.keep(valid.dropDuplicates(["vec_id", "embedding"]), "vectors")
    index = stage.keep(build_index(distinct.select("vec_id", "embedding", "dims"), k, shard), "index")
    asked = distinct.filter("asks")
    blocks = max(1, -(-asked.count() // BLOCK))
    shards = index.select("dims", "shard").distinct().count()
    groups = max(1, -(-shards // SHARDS_AT_ONCE))
    queries = asked.select(
        "vec_id", "embedding", "dims", F.xxhash64("embedding").alias("query_key"),
        F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("shards"),
    )
    trees = index.select(
        "dims", "ids", "points", "tree", F.pmod("shard", F.lit(groups)).alias("shards"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
    )
    keys = ["dims", "block", "shards"]
    found = queries.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_search(k, relax), RESULT)
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "query_key", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
