"""Connected components by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.store import Stage

BATCH_EDGES = 1 << 20
FEW_EDGES = 1 << 18  # that many (4 MB) are finished in one task, and their nodes (8 MB at most) broadcast


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 with the edges (a, b): the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _forest(src: np.ndarray, dst: np.ndarray) -> pa.RecordBatch:
    nodes, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
    root = roots(place[: len(src)], place[len(src) :], len(nodes))
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.record_batch({"u": nodes[other], "v": nodes[root[other]]})


def _contract(batches):
    """Edges of a task as stars of their components, a bounded number at a time."""
    src, dst, held = [], [], 0
    for batch in batches:
        src.append(batch.column(0).to_numpy())
        dst.append(batch.column(1).to_numpy())
        held += len(src[-1])
        if held >= BATCH_EDGES:
            yield _forest(np.concatenate(src), np.concatenate(dst))
            src, dst, held = [], [], 0
    if held:
        yield _forest(np.concatenate(src), np.concatenate(dst))


def _named(batches):
    """All edges at once: each node and its component."""
    edges = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches]
    if edges:
        nodes, place = np.unique(np.concatenate([u for u, _ in edges] + [v for _, v in edges]), return_inverse=True)
        half = len(place) // 2
        yield pa.record_batch({"node": nodes, "component": nodes[roots(place[:half], place[half:], len(nodes))]})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(least, "u")
        .filter("v > u")
        .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame):
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.

    ``edges`` has two bigint columns. Each task first replaces its edges by stars
    of the components it sees, then large and small stars alternate until nothing
    changes (O(log^2) rounds) or so few edges are left that one task ends it. A node
    in most edges costs one minimum, combined before the shuffle, and a join that
    adaptive execution splits. What that one task gives is bounded and marked for
    broadcast, so that joins with it shuffle nothing.
    """
    a, b = edges.columns
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    now = stage.keep(edges.mapInArrow(_contract, "u bigint, v bigint"), "edges")
    before = None
    while (digest := _digest(now)) != before:
        before = digest
        if digest[0] <= FEW_EDGES:
            named = stage.keep(now.coalesce(1).mapInArrow(_named, "node bigint, component bigint"), "components")
            stage.drop(now)
            return F.broadcast(named)
        new = stage.keep(_small_star(_large_star(now)), "stars")
        stage.drop(now)
        now = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
