"""Hard negatives: cover trees over norm-augmented candidates, searched by windows of scores.

Vectors are whole numbers, a score is an inner product. A candidate x becomes
(x, sqrt(M^2 - |x|^2)), M being the largest norm of its tree, so that all lie on
one sphere and an inner product with (q, 0) is |q| M times the cosine of an angle.
A tree's level has centres farther apart than its covering radius, each of which
covers its points within that radius; the next level's radius is 1.5 times less.
The angle between query and centre, less or plus the node's radius as an angle,
bounds the inner products of all its points from above and below. A search goes
best bound first, skips nodes that lie outside all windows of a query or under
what it has found, and multiplies the points of the leaves exactly.

Candidates are dealt to cells, by the nearest of at most ``PIVOTS`` pivots, and
large cells to trees of about ``CELL`` points by hash. Cells are bounded in the same
way, so an anchor is sent only to cells that may hold an answer: its own cell
first for positives, then the cells that its fifth best so far leaves open, then
those that its windows of negatives reach. Anchors go in blocks, trees are copied
once per block of their cell. Of equal vectors with one label only the k + 1 with
the smallest ids are indexed, since no others can be among the first k.

Rules for odd rows: rows with a null id or label, a null or empty vector, or a null
or non-finite component take no part; vectors of different lengths do not meet.
Rows that repeat an id, label and vector are one; rows that share only the id
are rows of their own, but never each other's positives or negatives. Scores beyond
the range of a long are held at its ends. An anchor without positives, or whose
positives have no negatives within their window, returns nothing.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritlens.llm.exact import all_finite, as_longs, by_length, fits_double, largest, products, whole
from gritlens.llm.store import Stage

CELL = 4096     # points of a tree, about
PIVOTS = 1024   # cells at most
BLOCK = 2048    # anchors of a block, about
LEAF = 32
BASE = 1.5      # covering radius of a level by that of the next
AT_ONCE = 1 << 20  # bounds worked out at a time

NONE = np.iinfo(np.int64).max
FOUND = "anchor_id bigint, anchor_key bigint, place int, vec_id bigint, score bigint"


class CoverTree:
    """Points in an order in which every node is a range that starts with its centre."""

    def __init__(self, x: np.ndarray):
        norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.norm = float(norms.max())
        scaled = x / self.norm if self.norm else x.astype(np.float64)
        lifted = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0))
        self._on_sphere = np.column_stack([scaled, lifted])
        self.order = np.arange(len(x))
        nodes, work = [[0, len(x), 0, 0, 0.0]], [0]  # low, high, first child, children, radius
        while work:
            at = work.pop()
            low, high = nodes[at][:2]
            radius, ranges = self._level(low, high)
            nodes[at][4] = radius
            if ranges:
                nodes[at][2:4] = len(nodes), len(ranges)
                work.extend(range(len(nodes), len(nodes) + len(ranges)))
                nodes.extend([a, b, 0, 0, 0.0] for a, b in ranges)
        table = np.array(nodes)
        self.low, self.high, self.child, self.children = (table[:, i].astype(np.int64) for i in range(4))
        # a chord of the sphere as an angle, with room for what rounding takes
        self.radius = 2 * np.arcsin(np.minimum(table[:, 4] / 2, 1)) + np.where(table[:, 4] > 0, 1e-7, 0)

    def nodes(self) -> SimpleNamespace:
        """What a search reads; of a class that every worker knows."""
        return SimpleNamespace(**{n: getattr(self, n) for n in ("low", "high", "child", "children", "radius", "norm")})

    def _level(self, low: int, high: int) -> tuple[float, list[tuple[int, int]]]:
        """The covering radius of a node (as a chord), and its children's ranges."""
        rows = self.order[low:high]
        points = self._on_sphere[rows]
        chord = lambda near: np.sqrt(np.maximum(2 - 2 * near, 0))
        away = chord(points @ points[0])
        away[0] = 0
        radius = float(away.max())
        if high - low <= LEAF or radius < 1e-6:
            return radius, []
        within, parts = radius / BASE, []
        left = np.arange(len(rows))
        while len(left):
            near = away[left] if not parts else chord(points[left] @ points[left[0]])
            near[0] = 0
            parts.append(left[near <= within])
            left = left[near > within]
        self.order[low:high] = rows[np.concatenate(parts)]
        ends = low + np.cumsum([len(p) for p in parts])
        return radius, list(zip([low, *ends[:-1].tolist()], ends.tolist()))


class Asked:
    """Anchors with windows of scores, and the k best of each window so far."""

    def __init__(self, ids, labels, x, low, high, k: int, same: bool, plain: bool):
        self.ids, self.labels, self.x, self.low, self.high = ids, labels, x, low, high
        self.k, self.same, self.plain = k, same, plain
        self.norms = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        self.score = np.full((*low.shape, k), -np.inf, np.float64 if plain else object)
        self.found = np.full((*low.shape, k), NONE)

    def may(self, rows: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Whether numbers from ``lower`` to ``upper`` (rows x nodes) reach an open part of a window."""
        need = np.maximum(self.low[rows], self.score[rows, :, -1])
        open_ = np.zeros(upper.shape, bool)
        for w in range(self.low.shape[1]):
            wanted = (need[:, w] <= self.high[rows, w])[:, None]
            open_ |= wanted & (upper >= need[:, w : w + 1]) & (lower <= self.high[rows, w : w + 1])
        return open_

    def meet(self, rows: np.ndarray, points: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        score = products(self.x[rows], points, self.plain)
        fits = ((labels[None, :] == self.labels[rows][:, None]) == self.same) & (ids[None, :] != self.ids[rows][:, None])
        for w in range(self.low.shape[1]):
            need = np.maximum(self.low[rows, w], self.score[rows, w, -1])
            r, c = np.nonzero(fits & (score >= need[:, None]) & (score <= self.high[rows, w][:, None]))
            if not len(r):
                continue
            some = np.unique(rows[r])
            row = np.concatenate([rows[r], np.repeat(some, self.k)])
            value = np.concatenate([score[r, c], self.score[some, w].ravel()])
            vec_id = np.concatenate([ids[c], self.found[some, w].ravel()])
            falling = -value if self.plain else -np.unique(value, return_inverse=True)[1]
            order = np.lexsort((vec_id, falling, row))
            row, value, vec_id = row[order], value[order], vec_id[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            kept = rank < self.k
            self.score[row[kept], w, rank[kept]] = value[kept]
            self.found[row[kept], w, rank[kept]] = vec_id[kept]


def search(tree: CoverTree | SimpleNamespace, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, asked: Asked) -> None:
    """Improve ``asked`` with a tree's points; ``x``, ``ids`` and ``labels`` are in the tree's order."""
    everyone = np.arange(len(asked.ids))
    endless = np.full(len(everyone), np.inf)
    heap, number = [(-np.inf, 0, 0, everyone, endless, -endless)], 1
    while heap:
        _, _, node, rows, upper, lower = heapq.heappop(heap)
        rows = rows[asked.may(rows, upper[:, None], lower[:, None])[:, 0]]
        if not len(rows):
            continue
        if not tree.children[node]:
            asked.meet(rows, x[tree.low[node] : tree.high[node]], ids[tree.low[node] : tree.high[node]], labels[tree.low[node] : tree.high[node]])
            continue
        below = np.arange(tree.child[node], tree.child[node] + tree.children[node])
        leaf = tree.children[below] == 0
        centres = x[tree.low[below]].astype(np.float64).T
        step = max(1, AT_ONCE // len(below))
        for some in (rows[i : i + step] for i in range(0, len(rows), step)):
            scale = (asked.norms[some] * tree.norm)[:, None]
            cosine = asked.x[some].astype(np.float64) @ centres / np.where(scale > 0, scale, 1)
            angle = np.arccos(np.clip(cosine, -1, 1))
            slack = 1e-9 * scale + 1e-9
            upper = scale * np.cos(np.maximum(angle - tree.radius[below], 0)) + slack
            lower = scale * np.cos(np.minimum(angle + tree.radius[below], np.pi)) - slack
            open_ = asked.may(some, upper, lower)
            flat = np.flatnonzero(leaf & open_.any(axis=0))
            if len(flat):
                size = tree.high[below[flat]] - tree.low[below[flat]]
                points = np.repeat(tree.low[below[flat]] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                asked.meet(some[open_[:, flat].any(axis=1)], x[points], ids[points], labels[points])
            for c in np.flatnonzero(~leaf & open_.any(axis=0)):
                going = open_[:, c]
                heapq.heappush(heap, (-float(upper[going, c].max()), number, int(below[c]), some[going], upper[going, c], lower[going, c]))
                number += 1


def _plant(table: pa.Table) -> pa.Table:
    """The tree of a cell's part as one row, points in its order."""
    ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
    (_, x), = by_length(table.column("x"))
    tree = CoverTree(x)
    order = tree.order
    return pa.table({
        **{c: table.column(c).slice(0, 1) for c in ("dims", "cell", "part")},
        "tree": pa.array([pickle.dumps((tree.nodes(), x[order], ids[order], labels[order]))], pa.binary()),
    })


class Cells:
    """Pivots, and how far the points of each one's cell lie from it; cell 0 is of lengths without a pivot."""

    def __init__(self, pivots: list[list[int]]):
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {len(p) for p in pivots}:
            places = [i for i, p in enumerate(pivots) if len(p) == length]
            self.by_length[length] = np.array(places) + 1, np.array([pivots[i] for i in places], np.float64)
        self.reach = np.zeros(len(pivots) + 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance) of each row."""
        if x.shape[1] not in self.by_length:
            return np.zeros(len(x), np.int32), np.zeros(len(x))
        names, pivots = self.by_length[x.shape[1]]
        x = x.astype(np.float64)
        best = (x @ pivots.T - (pivots**2).sum(axis=1) / 2).argmax(axis=1)
        return names[best].astype(np.int32), np.sqrt(((x - pivots[best]) ** 2).sum(axis=1))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cells, least, largest inner product of each row with a point of each cell)."""
        if x.shape[1] not in self.by_length:
            endless = np.full((len(x), 1), np.inf)
            return np.zeros(1, np.int32), -endless, endless
        names, pivots = self.by_length[x.shape[1]]
        x = x.astype(np.float64)
        norm = np.sqrt((x**2).sum(axis=1))[:, None]
        middle = x @ pivots.T
        room = norm * (self.reach[names] + 1e-9 * np.sqrt((pivots**2).sum(axis=1))) * (1 + 1e-9) + 1e-9
        return names.astype(np.int32), middle - room, middle + room


def _dealt(cells: Cells):
    """Adds (cell, away) to rows with the column x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, away = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for places, x in by_length(batch.column("x")):
                cell[places], away[places] = cells.nearest(x)
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def windows(scores: list[list[int]], least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) of whole numbers n with least * s <= 100 * n <= most * s for each score s; empty where there is none."""
    wide = max((len(s) for s in scores), default=0)
    low = np.full((len(scores), wide), 1, object)
    high = np.zeros((len(scores), wide), object)
    for i, some in enumerate(scores):
        for j, s in enumerate(some):
            low[i, j], high[i, j] = -(-least * s // 100), most * s // 100
    return low, high


def _open_cells(cells: Cells, shares: tuple[int, int] | None):
    """Adds the cells that may hold an answer: those that reach ``floor`` but for the own cell, or else the windows of ``scores``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [None] * batch.num_rows
            given = batch.column("scores" if shares else "floor").to_pylist()
            home = batch.column("cell").to_numpy()
            for places, x in by_length(batch.column("x")):
                names, lower, upper = cells.bounds(x)
                if shares:
                    low, high = windows([given[i] for i in places], *shares)
                    reached = np.zeros(upper.shape, bool)
                    for w in range(low.shape[1]):
                        wanted = (low[:, w] <= high[:, w]).astype(bool)[:, None]
                        reached |= wanted & (upper >= low[:, w : w + 1].astype(float)) & (lower <= high[:, w : w + 1].astype(float))
                else:
                    floor = np.array([-np.inf if given[i] is None else given[i] for i in places], float)
                    reached = (upper >= floor[:, None]) & (names[None, :] != home[places][:, None])
                for i, row in zip(places, reached):
                    found[i] = names[row].tolist()
            yield pa.record_batch([*batch.columns, pa.array(found, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return run


def _searched(k: int, shares: tuple[int, int] | None):
    """The k best of a block's anchors in one tree: positives, or negatives within ``shares`` of the positives' scores."""

    def run(anchors: pa.Table, trees: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], t) for n, t in (
            ("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        if not anchors.num_rows or not trees.num_rows:
            return empty
        (_, own), = by_length(anchors.column("x"))
        keys = anchors.column("anchor_key").to_numpy()
        ids, labels = anchors.column("vec_id").to_numpy(), anchors.column("label").to_numpy()
        tree, x, point_ids, point_labels = pickle.loads(trees.column("tree")[0].as_py())
        plain = fits_double(largest(own), largest(x), x.shape[1])
        if shares:
            low, high = windows(anchors.column("scores").to_pylist(), *shares)
        else:
            low, high = np.full((len(ids), 1), -np.inf, object), np.full((len(ids), 1), np.inf, object)
        kind = np.float64 if plain else object
        asked = Asked(ids, labels, own, low.astype(kind), high.astype(kind), k, shares is None, plain)
        search(tree, x, point_ids, point_labels, asked)
        row, place, rank = np.nonzero(asked.found != NONE)
        if not len(row):
            return empty
        return pa.table({
            "anchor_id": ids[row], "anchor_key": keys[row], "place": place.astype(np.int32),
            "vec_id": asked.found[row, place, rank], "score": as_longs(asked.score[row, place, rank]),
        })

    return run


class Index:
    """Cells and trees of candidates (vec_id, label, x, dims)."""

    def __init__(self, stage: Stage, rows: DataFrame, k: int, cell: int = CELL):
        equal = Window.partitionBy("dims", "label", "x").orderBy("vec_id")
        first = rows.withColumn("_rank", F.row_number().over(equal)).filter(F.col("_rank") <= k + 1).drop("_rank")
        points = stage.keep(first, "points")
        many = points.count()
        picked = points.orderBy(F.xxhash64("x"), "vec_id", "label").limit(max(1, min(PIVOTS, many // cell))).select("x").collect()
        self.stage, self.k = stage, k
        self.cells = Cells([r["x"] for r in picked])
        dealt = stage.keep(self.deal(points), "cells")
        stage.drop(points)
        self.parts = [1] * len(self.cells.reach)
        for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
            self.parts[r["cell"]] = max(1, -(-r["n"] // cell))
            self.cells.reach[r["cell"]] = r["away"]
        part = F.pmod(F.xxhash64("vec_id", "x"), self._of(self.parts)).cast("int")
        self.trees = stage.keep(
            dealt.withColumn("part", part).groupBy("dims", "cell", "part").applyInArrow(_plant, "dims int, cell int, part int, tree binary"),
            "trees",
        )
        stage.drop(dealt)

    def deal(self, rows: DataFrame) -> DataFrame:
        """Adds the cell of each row, and its distance from the cell's pivot."""
        return rows.mapInArrow(_dealt(self.cells), _fields(rows) + ", cell int, away double")

    def _of(self, numbers: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in numbers]), F.col("cell") + 1)

    def best(self, anchors: DataFrame, shares: tuple[int, int] | None) -> DataFrame:
        """What each anchor finds in its ``cells``, the k best of each window."""
        asked = self.stage.keep(anchors.withColumn("cell", F.explode("cells")).drop("cells"), "asked")
        blocks = [1] * len(self.parts)
        for r in asked.groupBy("cell").count().collect():
            blocks[r["cell"]] = max(1, -(-r["count"] // BLOCK))
        count_to = lambda numbers: F.explode(F.sequence(F.lit(0), self._of(numbers) - 1))
        asked = asked.withColumn("block", F.pmod("anchor_key", self._of(blocks)).cast("int")).withColumn("part", count_to(self.parts))
        trees = self.trees.withColumn("block", count_to(blocks))
        keys = ["dims", "cell", "part", "block"]
        found = asked.groupBy(*keys).cogroup(trees.groupBy(*keys)).applyInArrow(_searched(self.k, shares), FOUND)
        return first(found, self.k)


def first(found: DataFrame, k: int) -> DataFrame:
    """The k best of each anchor and window, with their rank."""
    best = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _fields(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


def hard_negatives(
    embeddings: DataFrame, asks: Column, label: Column, k: int = 5, shares: tuple[int, int] = (80, 100), cell: int = CELL,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows that ``asks`` holds for, ``label`` is the label to go by. For
    each anchor and each of its k first positives the k first rows of other labels
    whose score lies between the two shares (in hundredths) of the positive's.
    """
    stage = Stage(embeddings.sparkSession, "covertree")
    valid = embeddings.filter(all_finite("embedding") & (F.size("embedding") > 0) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), whole("embedding").alias("x"),
        F.size("embedding").alias("dims"), F.coalesce(asks, F.lit(False)).alias("asks"),
    ).filter("label is not null")
    rows = stage.keep(valid.distinct(), "rows")
    index = Index(stage, rows.drop("asks"), k, cell)
    anchors = stage.keep(
        index.deal(rows.filter("asks").select("vec_id", F.xxhash64("label", "x", "vec_id").alias("anchor_key"), "label", "x", "dims")).drop("away"),
        "anchors",
    )
    def of_anchors(per_anchor: DataFrame, how: str) -> DataFrame:
        found = per_anchor.withColumnRenamed("anchor_key", "key")
        return anchors.join(found, [F.col("anchor_id") == anchors["vec_id"], F.col("key") == anchors["anchor_key"]], how).drop("anchor_id", "key")

    home = stage.keep(index.best(anchors.withColumn("cells", F.array("cell")).drop("cell"), None).drop("rank"), "near")
    floors = home.groupBy("anchor_id", "anchor_key").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    wider = of_anchors(floors, "left")
    wider = wider.mapInArrow(_open_cells(index.cells, None), _fields(wider) + ", cells array<int>").drop("floor", "cell")
    positives = stage.keep(first(home.unionByName(index.best(wider, None).drop("rank")), k), "positives")
    ranked = positives.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("of"))
    asking = of_anchors(ranked.select("anchor_id", "anchor_key", F.col("of.score").alias("scores")), "inner")
    asking = asking.mapInArrow(_open_cells(index.cells, shares), _fields(asking) + ", cells array<int>").drop("cell")
    negatives = index.best(asking, shares)
    chosen = positives.select(
        "anchor_id", "anchor_key", (F.col("rank") - 1).alias("place"),
        F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return negatives.join(chosen, ["anchor_id", "anchor_key", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
