"""Quality: a generalised additive model with pairwise interactions.

Each feature has a table of values by bin, learned by cyclic boosting: again and
again every feature in turn adds a shallow tree over its bins, fitted to what the
others leave. Then the pairs of features that explain most of the rest get tables
over coarse bins in the same way. A score is a sum of looked-up numbers, so every
text is scored whole with vectorised additions; what a score is made of can be
read from the tables.

The tables are learned from a bounded sample of labelled rows (``FIT_ROWS``); a
third of these decides how many rounds are kept.

Rules for odd rows: a null or empty text gets the score of all-zero features. Rows
that repeat a doc_id are scored each. Without labels of both kinds every score is
the mean label, or 0. A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.features import FIT_ROWS, SHAPE, remainder, shape, training_rows, with_labels
from gritlens.llm.textbuf import Texts, small_slices

BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS = 150, 60
PAIRS = 8
RATE = 0.15
RIDGE = 5.0


def text_features(texts: Texts) -> np.ndarray:
    words = texts.lower().words()
    return shape(texts, words, words.hashes())


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)])


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _gain(g, h):
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values by bin of a tree of ``depth`` splits over gradient and weight sums by bin."""
    value = np.full(len(g), _leaf(g.sum(), h.sum()))
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            value[:cut] = _tree(g[:cut], h[:cut], depth - 1)
            value[cut:] = _tree(g[cut:], h[cut:], depth - 1)
    return value


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut of both axes of a table: its four values, and what they gain."""
    total_g, total_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(t):
        a = t[:-1, :-1]
        b = t[:-1, -1:] - a
        c = t[-1:, :-1] - a
        return a, b, c, t[-1, -1] - a - b - c

    gain = sum(_gain(x, y) for x, y in zip(parts(total_g), parts(total_h)))
    if not gain.size:
        return np.zeros_like(g), 0.0
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for columns in (slice(0, j + 1), slice(j + 1, None)):
            value[rows, columns] = _leaf(g[rows, columns].sum(), h[rows, columns].sum())
    return value, float(gain[i, j])


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(_probability(z), 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


@dataclass
class AdditiveModel:
    """Lookup tables by feature and by pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if self.tables:
            fine = _binned(x, self.edges)
            for j, table in enumerate(self.tables):
                z += table[fine[:, j]]
            if self.pairs:
                coarse = _binned(x, self.coarse)
                for (i, j), table in self.pairs.items():
                    z += table[coarse[:, i], coarse[:, j]]
        return _probability(z)


def fit(x: np.ndarray, y: np.ndarray, check: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the rows outside ``check``; rows in it choose the rounds."""
    learn = ~check
    if not len(y) or y.min() == y.max() or not learn.any() or y[learn].min() == y[learn].max():
        mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 1e-3
        return AdditiveModel(base=float(np.log(mean / (1 - mean))))
    mean = y[learn].mean()
    model = AdditiveModel(base=float(np.log(mean / (1 - mean))))
    model.edges = [_edges(x[learn, j], BINS) for j in range(x.shape[1])]
    model.coarse = [_edges(x[learn, j], COARSE) for j in range(x.shape[1])]
    fine, coarse = _binned(x, model.edges), _binned(x, model.coarse)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.base)

    def sums(place, size):
        p = _probability(z[learn])
        return (
            np.bincount(place[learn], weights=y[learn] - p, minlength=size),
            np.bincount(place[learn], weights=p * (1 - p), minlength=size),
        )

    def boost(rounds, steps, tables):
        """Run ``steps`` in turn; go back to the best round for the checked rows."""
        nonlocal z
        best, best_tables, best_z = np.inf, [t.copy() for t in tables], z.copy()
        for _ in range(rounds):
            for step in steps:
                step()
            loss = _loss(z[check], y[check]) if check.any() else -1.0
            if loss < best:
                best, best_tables, best_z = loss, [t.copy() for t in tables], z.copy()
        for table, kept in zip(tables, best_tables):
            table[:] = kept
        z = best_z

    def one(j):
        def step():
            update = RATE * _tree(*sums(fine[:, j], len(model.tables[j])))
            model.tables[j] += update
            z[:] += update[fine[:, j]]

        return step

    boost(ROUNDS, [one(j) for j in range(x.shape[1])], model.tables)

    def cells(i, j):
        shape_ = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        place = coarse[:, i] * shape_[1] + coarse[:, j]
        g, h = sums(place, shape_[0] * shape_[1])
        return place, g.reshape(shape_), h.reshape(shape_)

    screened = sorted(
        ((_quadrants(*cells(i, j)[1:])[1], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True
    )
    model.pairs = {(i, j): np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)) for _, i, j in screened[:PAIRS]}

    def two(i, j):
        def step():
            place, g, h = cells(i, j)
            update = RATE * _quadrants(g, h)[0]
            model.pairs[i, j] += update
            z[:] += update.ravel()[place]

        return step

    boost(PAIR_ROUNDS, [two(i, j) for i, j in model.pairs], list(model.pairs.values()))
    return model


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, texts in small_slices(batch, 1):
            found = text_features(texts)
            yield pa.record_batch(
                [rows.column(0), rows.column(2), rows.column(3), *[pa.array(found[:, j]) for j in range(found.shape[1])]],
                names=["doc_id", "label", "part", *SHAPE],
            )


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """A model from about ``fit_rows`` labelled rows; only their features come to the driver."""
    labelled = with_labels(docs, training_rows(labels, label, fit_rows)).select("doc_id", "text", "label", "part")
    schema = "doc_id bigint, label double, part int, " + ", ".join(f"{name} double" for name in SHAPE)
    rows = labelled.mapInArrow(_sample_features, schema).toPandas().sort_values(["doc_id", *SHAPE], kind="stable")
    return fit(rows[SHAPE].to_numpy(float), rows["label"].to_numpy(float), rows["part"].to_numpy() == 2)


def _scores(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in small_slices(batch, 1):
                yield pa.record_batch(
                    [rows.column(0), pa.array(model.score(text_features(texts)))], names=["doc_id", "score"]
                )

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    model = learn(docs, labels, fit_rows=fit_rows)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return keyed.mapInArrow(_scores(model), "doc_id bigint, score double").select(
        "doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
