"""Whitening of embeddings; components by QDWH spectral divide and conquer.

Components become whole numbers x, so sums of x and of products of x are added
without any rounding (whole numbers of any size), over each distinct x once, and the
covariance (n * sum(x y) - sum(x) * sum(y)) / n^2 is rounded once, at its division:
the same as centring first, with nothing lost to it. The sums are added up in tasks, in
two steps, so that neither the driver nor one task gets those of all tasks.

The covariance is split as follows. The polar factor U of V - s*1 (dynamically
weighted Halley iterations, by QR and then by Cholesky) has the eigenvalues 1 and -1;
(U + 1) / 2 projects on the space that belongs to eigenvalues above s. Bases of it
and of its complement part V in two smaller matrices, which are split in turn until
each is a number: an eigenvalue, its basis the component. Only parts that can hold
one of the wanted first components are split on.

Every row is then projected by a broadcast of the mean and the few components of its
length. The covariance of what comes out, over the distinct vectors, is computed
from the results (merged by mean and squares) and compared with the identity.

Rules for odd rows: vectors that are null or hold a null or non-finite entry are
dropped, empty ones have no component; ids may be null or repeat, each row has its own
result. Vectors of different lengths are fitted and whitened apart. A component whose
eigenvalue is zero (to double precision) has no direction of its own: whitened is
null, and identity_error leaves it out (null if none is left); explained is null
when all vectors are equal. ``deviation`` is null where it doesn't fit a long,
``deviation_exact`` where it doesn't fit 38 digits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.exact import all_finite, by_length, fits_double, largest, whole
from gritlens.llm.store import Stage

SLOTS = 64                  # tasks that add up the sums of all tasks, before one per length does
MODEL_BYTES = 256 << 20     # means and components of all lengths, at most
EPS = np.finfo(np.float64).eps
PARTIAL = "dims int, slot int, sums binary"


# ---- polar factor and splitting ----------------------------------------------------------

def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix without eigenvalues near 0."""
    m = len(a)
    one = np.eye(m)
    x = a / np.linalg.norm(a)
    # a lower bound of the least singular value, from the triangular factor
    r = np.linalg.qr(x, mode="r")
    least = np.abs(np.diag(r)).min()
    low = EPS if least == 0 else max(EPS, min(1.0, 1 / (np.linalg.norm(np.linalg.inv(r)) or 1.0)))
    for _ in range(20):
        squared = low * low
        d = np.cbrt(4 * (1 - squared) / (squared * squared))
        root = np.sqrt(1 + d)
        a_ = root + np.sqrt(np.maximum(8 - 4 * d + 8 * (2 - squared) / (squared * root), 0)) / 2
        b = (a_ - 1) ** 2 / 4
        c = a_ + b - 1
        low = min(1.0, low * (a_ + b * squared) / (1 + c * squared))
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, one]))
            new = (b / c) * x + (a_ - b / c) / np.sqrt(c) * (q[:m] @ q[m:].T)
        else:
            factor = np.linalg.cholesky(one + c * (x.T @ x))
            new = (b / c) * x + (a_ - b / c) * np.linalg.solve(factor.T, np.linalg.solve(factor, x.T)).T
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(5 * EPS) and 1 - low <= 5 * EPS:
            break
    return x


def _divided(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, that of larger eigenvalues first; None if all are equal."""
    m = len(a)
    mean = np.trace(a) / m
    spread = np.linalg.norm(a - mean * np.eye(m)) / np.sqrt(m)
    if spread <= 4 * EPS * size:
        return None
    rng, best, least = np.random.default_rng(0), None, np.inf
    # the mean lies between the least and the largest eigenvalue; others in case it is one itself
    for step in (0, 0.37, -0.29, 0.61, -0.53, 0.11, -0.17, 0.83, -0.79):
        projector = (polar_factor(a - (mean + step * spread) * np.eye(m)) + np.eye(m)) / 2
        above = int(round(np.trace(projector)))
        if not 0 < above < m:
            continue
        upper, lower = rng.standard_normal((m, above)), rng.standard_normal((m, m - above))
        for _ in range(2):
            upper, _ = np.linalg.qr(projector @ upper)
            lower, _ = np.linalg.qr(lower - projector @ lower)
        basis, _ = np.linalg.qr(np.hstack([upper, lower]))
        upper, lower = basis[:, :above], basis[:, above:]
        left = np.linalg.norm(lower.T @ a @ upper)
        if left < least:
            best, least = (upper, lower), left
        if left <= 10 * m * EPS * size:
            break
    return best


def components(a: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns): the first ``wanted`` of a symmetric matrix."""
    size = np.linalg.norm(a)
    values, vectors = [], []
    parts = [(a, np.eye(len(a)))]
    while parts and len(values) < wanted:
        part, basis = parts.pop(0)
        halves = _divided(part, size) if len(part) > 1 else None
        if halves is None:
            for i in range(len(part)):
                v = basis[:, i] / np.linalg.norm(basis[:, i])
                values.append(float(v @ a @ v)), vectors.append(v)
            continue
        below = [((h.T @ part @ h + (h.T @ part @ h).T) / 2, basis @ h) for h in halves]
        # the lower half is split on only as far as the upper one has too few
        parts[:0] = below if len(values) + len(below[0][0]) < wanted else below[:1]
    order = sorted(range(len(values)), key=lambda i: -values[i])[:wanted]
    return np.array([values[i] for i in order]), np.array([vectors[i] for i in order]).reshape(len(order), len(a)).T


# ---- sums of all tasks -------------------------------------------------------------------

def _exact_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype != object and b.dtype != object and largest(a) + largest(b) < 1 << 62:
        return a + b
    return a.astype(object) + b.astype(object)


def _added(a: tuple, b: tuple) -> tuple:
    """Sums of two sets of rows: (n, sums, sums of products)."""
    return a[0] + b[0], _exact_sum(a[1], b[1]), _exact_sum(a[2], b[2])


def _moments(x: np.ndarray) -> tuple:
    """(n, sums, sums of products) of rows of whole numbers."""
    most = largest(x)
    if fits_double(most, most, len(x)):
        doubles = x.astype(np.float64)
        return len(x), x.sum(axis=0), (doubles.T @ doubles).astype(np.int64)
    x = x.astype(object)
    return len(x), x.sum(axis=0), x.T @ x


def _merged(a: tuple, b: tuple) -> tuple:
    """Means and centred products of two sets of rows: (n, mean, products)."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _centred(y: np.ndarray) -> tuple:
    mean = y.mean(axis=0)
    return len(y), mean, (y - mean).T @ (y - mean)


def _per_task(numbers: Callable, add: Callable):
    """One row of sums per task and length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple] = {}
        for batch in batches:
            for _, x in by_length(batch.column("x")):
                length = x.shape[1]
                new = numbers(x)
                total[length] = add(total[length], new) if length in total else new
        slot = TaskContext.get().partitionId() % SLOTS
        for length, sums in total.items():
            yield pa.record_batch(
                [pa.array([length], pa.int32()), pa.array([slot], pa.int32()), pa.array([pickle.dumps(sums)], pa.binary())],
                names=["dims", "slot", "sums"],
            )

    return run


def _together(add: Callable, finish: Callable | None = None):
    def run(table: pa.Table) -> pa.Table:
        total = None
        for blob in table.column("sums"):
            sums = pickle.loads(blob.as_py())
            total = sums if total is None else add(total, sums)
        done = finish(total) if finish else total
        return pa.table({
            "dims": table.column("dims").slice(0, 1), "slot": table.column("slot").slice(0, 1),
            "sums": pa.array([pickle.dumps(done)], pa.binary()),
        })

    return run


def _summed(rows: DataFrame, numbers: Callable, add: Callable, finish: Callable) -> dict[int, object]:
    """What ``finish`` makes of the sums of all rows, by length of vectors."""
    tasks = rows.mapInArrow(_per_task(numbers, add), PARTIAL)
    slots = tasks.groupBy("dims", "slot").applyInArrow(_together(add), PARTIAL)
    return {r["dims"]: pickle.loads(r["sums"]) for r in slots.groupBy("dims").applyInArrow(_together(add, finish), PARTIAL).collect()}


# ---- the operator ------------------------------------------------------------------------

class Model:
    """n, sums, trace, eigenvalues and components of the vectors of one length."""

    def __init__(self, n, sums, trace, values, vectors):
        self.n, self.sums, self.trace, self.values, self.vectors = n, sums, trace, values, vectors
        self.there = values > 4 * EPS * len(sums) * max(trace, 0)

    @staticmethod
    def solve(wanted: int):
        def finish(total: tuple) -> tuple:
            n, sums, products = total
            s = [int(v) for v in sums]
            v = np.empty((len(s), len(s)))
            for i in range(len(s)):
                for j in range(i + 1):
                    v[i, j] = v[j, i] = (n * int(products[i, j]) - s[i] * s[j]) / (n * n)
            trace = sum(n * int(products[i, i]) - s[i] * s[i] for i in range(len(s))) / (n * n)
            values, vectors = components(v, min(wanted, len(s)))
            return n, s, trace, values, vectors

        return finish

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, whole."""
        if (largest(x) * self.n + max(map(abs, self.sums), default=0)) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for components without a variance."""
        centred = (self.deviations(x) / self.n).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.there, (centred @ self.vectors) / np.sqrt(np.where(self.there, self.values, 1)), np.nan)


def _loaded(models: dict[int, tuple]) -> dict[int, Model]:
    return {length: Model(*parts) for length, parts in models.items()}


def _squares(deviations: np.ndarray) -> list[int]:
    most = largest(deviations) if deviations.dtype != object else 1 << 63
    if most * most * max(deviations.shape[1], 1) < 1 << 62:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = deviations.astype(object)
    return [int(v) for v in (exact * exact).sum(axis=1)]


RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double, deviation_exact decimal(38,0)"
)
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.decimal128(38, 0)]
_NAMES = [part.split()[0] for part in RESULT.split(", ")]


def _projected(models: dict[int, tuple], errors: dict[int, float | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = _loaded(models)
        for batch in batches:
            ids = batch.column("vec_id")
            for places, x in by_length(batch.column("x")):
                model = loaded[x.shape[1]]
                k = len(model.values)
                y = model.whiten(x)
                squares = _squares(model.deviations(x))
                explained = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)
                nan_null = lambda v: pa.array(v, pa.float64(), from_pandas=True)
                rows = np.repeat(places, k)
                yield pa.record_batch(
                    [
                        ids.take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                        pa.array(np.full(len(rows), model.n), pa.int64()),
                        pa.array([s if s < 1 << 63 else None for s in squares for _ in range(k)], pa.int64()),
                        nan_null(y.ravel()), nan_null(np.tile(explained, len(x))),
                        pa.array([errors[x.shape[1]]] * len(rows), pa.float64()),
                        pa.array([Decimal(s) if s < 10**38 else None for s in squares for _ in range(k)], pa.decimal128(38, 0)),
                    ],
                    schema=pa.schema(list(zip(_NAMES, _TYPES))),
                )

    return run


def whitened(embeddings: DataFrame, wanted: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact)."""
    stage = Stage(embeddings.sparkSession, "whitening")
    rows = stage.keep(
        embeddings.filter(all_finite("embedding") & (F.size("embedding") > 0))
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), whole("embedding", scale).alias("x")),
        "rows",
    )
    lengths = rows.select(F.size("x").cast("bigint").alias("dims")).distinct().agg(F.sum("dims")).first()[0] or 0
    if lengths * 8 * (wanted + 5) > MODEL_BYTES:
        raise ValueError(f"vectors of lengths that add up to {lengths}: too many models to broadcast")
    fit = stage.keep(rows.select("x").distinct(), "fit")
    models = _summed(fit, _moments, _added, Model.solve(wanted))

    def own(x: np.ndarray) -> tuple:
        model = Model(*models[x.shape[1]])
        return _centred(np.nan_to_num(model.whiten(x)))

    def error(total: tuple) -> np.ndarray:
        return total[2] / total[0]

    errors: dict[int, float | None] = {}
    for length, covariance in _summed(fit, own, _merged, error).items():
        there = Model(*models[length]).there
        apart = np.abs(covariance - np.eye(len(there)))[np.ix_(there, there)]
        errors[length] = float(apart.max()) if apart.size else None
    stage.drop(fit)
    return rows.mapInArrow(_projected(models, errors), RESULT)
