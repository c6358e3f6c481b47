"""Vectors of whole numbers, and sums of their products without rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def all_finite(embedding: str) -> Column:
    """Not null, and every component there and finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & finite, F.lit(False))


def whole(embedding: str, scale: int = 256) -> Column:
    """floor(scale * c) of each component as a double; beyond the range of a long the nearest end of it."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * float(scale)).cast("bigint"))


def by_length(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix of int64) for each length of the lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        yield places, values[starts[places][:, None] + np.arange(length)]


def largest(x: np.ndarray) -> int:
    """The largest absolute number, as one that never overflows."""
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def fits_double(a: int, b: int, terms: int) -> bool:
    """Whether sums of so many products of numbers up to ``a`` and ``b`` are exact as doubles."""
    return a * b * max(terms, 1) < 1 << 53


def products(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """a b^T: doubles if they are exact (``plain``), Python's whole numbers otherwise."""
    if plain:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return a.astype(object) @ b.astype(object).T


def as_longs(values: np.ndarray) -> np.ndarray:
    """Whole numbers as int64; beyond the range of a long the nearest end of it."""
    if values.dtype == object:
        return np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in values], np.int64)
    return values.astype(np.int64)
