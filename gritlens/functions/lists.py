"""Small helpers over array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once inside a lambda and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_as_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
