"""Dotted version numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritlens.functions.lists import let


def parts(version: Column) -> Column:
    """Numbers between the dots; anything that is no number counts as 0."""
    digits = F.split(F.regexp_replace(version, "[^0-9.]", ""), "[.]", -1)
    return F.transform(
        digits, lambda x: F.coalesce(x.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    )


def less_than(left: Column, right: Column) -> Column:
    a, b = parts(left), parts(right)
    zero = F.lit(0).cast("decimal(38,0)")

    def padded(x, other):
        return F.concat(x, F.array_repeat(zero, F.greatest(F.size(other) - F.size(x), F.lit(0))))

    return padded(a, b) < padded(b, a)


def key(version: Column) -> Column:
    """Numbers without zeros at the end: arrays of versions compare as the versions do, equal ones are equal."""

    def trimmed(numbers):
        last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
        return F.slice(numbers, F.lit(1), last.cast("int"))

    return let(parts(version), trimmed)
