"""Running sums that hold when one key has most of the rows.

Joins need nothing of the kind: adaptive execution measures both sides, sends the
small one to every task and splits the partitions of hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritlens.session import written

LARGE = 100_000  # rows of a group that one task numbers; larger groups are cut into stretches


def running_totals(
    df: DataFrame,
    group: list[str],
    order: list[str],
    totals: dict[str, Column],
) -> DataFrame:
    """Add running sums within ``group`` in ``order``, without one task per group.

    The rows are range-partitioned by group and order, so a group of any size is
    cut into consecutive stretches, and written out so that both uses below see
    the same stretches. Each stretch is summed, the sums of the stretches before
    it become its offset (one row per group and stretch), and a window runs
    within each stretch only. ``order`` must identify a row within its group.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn(
        "_stretch", F.spark_partition_id()
    )
    for name, value in totals.items():
        ranged = ranged.withColumn(f"_add_{name}", value.cast("bigint"))
    ranged = written(ranged, "running-totals")

    stretch_keys = [*group, "_stretch"]
    earlier = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*stretch_keys).agg(
        *[F.sum(f"_add_{name}").alias(f"_sum_{name}") for name in totals]
    )
    offsets = sums.select(
        *stretch_keys,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0).cast("bigint")).alias(f"_off_{name}")
            for name in totals
        ],
    )
    within = Window.partitionBy(*stretch_keys).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    joined = ranged.join(offsets, stretch_keys)
    for name in totals:
        joined = joined.withColumn(
            name, F.col(f"_off_{name}") + F.sum(f"_add_{name}").over(within)
        )
    return joined.select(*df.columns, *totals)


def row_numbers(df: DataFrame, group: str, order: list[str], name: str, large: int = LARGE) -> DataFrame:
    """Rows with their place in their group, from 1, in ``order``; rows without a group go.

    The rows are shuffled once. Groups of up to ``large`` rows are numbered by a window.
    Larger ones, told by a count before, are sorted over all tasks and cut into stretches;
    a row's place is its distance from the first row of its group and stretch, and the
    rows before. There is one such first row for each stretch and large group, so they fit
    a broadcast.
    """
    rows = df.where(F.col(group).isNotNull())
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    hot = written(counts.where(F.col("_n") > large).select(group), "large-groups")
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("bigint")
    if hot.isEmpty():
        return rows.withColumn(name, place)
    few = rows.join(F.broadcast(hot), group, "left_anti").withColumn(name, place)
    many = rows.join(F.broadcast(hot), group, "left_semi")
    ranged = many.repartitionByRange(*[F.col(c) for c in [group, *order]]).sortWithinPartitions(group, *order)
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "stretches")
    ranged = ranged.withColumn("_stretch", F.shiftright("_at", 33))  # the task that numbered the row
    firsts = ranged.groupBy(group, "_stretch").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint"))).drop("_n")
    placed = ranged.join(F.broadcast(firsts), [group, "_stretch"]).withColumn(
        name, F.col("_at") - F.col("_first") + F.col("_before") + 1
    )
    return few.unionByName(placed.select(*df.columns, name)).select(*df.columns, name)
