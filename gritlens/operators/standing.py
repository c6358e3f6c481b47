"""Sums that are kept up to date by what a batch adds and what it withdraws.

A replaced row is its old state withdrawn and its new one added. A batch so becomes a
table of differences, as long as the groups it touches, and never has to read
the rows that it leaves alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.operators.history import repository_rollup
from gritlens.operators.scoring import SCORE_WITHOUT_SCANS

REPOSITORY_SUMS = ["n_scans", "critical", "high", "overall"]


def summed(rows: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in measures])


def withdrawn(rows: DataFrame, measures: list[str]) -> DataFrame:
    """The rows as what they take away from their sums."""
    return rows.withColumns({c: -F.col(c) for c in measures})


def differences(before: DataFrame, after: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """What sums by ``by`` gain when the rows ``before`` give way to the rows ``after``."""
    rows = withdrawn(before.select(*by, *measures), measures).unionByName(after.select(*by, *measures))
    return summed(rows, by, measures)


def merged(stored: DataFrame, gained: DataFrame, by: list[str], measures: list[str], rows: str) -> DataFrame:
    """Stored sums with differences added; groups whose number of rows falls to 0 go."""
    both = stored.select(*by, *measures).unionByName(gained.select(*by, *measures))
    return summed(both, by, measures).where(F.col(rows) > 0)


def _counted(scans: DataFrame) -> DataFrame:
    return scans.withColumn("n_scans", F.lit(1).cast("bigint"))


def repository_sums(scans: DataFrame) -> DataFrame:
    """What the dashboard adds up, by repository: of a hot one one row per task travels."""
    return summed(_counted(scans), ["repo"], REPOSITORY_SUMS)


def repository_sums_after(stored: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``repository_sums`` after the scans ``before`` became ``after`` (either may hold scans that the other lacks)."""
    gained = differences(_counted(before), _counted(after), ["repo"], REPOSITORY_SUMS)
    return merged(stored, gained, ["repo"], REPOSITORY_SUMS, "n_scans")


def dashboard(sums: DataFrame) -> DataFrame:
    """``scoring.dashboard_totals`` from ``repository_sums``: no scan is read and nothing is counted apart."""
    mean = F.floor(F.sum("overall") / F.sum("n_scans") + F.lit(0.5)).cast("int")
    return sums.agg(
        F.coalesce(F.sum("n_scans"), F.lit(0)).cast("bigint").alias("total_scans"),
        F.count_if(F.col("repo").isNotNull()).alias("unique_repos"),
        F.coalesce(F.sum("critical"), F.lit(0)).cast("bigint").alias("total_critical"),
        F.coalesce(F.sum("high"), F.lit(0)).cast("bigint").alias("total_high"),
        F.coalesce(mean, F.lit(SCORE_WITHOUT_SCANS)).alias("average_score"),
    )


def rollup_after(stored: DataFrame, before: DataFrame, after: DataFrame, scans: DataFrame) -> DataFrame:
    """``history.repository_rollup`` after the scans ``before`` became ``after``; ``scans`` are all scans now.

    The first and the last score can't be withdrawn, so touched repositories are made
    anew from their scans and the others keep their row.
    """
    touched = before.select("repo").union(after.select("repo")).distinct().select(F.col("repo").alias("_touched"))
    same = F.col("repo").eqNullSafe(F.col("_touched"))
    kept = stored.join(touched, same, "left_anti")
    return kept.unionByName(repository_rollup(scans.join(touched, same, "left_semi")))
