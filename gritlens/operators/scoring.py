"""Severity counts, penalties, scores, bands and dashboard totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions.text import round_half_up
from gritlens.operators import security

# Severities, penalty weights, score floors, shares and bands.
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
WEIGHTS = {"CRITICAL": 22, "HIGH": 12, "MEDIUM": 6}
OTHER_WEIGHT = 2
SCORED = {  # score: (category, floor)
    "security": ("SECURITY", 10),
    "quality": ("CODE_QUALITY", 15),
    "maintainability": ("MAINTAINABILITY", 20),
    "documentation": ("DOCUMENTATION", 20),
}
SHARES = {"security": 0.4, "quality": 0.3, "maintainability": 0.2, "documentation": 0.1}
OVERALL_FLOOR = 10
SCORE_WITHOUT_SCANS = 85
GOOD, FAIR = 80, 60


def weight(severity: Column) -> Column:
    chain = F.when(severity == "CRITICAL", WEIGHTS["CRITICAL"])
    for name in ("HIGH", "MEDIUM"):
        chain = chain.when(severity == name, WEIGHTS[name])
    return chain.otherwise(OTHER_WEIGHT)


def severity_aggregates() -> list[Column]:
    return [
        F.count_if(F.col("severity") == name).cast("bigint").alias(name.lower())
        for name in SEVERITIES
    ]


def penalty_aggregates() -> list[Column]:
    """Weight sums per scored category; other categories add nothing."""
    return [
        F.coalesce(
            F.sum(F.when(F.col("category") == category, weight(F.col("severity")))), F.lit(0)
        ).cast("bigint").alias(f"{score}_penalty")
        for score, (category, _) in SCORED.items()
    ]


def severity_counts(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*severity_aggregates())


def penalties(findings: DataFrame, *by: str) -> DataFrame:
    return findings.groupBy(*by).agg(*penalty_aggregates())


def for_all_scans(scans: DataFrame, sums: DataFrame) -> DataFrame:
    """Sums by scan for every scan, zeros where there were no findings."""
    joined = scans.select("scan_id").join(sums, "scan_id", "left")
    return joined.na.fill(0, [c for c in sums.columns if c != "scan_id"])


def clamp(value: Column, floor: int) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(100), value))


def with_scores(sums: DataFrame) -> DataFrame:
    """Add the five scores to penalty sums. No findings count as no penalty."""
    sums = sums.withColumns({
        score: clamp(F.lit(100) - F.coalesce(F.col(f"{score}_penalty"), F.lit(0)), floor).cast("int")
        for score, (_, floor) in SCORED.items()
    })
    parts = [F.col(score).cast("double") * F.lit(share) for score, share in SHARES.items()]
    blended = parts[0] + parts[1] + parts[2] + parts[3]
    return sums.withColumn("overall", clamp(round_half_up(blended), OVERALL_FLOOR).cast("int"))


SCORE_NAMES = ["overall", *SCORED]
COUNT_NAMES = [s.lower() for s in SEVERITIES]
ADDED = ["total_files", "total_lines", *COUNT_NAMES, *[f"{name}_penalty" for name in SCORED]]


def _sums(items: DataFrame, *by: str) -> DataFrame:
    """Files, lines, counts and penalties of ``scan_items``; combined before the shuffle.

    The file rows carry the line counts, so clean files are present.
    """
    return security.graded(items).groupBy(*by).agg(
        F.count_if(F.col("rule_no") == security.FILE_ROW).cast("bigint").alias("total_files"),
        F.sum("n_lines").cast("bigint").alias("total_lines"),
        *severity_aggregates(),
        *penalty_aggregates(),
    )


def scored(sums: DataFrame) -> DataFrame:
    """Scan totals from sums by scan."""
    return with_scores(sums).select(
        "scan_id", "repo", "total_files", "total_lines", *COUNT_NAMES, *SCORE_NAMES
    )


def scan_totals(items: DataFrame) -> DataFrame:
    """One row per scan from ``scan_items``: files, lines, counts, scores."""
    return scored(_sums(items, "scan_id", "repo"))


def file_totals(items: DataFrame) -> DataFrame:
    """One row per file with what it adds to the totals of its scan."""
    return _sums(items, "scan_id", "repo", "file_path")


def totals_of_files(files: DataFrame) -> DataFrame:
    """Scan totals from ``file_totals`` of all files."""
    return scored(files.groupBy("scan_id", "repo").agg(*[F.sum(c).cast("bigint").alias(c) for c in ADDED]))


def as_scans(totals: DataFrame, source_type: str = "TABLE") -> DataFrame:
    """Scan rows in the stored form: nested scores and counts, times, status."""
    now = F.current_timestamp()
    return totals.select(
        "scan_id",
        F.lit(None).cast("string").alias("user_id"),
        "repo",
        F.lit(source_type).alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit("COMPLETED").alias("status"),
        F.struct(*[F.col(c).cast("int").alias(c) for c in SCORE_NAMES]).alias("scores"),
        F.struct(*[F.col(c).cast("int").alias(c) for c in COUNT_NAMES]).alias("severity_counts"),
        F.col("total_files").cast("int").alias("total_files"),
        F.col("total_lines").cast("int").alias("total_lines"),
        now.alias("started_at"),
        now.alias("completed_at"),
    )


def report_bands() -> dict[str, Column]:
    """The health words of the report, per score."""

    def two(score, good, poor):
        return F.when(F.col(score) >= GOOD, F.lit(good)).otherwise(F.lit(poor))

    return {
        "security": F.when(F.col("security") >= GOOD, F.lit("STRONG"))
        .when(F.col("security") >= FAIR, F.lit("MODERATE"))
        .otherwise(F.lit("CRITICAL")),
        "quality": two("quality", "STRONG", "NEEDS IMPROVEMENT"),
        "maintainability": two("maintainability", "OPTIMAL", "REFACTOR RECOMMENDED"),
        "documentation": two("documentation", "DOCUMENTED", "SPARSE"),
    }


def dashboard_band(score: Column) -> Column:
    return (
        F.when(score >= GOOD, F.lit("good")).when(score >= FAIR, F.lit("fair")).otherwise(F.lit("poor"))
    )


def dashboard_totals(scans: DataFrame) -> DataFrame:
    """One row over all scans: counts, distinct repositories, mean score."""
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.count_distinct("repo").alias("unique_repos"),
        F.coalesce(F.sum("critical"), F.lit(0)).cast("bigint").alias("total_critical"),
        F.coalesce(F.sum("high"), F.lit(0)).cast("bigint").alias("total_high"),
        F.coalesce(
            F.floor(F.sum("overall") / F.count("*") + F.lit(0.5)).cast("int"),
            F.lit(SCORE_WITHOUT_SCANS),
        ).alias("average_score"),
    )
