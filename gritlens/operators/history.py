"""Scan history: upserts, look-ups, rollups and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritlens.session import written

SCAN_UPDATES = ["status", "scores", "severity_counts", "completed_at"]
REPOSITORY_UPDATES = ["name", "url"]
REPORT_UPDATES = ["overall_score", "executive_summary", "findings_summary"]
VISIBLE_SCANS = 50

# What a stored report shows where nothing was stored.
REPORT_DEFAULTS = {
    "scores": {"overall": 85, "security": 80, "quality": 85, "maintainability": 90, "documentation": 80},
    "severity_counts": {"critical": 0, "high": 0, "medium": 0, "low": 0, "info": 0},
}
LISTING_SCORE, LISTING_CRITICAL = 85, 0


def upsert(
    existing: DataFrame, incoming: DataFrame, key: str, updates: list[str], arrived: str
) -> DataFrame:
    """Insert new keys; for known keys replace ``updates`` only.

    The first row of a key gives the other columns, the last one the updates.
    Both are aggregates that combine before the shuffle, so a key that arrives
    very often costs one row per task.
    """
    kept = [c for c in existing.columns if c != key and c not in updates]
    rows = existing.withColumn("_seq", F.struct(F.lit(0).alias("n"), F.col(arrived))).unionByName(
        incoming.select(*existing.columns).withColumn(
            "_seq", F.struct(F.lit(1).alias("n"), F.col(arrived))
        )
    )
    merged = rows.groupBy(key).agg(
        F.min_by(F.struct(*kept), F.col("_seq")).alias("_first"),
        F.max_by(F.struct(*updates), F.col("_seq")).alias("_last"),
    )
    return merged.select(
        *[
            F.col(key) if c == key else F.col(f"_last.{c}") if c in updates else F.col(f"_first.{c}")
            for c in existing.columns
        ]
    )


def merge_table(
    path: str, incoming: DataFrame, key: str, updates: list[str], arrived: str, partition: str
) -> None:
    """Upsert into a partitioned Parquet table, rewriting touched partitions only."""
    spark = incoming.sparkSession
    table = spark.read.parquet(path)
    touched = (
        table.join(incoming.select(key), key, "left_semi").select(partition)
        .union(incoming.select(partition)).distinct()
    )
    current = table.join(touched, partition, "left_semi").select(*table.columns)
    merged = written(upsert(current, incoming, key, updates, arrived), "merge")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).parquet(path)


def insert_ignore(
    existing: DataFrame, incoming: DataFrame, key: str, arrived: str, folder: tuple[str, Column] | None = None
) -> DataFrame:
    """The incoming rows to append: first arrival of every key not yet stored.

    ``folder`` names the column that the stored table is partitioned by and gives its
    value for an incoming row. Where a key always lies in one folder, as finding ids
    in that of their scan, only folders that the batch touches are read.
    """
    columns = incoming.columns
    first = (
        incoming.groupBy(key)
        .agg(F.min_by(F.struct(*columns), F.col(arrived)).alias("_row"))
        .select("_row.*")
    )
    if folder:
        name, value = folder
        # no more values than the table has folders
        touched = [row[0] for row in incoming.select(value).distinct().collect()]
        existing = existing.where(F.col(name).isin(touched))
    return first.join(existing.select(key), key, "left_anti").select(*columns)


def replace_findings(existing: DataFrame, incoming: DataFrame, saved: DataFrame) -> DataFrame:
    """Stored findings after the scans in ``saved`` were saved again: theirs give way to the incoming ones."""
    kept = existing.join(saved.select("scan_id").distinct(), "scan_id", "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def newest_first(scans: DataFrame) -> DataFrame:
    return scans.orderBy(F.desc("started_at"), "scan_id")


def visible_scans(scans: DataFrame, user_id: str | None = None, limit: int = VISIBLE_SCANS) -> DataFrame:
    """The newest scans; with a user only their own and those without an owner."""
    if user_id is not None:
        scans = scans.where((F.col("user_id") == user_id) | F.col("user_id").isNull())
    return newest_first(scans).limit(limit)


def scan_by_id(scans: DataFrame, scan_id: str, user_id: str | None = None) -> DataFrame:
    found = scans.where(F.col("scan_id") == scan_id)
    if user_id is not None:
        found = found.where((F.col("user_id") == user_id) | F.col("user_id").isNull())
    return found


def findings_of(findings: DataFrame, scan_id: str) -> DataFrame:
    return findings.where(F.col("scan_id") == scan_id).orderBy("line_no", "finding_id")


def top_findings(findings: DataFrame, order: list[str], k: int = 3) -> DataFrame:
    """The first ``k`` findings of every scan in stored order."""
    rank = F.row_number().over(Window.partitionBy("scan_id").orderBy(*order))
    return findings.withColumn("rank", rank).where(F.col("rank") <= k)


def repository_rollup(scans: DataFrame) -> DataFrame:
    """Scans per repository with its newest and its oldest score.

    Time and score (0 to 100) share one number, so that the sums fit a hash
    aggregate. Of scans started at the same time the higher score is the newest
    and the lower one the oldest.
    """
    moment = F.unix_micros(F.col("started_at").cast("timestamp")) * 128 + F.col("overall")
    return scans.groupBy("repo").agg(
        F.count("*").alias("scan_count"),
        F.pmod(F.max(moment), F.lit(128)).cast("int").alias("last_score"),
        F.pmod(F.min(moment), F.lit(128)).cast("int").alias("first_score"),
    )


def repository_listing(repositories: DataFrame, scans: DataFrame) -> DataFrame:
    """Repositories with the scores of their scans, defaults where there are none.

    Repositories are the kept side; a repository with very many scans is split
    by adaptive execution.
    """
    named = scans.select(F.col("repo").alias("name"), "overall", "critical")
    return repositories.join(named, "name", "left").select(
        *repositories.columns,
        F.coalesce("overall", F.lit(LISTING_SCORE)).alias("overall_score"),
        F.coalesce("critical", F.lit(LISTING_CRITICAL)).alias("critical_issues"),
    )


def attach_remediation(findings: DataFrame, remediation: DataFrame, arrived: str | None = None) -> DataFrame:
    """New remediation text by finding id; findings without one keep theirs.

    Of several texts for a finding the one with the largest ``arrived`` counts,
    without such a column the last in order of text.
    """
    newest = F.max_by("remediation", F.col(arrived)) if arrived else F.max("remediation")
    new = remediation.where(F.col("remediation").isNotNull()).groupBy("finding_id").agg(newest.alias("_new"))
    return (
        findings.join(new, "finding_id", "left")
        .withColumn("remediation", F.coalesce("_new", "remediation"))
        .select(*findings.columns)
    )


def report_lookup(reports: DataFrame, scan_id: str | None = None) -> DataFrame:
    """Stored reports (of one scan) with defaults for what was not stored."""
    found = reports if scan_id is None else reports.where(F.col("scan_id") == scan_id)
    summary = "findings_summary"

    def defaults(name):
        return F.struct(*[F.lit(v).alias(k) for k, v in REPORT_DEFAULTS[name].items()])

    return found.select(
        "report_id", "scan_id", "repo", "overall_score", "executive_summary",
        F.coalesce(F.col(f"{summary}.scores"), defaults("scores")).alias("scores"),
        F.coalesce(F.col(f"{summary}.severity_counts"), defaults("severity_counts")).alias("severity_counts"),
        F.coalesce(F.col(f"{summary}.total_findings"), F.lit(0)).alias("total_findings"),
        F.coalesce(F.col(f"{summary}.critical"), F.lit(0)).alias("critical_findings"),
    )


SEARCHED = ["title", "file_path", "code_snippet", "description", "node_type", "cve"]


def search_findings(
    findings: DataFrame, query: str = "", severity: str = "ALL", category: str = "ALL"
) -> DataFrame:
    """Filter by severity, category and a text in any of the searched columns."""
    if severity != "ALL":
        findings = findings.where(F.col("severity") == severity)
    if category != "ALL":
        findings = findings.where(F.col("category") == category)
    if not query.strip():
        return findings
    columns = dict.fromkeys(SEARCHED)
    if "cve" not in findings.columns and "dependency_info" in findings.columns:
        columns["cve"] = F.col("dependency_info.cve")
    tests = [
        F.coalesce(F.contains(F.lower(col if col is not None else F.col(name)), F.lit(query.lower())), F.lit(False))
        for name, col in columns.items()
        if col is not None or name in findings.columns
    ]
    return findings.where(reduce(lambda a, b: a | b, tests))


def sample_listing(repositories: DataFrame, files: DataFrame) -> DataFrame:
    """Repositories with their file counts."""
    counts = files.groupBy(F.col("repo").alias("name")).agg(F.count("*").alias("file_count"))
    return repositories.join(counts, "name", "left").select(
        *repositories.columns, F.coalesce("file_count", F.lit(0)).alias("file_count")
    )
