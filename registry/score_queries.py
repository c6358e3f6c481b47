"""Severity counts, penalties, scores and bands of scanned repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import scoring, security
from registry import corpora as C
from registry.base import query
from registry.rule_queries import KEPT_SQL

COUNTS_SQL = ", ".join(
    f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in scoring.SEVERITIES
)
WEIGHT_SQL = "CASE severity WHEN 'CRITICAL' THEN 22 WHEN 'HIGH' THEN 12 WHEN 'MEDIUM' THEN 6 ELSE 2 END"
PENALTY_SQL = ", ".join(
    f"CAST(coalesce(sum({WEIGHT_SQL}) FILTER (category = '{c}'), 0) AS BIGINT) AS {name}_penalty"
    for name, (c, _) in scoring.SCORED.items()
)


@query("findings_by_severity", f"""WITH {C.SEEDED_SQL}, {KEPT_SQL} SELECT repo, {COUNTS_SQL} FROM (SELECT DISTINCT repo FROM files) LEFT JOIN kept USING (repo) GROUP BY repo""")
def findings_by_severity(spark, sf_dir):
    """Flagship: from files to severity counts per repository, clean ones included.

    The row of each file has no severity: it counts nowhere and keeps its repository.
    """
    items = security.scan_items(C.seeded_files(spark, sf_dir), quality=False, advisories=None)
    return scoring.severity_counts(security.graded(items), "repo")


@query("penalty_sums", f"""WITH {C.FINDINGS_SQL}, {C.SCANS_SQL}
SELECT scan_id, {PENALTY_SQL} FROM (SELECT scan_id FROM scans) LEFT JOIN findings USING (scan_id) GROUP BY scan_id""")
def penalty_sums(spark, sf_dir):
    """Penalties of every scan; one without findings has none."""
    sums = scoring.penalties(C.stored_findings(spark, sf_dir), "scan_id")
    return scoring.for_all_scans(C.scans(spark, sf_dir), sums)


@query("stored_severity_counts", f"""WITH {C.FINDINGS_SQL}, {C.SCANS_SQL}
SELECT scan_id, {COUNTS_SQL} FROM (SELECT scan_id FROM scans) LEFT JOIN findings USING (scan_id) GROUP BY scan_id""")
def stored_severity_counts(spark, sf_dir):
    """Counts of every scan; one without findings has five zeros."""
    counts = scoring.severity_counts(C.stored_findings(spark, sf_dir), "scan_id")
    return scoring.for_all_scans(C.scans(spark, sf_dir), counts)


SCORES_SQL = """CAST(greatest(10, least(100, floor(CAST(s AS DOUBLE) * CAST(0.4 AS DOUBLE) + CAST(q AS DOUBLE) * CAST(0.3 AS DOUBLE)
  + CAST(m AS DOUBLE) * CAST(0.2 AS DOUBLE) + CAST(d AS DOUBLE) * CAST(0.1 AS DOUBLE) + CAST(0.5 AS DOUBLE)))) AS INTEGER) AS overall,
  CAST(s AS INTEGER) AS security, CAST(q AS INTEGER) AS quality, CAST(m AS INTEGER) AS maintainability, CAST(d AS INTEGER) AS documentation"""
CLAMPED_SQL = """SELECT *, greatest(10, least(100, 100 - coalesce(security_penalty, 0))) AS s, greatest(15, least(100, 100 - coalesce(quality_penalty, 0))) AS q,
  greatest(20, least(100, 100 - coalesce(maintainability_penalty, 0))) AS m, greatest(20, least(100, 100 - coalesce(documentation_penalty, 0))) AS d"""


@query("scores_of_scans", f"""WITH {C.FINDINGS_SQL}, {C.SCANS_SQL}, p AS (SELECT scan_id, {PENALTY_SQL} FROM findings GROUP BY scan_id),
c AS ({CLAMPED_SQL} FROM (SELECT scan_id FROM scans) LEFT JOIN p USING (scan_id))
SELECT scan_id, {SCORES_SQL} FROM c""")
def scores_of_scans(spark, sf_dir):
    """Scores of stored scans; a scan without findings scores 100."""
    sums = scoring.penalties(C.stored_findings(spark, sf_dir), "scan_id")
    return scoring.with_scores(scoring.for_all_scans(C.scans(spark, sf_dir), sums)).select("scan_id", *scoring.SCORE_NAMES)


QUALITY_SQL = f"""quality AS (SELECT repo, file_path, line_no, trimmed, line FROM tested WHERE trimmed <> '' AND NOT regexp_matches(trimmed, '^(//|#|/\\*|\\*)')),
debug AS (SELECT repo, 'LOW' AS severity, 'CODE_QUALITY' AS category FROM quality WHERE regexp_matches(line, '(console\\.log\\(|print\\("DEBUG|debugger;)')),
caught AS (SELECT repo, 'MEDIUM' AS severity, 'CODE_QUALITY' AS category FROM quality
  WHERE regexp_matches(line, '(catch\\s*\\([^)]*\\)\\s*\\{{\\s*\\}}|except\\s*:\\s*pass)')
  QUALIFY row_number() OVER (PARTITION BY repo, file_path ORDER BY line_no) = 1),
sparse AS (SELECT repo, 'LOW' AS severity, 'DOCUMENTATION' AS category FROM (
  SELECT repo, file_path, count(*) FILTER (regexp_matches(trimmed, '^(//|#|/\\*|\\*)')) AS comments,
    count(*) FILTER (trimmed <> '' AND NOT regexp_matches(trimmed, '^(//|#|/\\*|\\*)')) AS code FROM tested GROUP BY repo, file_path)
  WHERE code > 50 AND CAST(comments AS DOUBLE) / code < 0.05),
everything AS (SELECT repo, severity, category FROM kept UNION ALL FROM debug UNION ALL FROM caught UNION ALL FROM sparse)"""
TOTALS_SQL = f"""WITH {C.SEEDED_SQL}, {KEPT_SQL}, {QUALITY_SQL},
p AS (SELECT repo, {COUNTS_SQL}, {PENALTY_SQL} FROM everything GROUP BY repo),
v AS (SELECT repo, count(*) AS total_files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines FROM files GROUP BY repo),
c AS ({CLAMPED_SQL} FROM v LEFT JOIN p USING (repo))
SELECT 'scan-' || repo AS scan_id, repo, total_files, total_lines, critical, high, medium, low, info, {SCORES_SQL} FROM c"""


@query("scan_totals", TOTALS_SQL)
def scan_totals(spark, sf_dir):
    """The whole scan, security and quality."""
    return scoring.scan_totals(security.scan_items(C.seeded_files(spark, sf_dir)))


@query("score_bands", f"""WITH {C.SCANS_SQL}
SELECT scan_id, CASE WHEN security >= 80 THEN 'STRONG' WHEN security >= 60 THEN 'MODERATE' ELSE 'CRITICAL' END AS security_band,
  CASE WHEN quality >= 80 THEN 'STRONG' ELSE 'NEEDS IMPROVEMENT' END AS quality_band,
  CASE WHEN maintainability >= 80 THEN 'OPTIMAL' ELSE 'REFACTOR RECOMMENDED' END AS maintainability_band,
  CASE WHEN documentation >= 80 THEN 'DOCUMENTED' ELSE 'SPARSE' END AS documentation_band,
  CASE WHEN overall >= 80 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'poor' END AS dashboard_band FROM scans""")
def score_bands(spark, sf_dir):
    bands = [band.alias(f"{name}_band") for name, band in scoring.report_bands().items()]
    return C.scans(spark, sf_dir).select(
        "scan_id", *bands, scoring.dashboard_band(F.col("overall")).alias("dashboard_band")
    )


@query("dashboard_totals", f"""WITH {C.SCANS_SQL}
SELECT count(*) AS total_scans, count(DISTINCT repo) AS unique_repos, CAST(sum(critical) AS BIGINT) AS total_critical,
  CAST(sum(high) AS BIGINT) AS total_high, CAST(floor(avg(overall) + 0.5) AS INTEGER) AS average_score FROM scans""")
def dashboard_totals(spark, sf_dir):
    return scoring.dashboard_totals(C.scans(spark, sf_dir))
