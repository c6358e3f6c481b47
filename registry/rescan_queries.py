"""Second scans and sums kept up to date; both equal what is worked out anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import history, rescan, standing
from gritlens.session import scratch_path, written
from registry import corpora as C
from registry.base import query
from registry.rule_queries import KEPT_SQL
from registry.score_queries import TOTALS_SQL

# At first every thirteenth file is not there yet; then every eleventh is gone and every seventh has
# its rule line once more at its end.
FIRST_SQL = f"""{C.SEEDED_SQL.replace("files AS (", "seeded AS (", 1)},
before AS (SELECT * FROM seeded WHERE doc_id % 13 <> 0)"""
SECOND_SQL = f"""{C.SEEDED_SQL.replace("files AS (", "seeded AS (", 1)},
files AS (SELECT s.repo, s.file_path, s.doc_id, CASE WHEN s.doc_id % 7 = 0 THEN s.content || chr(10) || p.snippet ELSE s.content END AS content
  FROM seeded s JOIN snippets p ON s.doc_id % {C.COUNT} = p.i WHERE s.doc_id % 11 <> 0)"""


def _scanned_twice(spark, sf_dir) -> str:
    """The folder of two runs."""
    doc_id = F.regexp_extract("file_path", r"doc_(\d+)\.", 1).cast("bigint")
    files = written(C.seeded_files(spark, sf_dir).withColumn("doc_id", doc_id), "seeded")
    again = F.concat("content", F.lit("\n"), F.substring_index("content", "\n", 1))
    second = files.where(F.col("doc_id") % 11 != 0).withColumn(
        "content", F.when(F.col("doc_id") % 7 == 0, again).otherwise(F.col("content"))
    )
    path = scratch_path(spark, "rescan")
    rescan.rescan(files.where(F.col("doc_id") % 13 != 0), path, 0)
    rescan.rescan(second, path, 1)
    return path


@query("rescan_changes", f"""WITH {FIRST_SQL},
listed AS (SELECT *, CASE WHEN doc_id % 13 = 0 AND doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'ADDED'
    WHEN doc_id % 11 = 0 THEN 'REMOVED' WHEN doc_id % 7 = 0 THEN 'CHANGED' END AS status FROM seeded)
SELECT 'scan-' || repo AS scan_id, file_path, status FROM listed WHERE status IS NOT NULL""")
def rescan_changes(spark, sf_dir):
    """What the second of two scans took for new, changed and gone."""
    return rescan.changes(spark, _scanned_twice(spark, sf_dir), 1)


@query("rescan_totals", TOTALS_SQL.replace(C.SEEDED_SQL, SECOND_SQL, 1))
def rescan_totals(spark, sf_dir):
    """Totals after a scan of changed files only: those of a full scan."""
    return rescan.totals(spark, _scanned_twice(spark, sf_dir), 1)


@query("rescan_findings", f"""WITH {SECOND_SQL}, {KEPT_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id, severity FROM kept""")
def rescan_findings(spark, sf_dir):
    """Security findings, of the second scan and carried over from the first."""
    found = rescan.findings(spark, _scanned_twice(spark, sf_dir), 1)
    line_rules = ~F.col("rule_id").rlike("^[QD]")
    return found.where(line_rules).select("repo", "file_path", "line_no", "rule_id", "severity")


# Every seventh scan is saved again with other numbers, every eleventh is deleted.
LATER_SQL = f"""{C.SCANS_SQL.replace("scans AS (", "earlier AS (", 1)},
scans AS (SELECT scan_id, repo, CASE WHEN key % 7 = 0 THEN 100 - overall ELSE overall END AS overall,
    CASE WHEN key % 7 = 0 THEN critical + 3 ELSE critical END AS critical, high, started_at
  FROM (SELECT *, CAST(substr(scan_id, 6) AS BIGINT) AS key FROM earlier) WHERE key % 11 <> 0)"""


def _saved_again(spark, sf_dir):
    """Scans at first, and of the touched ones the rows before and after."""
    key = F.substring_index("scan_id", "-", -1).cast("bigint")
    first = C.scans(spark, sf_dir).select("scan_id", "repo", "overall", "critical", "high", "started_at")
    before = first.where((key % 7 == 0) | (key % 11 == 0))
    after = before.where(key % 11 != 0).withColumns({"overall": 100 - F.col("overall"), "critical": F.col("critical") + 3})
    return first, before, after


@query("dashboard_kept", f"""WITH {LATER_SQL}
SELECT count(*) AS total_scans, count(DISTINCT repo) AS unique_repos, CAST(sum(critical) AS BIGINT) AS total_critical,
  CAST(sum(high) AS BIGINT) AS total_high, CAST(floor(avg(overall) + 0.5) AS INTEGER) AS average_score FROM scans""")
def dashboard_kept(spark, sf_dir):
    """The dashboard from kept sums after scans were replaced and deleted."""
    first, before, after = _saved_again(spark, sf_dir)
    stored = written(standing.repository_sums(first), "repository-sums")
    return standing.dashboard(standing.repository_sums_after(stored, before, after))


@query("rollup_kept", f"""WITH {LATER_SQL} SELECT repo, count(*) AS scan_count,
  arg_max(overall, (started_at, overall)) AS last_score, arg_min(overall, (started_at, overall)) AS first_score FROM scans GROUP BY repo""")
def rollup_kept(spark, sf_dir):
    """The rollup of repositories after scans were replaced and deleted; untouched ones keep their row."""
    first, before, after = _saved_again(spark, sf_dir)
    stored = written(history.repository_rollup(first), "rollup")
    now = first.join(before.select("scan_id"), "scan_id", "left_anti").unionByName(after)
    return standing.rollup_after(stored, before, after, now)
