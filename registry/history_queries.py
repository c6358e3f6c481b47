"""Scan history over scans made of orders and findings made of line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import history, reports, search_index
from gritlens.session import scratch_path
from gritlens.sources import sinks
from registry import corpora as C
from registry.base import query, table

BRIEF = ["scan_id", "repo", "user_id", "status", "overall", "started_at"]
BRIEF_SQL = ", ".join(BRIEF)


@query("scan_upsert", f"""WITH {C.SCANS_SQL},
incoming AS (SELECT 'scan-' || (CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 1000000 END) AS scan_id, 'late' AS repo,
    'COMPLETED' AS status, CAST(o_orderkey % 100 AS INTEGER) AS overall, o_orderdate + INTERVAL 1 DAY AS started_at FROM orders)
SELECT coalesce(s.scan_id, i.scan_id) AS scan_id, coalesce(s.repo, i.repo) AS repo, coalesce(i.status, s.status) AS status,
  coalesce(i.overall, s.overall) AS overall, coalesce(s.started_at, i.started_at) AS started_at
FROM scans s FULL JOIN incoming i ON s.scan_id = i.scan_id""")
def scan_upsert(spark, sf_dir):
    """Known scans take the new status and score, new scans are added."""
    existing = C.scans(spark, sf_dir).select("scan_id", "repo", "status", "overall", "started_at")
    key = F.col("o_orderkey")
    incoming = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("scan-"), F.when(key % 2 == 0, key).otherwise(key + 1_000_000).cast("string")).alias("scan_id"),
        F.lit("late").alias("repo"), F.lit("COMPLETED").alias("status"),
        (key % 100).cast("int").alias("overall"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("started_at"),
    )
    return history.upsert(existing, incoming, "scan_id", ["status", "overall"], "started_at")


@query("finding_insert", f"""WITH {C.FINDINGS_SQL},
stored AS (SELECT finding_id FROM findings WHERE line_no % 3 = 0)
SELECT finding_id, scan_id, severity FROM findings WHERE finding_id NOT IN (SELECT finding_id FROM stored)""")
def finding_insert(spark, sf_dir):
    """Findings already stored are left alone, repeated arrivals count once."""
    all_findings = C.stored_findings(spark, sf_dir).select("finding_id", "scan_id", "severity", "line_no")
    stored = all_findings.where(F.col("line_no") % 3 == 0)
    again = all_findings.where(F.col("line_no") % 2 == 0).withColumn("severity", F.lit("LATER"))
    incoming = all_findings.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2)))
    return history.insert_ignore(stored, incoming, "finding_id", "seq").select("finding_id", "scan_id", "severity")


@query("findings_replaced", f"""WITH {C.FINDINGS_SQL},
again AS (SELECT DISTINCT scan_id FROM findings WHERE line_no % 5 = 0)
SELECT finding_id, scan_id, CASE WHEN scan_id IN (FROM again) THEN 'LATER' ELSE severity END AS severity FROM findings
WHERE scan_id NOT IN (FROM again) OR line_no % 2 = 0""")
def findings_replaced(spark, sf_dir):
    """Scans saved again: their findings are replaced, not added to."""
    found = C.stored_findings(spark, sf_dir).select("finding_id", "scan_id", "severity", "line_no")
    saved = found.where(F.col("line_no") % 5 == 0).select("scan_id")
    incoming = found.where(F.col("line_no") % 2 == 0).join(saved.distinct(), "scan_id", "left_semi")
    replaced = history.replace_findings(found, incoming.withColumn("severity", F.lit("LATER")), saved)
    return replaced.select("finding_id", "scan_id", "severity")


@query("scan_history", f"WITH {C.SCANS_SQL} SELECT {BRIEF_SQL} FROM scans ORDER BY started_at DESC, scan_id")
def scan_history(spark, sf_dir):
    return history.newest_first(C.scans(spark, sf_dir).select(*BRIEF))


@query("visible_scans", f"""WITH {C.SCANS_SQL} SELECT {BRIEF_SQL} FROM scans WHERE user_id = 'user-7' OR user_id IS NULL
ORDER BY started_at DESC, scan_id LIMIT 50""")
def visible_scans(spark, sf_dir):
    return history.visible_scans(C.scans(spark, sf_dir).select(*BRIEF), "user-7")


@query("newest_scans", f"WITH {C.SCANS_SQL} SELECT {BRIEF_SQL} FROM scans ORDER BY started_at DESC, scan_id LIMIT 50")
def newest_scans(spark, sf_dir):
    return history.visible_scans(C.scans(spark, sf_dir).select(*BRIEF))


@query("scan_by_id", f"""WITH {C.SCANS_SQL} SELECT {BRIEF_SQL} FROM scans
WHERE scan_id = 'scan-42' AND (user_id = (SELECT user_id FROM scans WHERE scan_id = 'scan-42') OR user_id IS NULL)""")
def scan_by_id(spark, sf_dir):
    return history.scan_by_id(C.scans(spark, sf_dir).select(*BRIEF), "scan-42")


@query("findings_of_scan", f"""WITH {C.FINDINGS_SQL} SELECT finding_id, line_no, severity, title FROM findings
WHERE scan_id = 'scan-42' ORDER BY line_no, finding_id""")
def findings_of_scan(spark, sf_dir):
    found = history.findings_of(C.stored_findings(spark, sf_dir), "scan-42")
    return found.select("finding_id", "line_no", "severity", "title")


@query("repository_rollup", f"""WITH {C.SCANS_SQL} SELECT repo, count(*) AS scan_count,
  arg_max(overall, (started_at, overall)) AS last_score, arg_min(overall, (started_at, overall)) AS first_score FROM scans GROUP BY repo""")
def repository_rollup(spark, sf_dir):
    return history.repository_rollup(C.scans(spark, sf_dir))


REPOSITORIES_SQL = """repositories AS (SELECT 'id-' || c_custkey AS repository_id, 'repo-' || c_custkey AS name, c_mktsegment AS source,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'https://example.org/' || c_custkey END AS url FROM customer)"""


def _repositories(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("id-"), key.cast("string")).alias("repository_id"),
        F.concat(F.lit("repo-"), key.cast("string")).alias("name"),
        F.col("c_mktsegment").alias("source"),
        F.when(key % 4 != 0, F.concat(F.lit("https://example.org/"), key.cast("string"))).alias("url"),
    )


@query("repository_upsert", f"""WITH {REPOSITORIES_SQL},
incoming AS (SELECT 'id-' || (s_suppkey * 2) AS repository_id, 'renamed-' || s_suppkey AS name, 'ZIP' AS source, CAST(NULL AS VARCHAR) AS url FROM supplier
  UNION ALL SELECT 'new-' || n_nationkey, n_name, 'GITHUB', 'u' FROM nation)
SELECT coalesce(r.repository_id, i.repository_id) AS repository_id, coalesce(i.name, r.name) AS name, coalesce(r.source, i.source) AS source,
  CASE WHEN i.repository_id IS NOT NULL THEN i.url ELSE r.url END AS url
FROM repositories r FULL JOIN incoming i ON r.repository_id = i.repository_id""")
def repository_upsert(spark, sf_dir):
    """Known repositories take the new name and URL only."""
    incoming = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("id-"), (F.col("s_suppkey") * 2).cast("string")).alias("repository_id"),
        F.concat(F.lit("renamed-"), F.col("s_suppkey").cast("string")).alias("name"),
        F.lit("ZIP").alias("source"), F.lit(None).cast("string").alias("url"),
    ).unionByName(
        table(spark, sf_dir, "nation").select(
            F.concat(F.lit("new-"), F.col("n_nationkey").cast("string")).alias("repository_id"),
            F.col("n_name").alias("name"), F.lit("GITHUB").alias("source"), F.lit("u").alias("url"),
        )
    )
    existing = _repositories(spark, sf_dir).withColumn("seen", F.lit(0))
    merged = history.upsert(
        existing, incoming.withColumn("seen", F.lit(1)), "repository_id", history.REPOSITORY_UPDATES, "seen"
    )
    return merged.select("repository_id", "name", "source", "url")


@query("repository_listing", f"""WITH {C.SCANS_SQL}, {REPOSITORIES_SQL}
SELECT repository_id, name, source, url, coalesce(s.overall, 85) AS overall_score, coalesce(s.critical, 0) AS critical_issues
FROM repositories r LEFT JOIN scans s ON s.repo = r.name""")
def repository_listing(spark, sf_dir):
    return history.repository_listing(_repositories(spark, sf_dir), C.scans(spark, sf_dir))


@query("repository_files", f"""WITH {REPOSITORIES_SQL},
files AS (SELECT 'repo-' || o_custkey AS repo FROM orders)
SELECT r.*, count(f.repo) AS file_count FROM repositories r LEFT JOIN files f ON f.repo = r.name GROUP BY ALL""")
def repository_files(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("repo-"), F.col("o_custkey").cast("string")).alias("repo")
    )
    return history.sample_listing(_repositories(spark, sf_dir), files)


@query("top_findings", f"""WITH {C.FINDINGS_SQL} SELECT scan_id, finding_id, severity, CAST(n AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY line_no, finding_id) AS n FROM findings) WHERE n <= 3""")
def top_findings(spark, sf_dir):
    top = history.top_findings(C.stored_findings(spark, sf_dir), ["line_no", "finding_id"])
    return top.select("scan_id", "finding_id", "severity", "rank")


@query("nested_scans", f"""WITH {C.SCANS_SQL}, {C.FINDINGS_SQL}, numbered AS (
  SELECT scan_id, finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_no, finding_id) AS number FROM findings)
SELECT scan_id, repo, overall, coalesce(number, 0) AS number, finding_id FROM scans LEFT JOIN numbered USING (scan_id)""")
def nested_scans(spark, sf_dir):
    nested = reports.nested_scans(
        C.scans(spark, sf_dir).select("scan_id", "repo", "overall"), C.stored_findings(spark, sf_dir)
    )
    return nested.select("scan_id", "repo", "overall", "number", F.col("finding.finding_id").alias("finding_id"))


@query("attach_remediation", f"""WITH {C.FINDINGS_SQL}
SELECT finding_id, CASE WHEN line_no % 4 = 0 THEN 'new ' || title WHEN line_no % 3 = 0 THEN 'old' END AS remediation FROM findings""")
def attach_remediation(spark, sf_dir):
    found = C.stored_findings(spark, sf_dir)
    stored = found.select(
        "finding_id", F.when(F.col("line_no") % 3 == 0, F.lit("old")).alias("remediation")
    )
    new = found.where(F.col("line_no") % 4 == 0).select(
        "finding_id", F.concat(F.lit("new "), F.col("title")).alias("remediation")
    )
    return history.attach_remediation(stored, new)


@query("report_lookup", f"""WITH {C.SCANS_SQL}
SELECT 'report-' || scan_id AS report_id, scan_id, overall AS overall_score, CASE WHEN critical = 0 THEN 85 ELSE overall END AS stored_overall,
  CASE WHEN critical = 0 THEN 80 ELSE security END AS stored_security, CAST(CASE WHEN critical = 0 THEN 0 ELSE critical END AS BIGINT) AS critical_findings
FROM scans""")
def report_lookup(spark, sf_dir):
    """Stored reports; those without a summary show the defaults."""
    scans = C.scans(spark, sf_dir)
    stored = scans.select(
        F.concat(F.lit("report-"), F.col("scan_id")).alias("report_id"), "scan_id", "repo",
        F.col("overall").alias("overall_score"), F.lit("text").alias("executive_summary"),
        F.when(F.col("critical") > 0, F.struct(
            F.struct("overall", "security", "quality", "maintainability", "documentation").alias("scores"),
            F.struct(*[F.col(c).cast("int").alias(c) for c in ("critical", "high", "medium", "low", "info")]).alias("severity_counts"),
            F.col("high").alias("total_findings"), "critical",
        )).alias("findings_summary"),
    )
    return history.report_lookup(stored).select(
        "report_id", "scan_id", "overall_score", F.col("scores.overall").alias("stored_overall"),
        F.col("scores.security").alias("stored_security"), F.col("critical_findings").cast("bigint").alias("critical_findings"),
    )


@query("findings_search", f"""WITH {C.FINDINGS_SQL} SELECT finding_id, severity, category, title FROM findings
WHERE category = 'SECURITY' AND (contains(lower(title), 'eval') OR contains(lower(file_path), 'eval') OR contains(lower(code_snippet), 'eval')
  OR contains(lower(description), 'eval') OR contains(lower(coalesce(node_type, '')), 'eval') OR contains(lower(coalesce(cve, '')), 'eval'))""")
def findings_search(spark, sf_dir):
    found = history.search_findings(C.stored_findings(spark, sf_dir), "EVAL", category="SECURITY")
    return found.select("finding_id", "severity", "category", "title")


@query("findings_search_cve", f"""WITH {C.FINDINGS_SQL} SELECT finding_id, severity, category, cve FROM findings
WHERE severity = 'HIGH' AND contains(lower(coalesce(cve, '')), 'cve-2021')""")
def findings_search_cve(spark, sf_dir):
    found = history.search_findings(C.stored_findings(spark, sf_dir), "cve-2021", severity="HIGH")
    return found.select("finding_id", "severity", "category", F.col("dependency_info.cve").alias("cve"))


@query("findings_search_indexed", f"""WITH {C.FINDINGS_SQL} SELECT finding_id, severity, category, title FROM findings
WHERE (contains(lower(title), 'njection') OR contains(lower(file_path), 'njection') OR contains(lower(code_snippet), 'njection')
  OR contains(lower(description), 'njection') OR contains(lower(coalesce(node_type, '')), 'njection') OR contains(lower(coalesce(cve, '')), 'njection'))""")
def findings_search_indexed(spark, sf_dir):
    """A text looked up by the triples of its characters; only findings that have all of them are read."""
    path = scratch_path(spark, "search-index")
    search_index.write_index(C.stored_findings(spark, sf_dir), path)
    return search_index.search(spark, path, "nJection").select("finding_id", "severity", "category", "title")


@query("stored_scans", f"""WITH {C.SCANS_SQL} SELECT scan_id, repo, overall, CAST(started_at AS DATE) AS day FROM scans
WHERE CAST(started_at AS DATE) >= DATE '1998-01-01'""")
def stored_scans(spark, sf_dir):
    """Scans written by month and read back; the date filter prunes folders."""
    path = scratch_path(spark, "scans")
    sinks.write_scans(C.scans(spark, sf_dir), path, period="month")
    stored = spark.read.parquet(path).where(F.col("scan_date") >= F.lit("1998-01-01").cast("date"))
    return stored.select("scan_id", "repo", "overall", F.to_date("started_at").alias("day"))
