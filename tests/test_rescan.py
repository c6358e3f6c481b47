from pyspark.sql import functions as F

from gritlens.operators import history, rescan, scoring, security, standing

SCHEMA = "repo string, file_path string, content string"
FIRST = [("r1", "a.js", "eval(x)\neval(y)"), ("r1", "b.js", "ok()"), ("r2", "c.py", "x = 1"), ("r3", "d.js", "eval(z)"), (None, "n.js", "eval(x)")]
SECOND = [("r1", "a.js", "eval(x)"), ("r1", "b.js", "ok()"), ("r2", "c.py", "x = 1"), ("r4", "e.js", "eval(z)"), (None, "n.js", "eval(x)")]


def full(files):
    return sorted(scoring.scan_totals(security.scan_items(files)).collect(), key=repr)


def ids(found):
    return sorted(r.finding_id for r in found.collect())


def test_changed_files_only(spark, tmp_path):
    path = str(tmp_path / "scans")
    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in (FIRST, SECOND))
    rescan.rescan(first, path, 0)
    assert sorted(rescan.totals(spark, path, 0).collect(), key=repr) == full(first)
    for _ in range(2):  # a run may run again
        rescan.rescan(second, path, 1)
        assert sorted(rescan.totals(spark, path, 1).collect(), key=repr) == full(second)
        assert ids(rescan.findings(spark, path, 1)) == ids(security.findings(second))
    scanned = {(r.file_path, r.scanned_in) for r in spark.read.parquet(f"{path}/files/run=1").collect()}
    assert scanned == {("a.js", 1), ("e.js", 1), ("b.js", 0), ("c.py", 0), ("n.js", 0)}
    assert {(r.file_path, r.status) for r in rescan.changes(spark, path, 1).collect()} == {
        ("a.js", "CHANGED"), ("e.js", "ADDED"), ("d.js", "REMOVED")}
    rescan.rescan(second.limit(0), path, 2)
    assert rescan.totals(spark, path, 2).count() == rescan.findings(spark, path, 2).count() == 0
    # the earlier run can still be read
    assert ids(rescan.findings(spark, path, 1)) == ids(security.findings(second))


def test_rows_of_one_path(spark, tmp_path):
    """A repeated row counts once; of two contents of a path the one with the larger digest does."""
    path = str(tmp_path / "scans")
    rows = [("r", "a.js", "eval(x)", "1"), ("r", "a.js", "eval(x)", "1"), ("r", "b.js", "eval(x)", "1"), ("r", "b.js", "ok()", "2")]
    files = spark.createDataFrame(rows, SCHEMA + ", digest string")
    rescan.rescan(files, path, 0)
    row = rescan.totals(spark, path, 0).first()
    assert (row.total_files, row.high) == (2, 1) and rescan.findings(spark, path, 0).count() == 1
    rescan.rescan(files.where("digest = '1'"), path, 1)
    row = rescan.totals(spark, path, 1).first()
    assert (row.total_files, row.high) == (2, 2)
    assert {(r.file_path, r.status) for r in rescan.changes(spark, path, 1).collect()} == {("b.js", "CHANGED")}


def test_own_digests_spare_contents(spark, tmp_path):
    """Which files changed is found without reading contents."""
    spark.createDataFrame([("r", "a.js", "x", "1")], SCHEMA + ", digest string").write.parquet(str(tmp_path / "t"))
    files = rescan.with_digest(security.with_scan_id(spark.read.parquet(str(tmp_path / "t"))))
    plan = files.groupBy(*rescan.KEY).agg(F.max("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "digest" in plan.split("ReadSchema")[1] and "content" not in plan.split("ReadSchema")[1]


def test_kept_sums(spark):
    """Kept dashboard and rollup are those of all scans, over replaced, deleted and new ones, null and lost repositories."""
    schema = "scan_id string, repo string, overall int, critical bigint, high bigint, started_at timestamp"

    def scans(rows):
        return spark.createDataFrame(rows, "n int, repo string, overall int, critical bigint, high bigint").select(
            F.concat(F.lit("s"), "n").alias("scan_id"), "repo", "overall", "critical", "high",
            F.timestamp_seconds(F.col("n") * 1000).alias("started_at"),
        )

    kept = [(1, "a", 50, 1, 2), (2, "b", 90, 0, 0)]
    before = [(3, "a", 70, 4, 1), (4, "c", 10, 9, 9), (5, None, 33, 1, 1)]
    after = [(3, "a", 20, 5, None), (6, "d", 61, 1, 1), (7, "d", 62, 2, 2), (5, None, 44, 2, 1)]
    first, later = scans(kept + before), scans(kept + after)
    sums = standing.repository_sums_after(standing.repository_sums(first), scans(before), scans(after))
    assert sums.where("repo = 'c'").count() == 0
    assert standing.dashboard(sums).first() == scoring.dashboard_totals(later).first()
    rollup = standing.rollup_after(history.repository_rollup(first), scans(before), scans(after), later)
    assert sorted(rollup.collect(), key=repr) == sorted(history.repository_rollup(later).collect(), key=repr)
    none = spark.createDataFrame([], schema)
    assert standing.dashboard(standing.repository_sums(none)).first() == scoring.dashboard_totals(none).first()
