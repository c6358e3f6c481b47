import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gritlens.operators import history, remediation, reports
from gritlens.sources import sinks


def test_upsert_keeps_first_and_takes_last(spark):
    old = spark.createDataFrame([("a", "r1", "RUNNING", 1), ("b", "r2", "DONE", 1)], "id string, repo string, status string, seq int")
    new = spark.createDataFrame([("a", "x", "DONE", 2), ("c", "r3", "RUNNING", 2), ("c", "r4", "DONE", 3)], old.schema)
    rows = {tuple(r)[:3] for r in history.upsert(old, new, "id", ["status"], "seq").collect()}
    assert rows == {("a", "r1", "DONE"), ("b", "r2", "DONE"), ("c", "r3", "DONE")}


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "scans")
    start = datetime(2024, 1, 1)
    rows = [(f"s{n}", "RUNNING", start + timedelta(days=n % 5), f"d{n % 5}") for n in range(50)]
    schema = "scan_id string, status string, started_at timestamp, day string"
    spark.createDataFrame(rows, schema).write.partitionBy("day").parquet(path)
    untouched = {p.name for p in (tmp_path / "scans" / "day=d3").iterdir()}
    new = spark.createDataFrame([("s1", "DONE", start, "d9"), ("n1", "RUNNING", start, "d4")], schema)
    history.merge_table(path, new, "scan_id", ["status"], "started_at", "day")
    stored = {r.scan_id: (r.status, r.day) for r in spark.read.parquet(path).collect()}
    assert len(stored) == 51 and stored["s1"] == ("DONE", "d1") and stored["n1"] == ("RUNNING", "d4")
    assert {p.name for p in (tmp_path / "scans" / "day=d3").iterdir()} == untouched


def test_insert_ignore(spark):
    old = spark.createDataFrame([("a", 0, "old")], "id string, seq int, v string")
    new = spark.createDataFrame([("a", 1, "new"), ("b", 2, "second"), ("b", 1, "first")], old.schema)
    assert [tuple(r) for r in history.insert_ignore(old, new, "id", "seq").collect()] == [("b", 1, "first")]


def test_insert_ignore_reads_touched_folders_only(spark, tmp_path):
    """Finding ids lie in the folder of their scan: other folders stay unread, the result is the same."""
    path = str(tmp_path / "findings")
    schema = "finding_id string, scan_id string, seq int"
    old = spark.createDataFrame([(f"s{n % 40}-f{n}", f"s{n % 40}", 0) for n in range(400)], schema)
    sinks.write_findings(old, path)
    new = spark.createDataFrame([("s3-f3", "s3", 1), ("s3-new", "s3", 2), ("s3-new", "s3", 1), ("s99-f0", "s99", 1)], schema)
    stored = spark.read.parquet(path)
    found = history.insert_ignore(stored, new, "finding_id", "seq", ("scan_bucket", sinks.scan_bucket(F.col("scan_id"))))
    assert sorted(map(tuple, found.collect())) == [("s3-new", "s3", 1), ("s99-f0", "s99", 1)]
    assert sorted(found.collect()) == sorted(history.insert_ignore(stored, new, "finding_id", "seq").collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "scan_bucket" in plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]


def test_newest_remediation_only(spark):
    found = spark.createDataFrame([("a", "old"), ("b", "kept")], "finding_id string, remediation string")
    new = spark.createDataFrame([("a", "z", 1), ("a", "b", 2), ("a", None, 3)], "finding_id string, remediation string, seq int")
    assert {tuple(r) for r in history.attach_remediation(found, new, "seq").collect()} == {("a", "b"), ("b", "kept")}
    assert {tuple(r) for r in history.attach_remediation(found, new).collect()} == {("a", "z"), ("b", "kept")}


def test_search(spark):
    rows = [("1", "HIGH", "SECURITY", "Eval used", "a.js", "x", "d", None, None), ("2", "LOW", "SECURITY", "t", "EVAL.js", "x", "d", None, None),
            ("3", "HIGH", "CODE_QUALITY", "t", "b.js", "x", "d", None, "CVE-2021-1")]
    names = "finding_id severity category title file_path code_snippet description node_type cve".split()
    found = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))

    def ids(**kw):
        return {r.finding_id for r in history.search_findings(found, **kw).collect()}

    assert ids() == ids(query="  ") == {"1", "2", "3"}
    assert ids(query="eval") == {"1", "2"} and ids(query="cve-2021") == {"3"}
    assert ids(severity="HIGH") == {"1", "3"} and ids(severity="HIGH", category="SECURITY", query="x") == {"1"}


def test_owner_rules(spark):
    now = datetime(2024, 1, 1)
    rows = [(f"s{n}", None if n % 3 == 0 else f"u{n % 3}", now + timedelta(hours=n)) for n in range(90)]
    scans = spark.createDataFrame(rows, "scan_id string, user_id string, started_at timestamp")
    assert history.scan_by_id(scans, "s1", "u2").count() == 0 and history.scan_by_id(scans, "s3", "u2").count() == 1
    mine = [r.scan_id for r in history.visible_scans(scans, "u1").collect()]
    assert len(mine) == 50 and mine[0] == "s88" and all(int(s[1:]) % 3 != 2 for s in mine)


def test_windows_are_limited_before_the_shuffle(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text")
                            ).write.parquet(str(tmp_path / "t"))
    turns = spark.read.parquet(str(tmp_path / "t"))
    plan = remediation.conversation_context(turns)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("WindowGroupLimit") < plan.rindex("WindowGroupLimit")


def test_report_parts_make_one_document(spark):
    scan = spark.createDataFrame(
        [(i, "repo", "COMPLETED", 70, 79, 80, 81, 60, 1, 2, 3, 4, 5, 9, 99, datetime(2024, 3, 1, 4, 5, 6)) for i in ("s1", "s2")],
        "scan_id string, repo string, status string, overall int, security int, quality int, maintainability int, documentation int,"
        "critical int, high int, medium int, low int, info int, total_files int, total_lines int, started_at timestamp")
    rows = [("s1", f"f{n:03d}", "HIGH", "SECURITY", f"T{n}", None, None, "a.js", n, "code", "d", "r") for n in range(57)]
    found = spark.createDataFrame(rows, "scan_id string, finding_id string, severity string, category string, title string, cwe string, owasp string,"
                                  "file_path string, line_no int, code_snippet string, description string, recommendation string")
    rows = reports.markdown_documents(scan, found)
    whole = {}
    for r in reports.in_order(rows).collect():
        whole[r.scan_id] = whole.get(r.scan_id, "") + r.text
    parts = reports.in_parts(rows, 10).orderBy("scan_id", "part_no").collect()
    assert len([p for p in parts if p.scan_id == "s1"]) == 6
    assert "".join(p.text for p in parts if p.scan_id == "s1") == whole["s1"]
    assert "### Finding #57: [HIGH] T56" in whole["s1"] and "Fri, 01 Mar 2024 04:05:06 GMT" in whole["s1"]
    assert "MODERATE" in whole["s2"] and whole["s2"].endswith("*Generated automatically.*\n")
    documents = {}
    for r in reports.in_order(reports.json_documents(scan, found)).collect():
        documents[r.scan_id] = documents.get(r.scan_id, "") + r.text
    parsed = {key: json.loads(text) for key, text in documents.items()}
    assert len(parsed["s1"]["findings"]) == 57 and parsed["s2"]["findings"] == [] and parsed["s1"]["overall"] == 70
    assert reports.nested_scans(scan, found).where("scan_id = 's2' and number = 0 and finding is null").count() == 1


def test_remediation_ladders(spark):
    rows = [
        ("1", "Prototype Pollution & Command Injection in lodash", "CWE-1395: D", "SECURITY", "x", ("lodash", "1", "4.17.21", "CVE")),
        ("2", "Insecure Key Verification in jsonwebtoken", "CWE-1395: D", "SECURITY", "x", ("jsonwebtoken", "1", "9.0.0", "CVE")),
        ("3", "Prototype Pollution in minimist", "CWE-1395: D", "SECURITY", "x", ("minimist", "1", "1.2.6", "CVE")),
        ("4", "Flask debugger", "CWE-489: Active", "SECURITY", "x", None),
        ("5", "Private key", "CWE-798: Creds", "SECURITY", "x", None),
        ("6", "DOM", "CWE-79: XSS", "SECURITY", "a.innerHTML = b.innerHTML", None),
    ]
    schema = ("finding_id string, title string, cwe string, category string, code_snippet string, dependency_info struct<package_name:string,"
              "installed_version:string,fixed_version:string,cve:string>")
    found = spark.createDataFrame(rows, schema).withColumns(
        {"description": F.lit("desc"), "file_path": F.lit("p.js"), "line_no": F.lit(7)})
    title = {r.finding_id: r for r in remediation.remediate_by_title(found).collect()}
    assert [title[i].kind for i in "123456"] == ["execution", "secret", "dependency", "general", "general", "general"]
    assert title["3"].remediated_code.endswith('"minimist": "^1.2.6"') and title["4"].problem_explanation == "desc"
    weak = {r.finding_id: r for r in remediation.remediate_by_weakness(found).collect()}
    assert [weak[i].kind for i in "123456"] == ["command", "dependency", "dependency", "general", "secret", "xss"]
    assert weak["6"].remediated_code == "a.textContent = b.innerHTML"
    assert weak["6"].diff_snippet.split("\n")[2] == "@@ -7,1 +7,1 @@"


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([("f", "HIGH", "s1"), ("g", "LOW", "s2")], "finding_id string, severity string, scan_id string")
    sinks.write_findings(found, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    assert [r.finding_id for r in sinks.read_findings_of(spark, str(tmp_path / "f"), "s2").collect()] == ["g"]
    sinks.write_json(found, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_table(found, str(tmp_path / "t"))
    sinks.write_table(found, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
