import itertools
import json
import re

from pyspark.sql import functions as F

from gritlens.functions import versions
from gritlens.operators import dependencies as D


def less(a, b):
    def parts(v):
        return [int(p) if p else 0 for p in re.sub(r"[^0-9.]", "", v).split(".")]

    x, y = parts(a), parts(b)
    n = max(len(x), len(y))
    return x + [0] * (n - len(x)) < y + [0] * (n - len(y))


def test_version_compare(spark):
    names = ["", "*", "latest", "1", "1.0", "1.0.0", "1.2.3", "v1.2.3", "1.10", "1.9.9", "1..2", "4.17.21", "4.17.21-beta.1", "0.21.1"]
    pairs = list(itertools.product(names, names))
    frame = spark.createDataFrame(pairs, "a string, b string")
    rows = frame.select("a", "b", versions.less_than(F.col("a"), F.col("b")).alias("less")).collect()
    assert [(r.a, r.b) for r in rows if r.less != less(r.a, r.b)] == []


def manifest(**maps):
    return json.dumps(maps, indent=2)


def test_audit_and_scan_report_every_package(spark, scan_text):
    text = manifest(dependencies={"lodash": "4.17.15", "axios": "0.20.0"})
    assert {f.dependency_info.cve for f in scan_text(("package.json", text))} == {"CVE-2021-23337", "CVE-2020-28168"}
    files = spark.createDataFrame([("r", "package.json", text)], "repo string, file_path string, content string")
    audit = D.dependency_findings(files, D.advisories_table(spark)).collect()
    assert {r.item.texts["cve"] for r in audit} == {"CVE-2021-23337", "CVE-2020-28168"}
    row = D.project_audit(files).first()
    assert (row.total_dependencies, row.vulnerable_count) == (2, 2)
    row = D.project_audit(files, D.advisories_table(spark)).first()
    assert (row.total_dependencies, row.vulnerable_count) == (2, 2)


def test_npm_details(scan_text):
    later_wins = manifest(dependencies={"lodash": "4.17.15"}, devDependencies={"Lodash": "1", "lodash": "^4.17.21"})
    found = scan_text(("web/Package.json", later_wins))
    assert [f.title for f in found] == ["Prototype Pollution & Command Injection in lodash (Lodash@1)"]
    null = scan_text(("package.json", '{"dependencies": {"lodash": null}}'))
    assert null[0].code_snippet == '"lodash": "null"' and null[0].dependency_info.installed_version == "null"
    twice = '{"dependencies": {"lodash": "1.0.0", "x": "1", "lodash": "9.9.9"}}'
    assert scan_text(("package.json", twice)) == []
    for broken in ("{", "[]", "null", '{"dependencies": 3}', '{"dependencies": ["lodash"]}'):
        assert scan_text(("package.json", broken)) == []


def test_pip_details(scan_text):
    text = "# requests==1.0\n  Pillow >= 9.0.0,<10\nrequests==2.31.0\nflask[async]==1.0\nFlask~=2.2.4 # x\npyyaml>5"
    found = sorted((f.line_no, f.title) for f in scan_text(("req/dev-requirements.txt", text)))
    assert found == [
        (2, "Denial of Service & Buffer Overflow in Pillow (pillow==9.0.0)"),
        (5, "Session Cookie Disclosure in Flask (flask==2.2.4)"),
    ]


def test_own_advisories_by_join(spark):
    files = spark.createDataFrame(
        [("r", f"p{n}/package.json", manifest(dependencies={"hot": f"1.0.{n}", "other": "1"})) for n in range(30)],
        "repo string, file_path string, content string",
    )
    own = [D.Advisory("npm", "HOT", "1.0.10", "CVE-1", "HIGH", "t", "a", "b"),
           D.Advisory("npm", "hot", "2.0.0", "CVE-2", "LOW", "t", "a", "b")]
    found = D.dependency_findings(files, D.advisories_table(spark, own)).collect()
    assert len(found) == 10 and {r.item.texts["cve"] for r in found} == {"CVE-1"}


def test_every_open_advisory(spark):
    """All advisories of a package whose range holds the version, by hand."""
    files = spark.createDataFrame(
        [("r", "package.json", manifest(dependencies={"Hot": "^1.10.0", "cold": "2"})), ("r", "requirements.txt", "hot==1.2\n")],
        "repo string, file_path string, content string",
    )
    advisories = spark.createDataFrame([
        ("npm", "hot", "1.2", "1.10.1", "open"), ("npm", "HOT", None, "1.10", "fixed"), ("npm", "hot", "1.10", None, "never fixed"),
        ("npm", "hot", "1.10.0.1", "2", "later"), ("npm", "hot", None, None, "always"), ("pypi", "hot", "1.2.0", "1.2.0.1", "pip"),
        ("npm", "cold", "2.0.0", "2.0", "empty range"), (None, "hot", None, None, "none"), ("npm", None, None, None, "none"),
    ], "ecosystem string, package string, introduced string, fixed_version string, cve string")
    found = D.open_advisories(files, advisories).select("dep.ecosystem", "advisory.cve").collect()
    assert sorted(tuple(r) for r in found) == [("npm", "always"), ("npm", "never fixed"), ("npm", "open"), ("pypi", "pip")]
    assert D.open_advisories(files, advisories.limit(0)).count() == 0


def test_version_keys(spark):
    names = ["", "*", "1", "1.0", "1.0.0", "1.2.3", "v1.2.3", "1.10", "1.9.9", "1..2", "0.0.1", "4.17.21-beta.1"]
    frame = spark.createDataFrame(list(itertools.product(names, names)), "a string, b string")
    rows = frame.select("a", "b", (versions.key(F.col("a")) < versions.key(F.col("b"))).alias("less")).collect()
    assert [(r.a, r.b) for r in rows if r.less != less(r.a, r.b)] == []


def test_advisories_are_tested_once_per_version(spark):
    """Intervals meet different versions only; dependencies join by equality."""
    files = spark.createDataFrame(
        [("r", f"p{n}/package.json", manifest(dependencies={"hot": f"1.{n % 3}"})) for n in range(300)],
        "repo string, file_path string, content string",
    )
    advisories = spark.createDataFrame(
        [("npm", "hot", f"1.{n % 3}", f"1.{n % 3 + 1}", f"CVE-{n}") for n in range(60)],
        "ecosystem string, package string, introduced string, fixed_version string, cve string",
    )
    found = D.open_advisories(files, advisories)
    assert found.count() == 300 * 20 and found.distinct().count() == 300 * 20
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join Inner" in line)
    assert "version_key" in join and " < " not in join and "turn" in join
