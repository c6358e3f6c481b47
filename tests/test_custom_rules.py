"""Rules from a table: what they find, and what is no rule."""

import pytest

from gritlens.operators import custom_rules, security

FILES = [
    ("r", "a.js", "x = TODO_AUTH()\n// todo_auth later\ny = 1"), ("r", "b.py", "TODO_AUTH\nskip TODO_AUTH ok"),
    ("r", "c.txt", "fetch('http://Ä.internal/x')\n"), ("r", "d.js", None), ("r", "e.js", ""),
]
RULE = dict(severity="HIGH", category=None, title="t", description="d", recommendation="r", cwe="CWE-1", owasp=None, scope=None, anchors=None, unless=None)


def rules(spark, *rows):
    names = [part.split()[0] for part in custom_rules.RULE_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple((RULE | row).get(n) for n in names) for row in rows], custom_rules.RULE_COLUMNS)


def scanned(spark, *rows):
    files = spark.createDataFrame(FILES, "repo string, file_path string, content string")
    return custom_rules.custom_findings(files, rules(spark, *rows))


def places(found):
    return sorted((r.rule_id, r.file_path, r.line_no) for r in found.collect())


def test_rules_from_a_table(spark):
    found = scanned(
        spark, {"rule_id": "A", "anchors": ["TODO_auth"], "pattern": "(?i)todo_auth", "unless": "ok$"},
        {"rule_id": "B", "scope": "js", "anchors": ["todo_auth"], "pattern": r"\bTODO_AUTH\s*\("},
        {"rule_id": "C", "anchors": ["ä.internal"], "pattern": r"http://[^/']+\.internal", "severity": "LOW"},
    )
    assert places(found) == [("A", "a.js", 1), ("A", "a.js", 2), ("A", "b.py", 1), ("B", "a.js", 1), ("C", "c.txt", 1)]
    row = found.where("rule_id = 'C'").first()
    assert (row.severity, row.category, row.title, row.cwe, row.method, row.code_snippet) == (
        "LOW", "SECURITY", "t", "CWE-1", "CUSTOM", "fetch('http://Ä.internal/x')")


def test_shape_and_ids(spark):
    found = scanned(spark, {"rule_id": "A", "pattern": "."})
    files = spark.createDataFrame(FILES, "repo string, file_path string, content string")
    both = security.findings(files).unionByName(found)
    assert both.columns == found.columns
    ids = [r.finding_id for r in found.collect()]
    assert len(ids) == len(set(ids)) == 6
    assert scanned(spark).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("row", [
    {"rule_id": None, "pattern": "x"}, {"rule_id": "J01", "pattern": "x"}, {"rule_id": "A", "pattern": None}, {"rule_id": "A", "pattern": "("},
    {"rule_id": "A", "pattern": "x", "scope": "cobol"}, {"rule_id": "A", "pattern": "x", "severity": "BAD"}, {"rule_id": "A", "pattern": "x", "unless": "["},
])
def test_no_rules(spark, row):
    with pytest.raises(ValueError):
        scanned(spark, row)


def test_bounds(spark):
    many = rules(spark, *[{"rule_id": f"A{i}", "pattern": "x"} for i in range(4)])
    assert len(custom_rules.read_rules(many, 4)) == 4
    with pytest.raises(ValueError):
        custom_rules.read_rules(many, 3)
    with pytest.raises(ValueError):
        custom_rules.read_rules(rules(spark, {"rule_id": "A", "pattern": "x"}, {"rule_id": "A", "pattern": "y"}))
