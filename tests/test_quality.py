"""Quality rules against a line-by-line fold written for this test."""

import random
import re

from gritlens.operators import quality, security
from gritlens.rules import catalogue as C


def fold(text):
    """(rule, line, value) of a file, counted one line after the other."""
    found = []
    start, name, length, branches = None, "", 0, 1
    for number, line in enumerate(text.split("\n"), 1):
        t = line.strip()
        if not t or t.startswith(("//", "#", "/*", "*")):
            continue
        m = re.search(C.FUNCTION_START, line)
        if m:
            if start and length > 45:
                found.append(("Q01", start, f"Excessive Function Length ({name})", length))
            start, name, length, branches = number, next((g for g in m.groups() if g), "anonymous"), 0, 1
        if start:
            length += 1
            branches += bool(re.search(C.BRANCH, line))
            if branches >= 10 and number == start + 15:
                found.append(("Q02", start, f"High Cyclomatic Complexity ({name}: CC {branches})",
                              "HIGH" if branches >= 15 else "MEDIUM"))
    return found


def random_file(rng, n):
    kinds = ["function f{}(a) {{", "def g{}(a):", "const h{} = async (a) =>", "  if (a) {{ b(); }}", "  while (a || b)",
             "  x = {}", "// note", "# note", " * more", "", "   "]
    weights = [rng.choice([1, 2, 4]), 1, 1, rng.choice([5, 30, 60]), 10, 30, 4, 4, 2, 5, 2]
    return "\n".join(rng.choices(kinds, weights)[0].format(i) for i in range(n))


def test_functions_equal_the_fold(spark):
    rng = random.Random(3)
    texts = {f"f{i}.js": random_file(rng, rng.randint(1, 220)) for i in range(300)}
    files = spark.createDataFrame([("r", p, t) for p, t in texts.items()], "repo string, file_path string, content string")
    expected = set()
    for path, text in texts.items():
        for rule, line, title, value in fold(text):
            expected.add((path, rule, line, title, value if rule == "Q02" else "MEDIUM"))
    found = security.findings(files, security=False)
    rows = {(f.file_path, f.rule_id, f.line_no, f.title, f.severity) for f in found.collect() if f.rule_id in ("Q01", "Q02")}
    assert rows == expected
    assert {r[1] for r in rows} == {"Q01", "Q02"} and {r[4] for r in rows} == {"HIGH", "MEDIUM"}


def test_last_function_is_never_too_long(scan_text):
    body = "function f() {\n" + "x = 1\n" * 60
    assert not any(f.rule_id == "Q01" for f in scan_text(("a.js", body)))
    found = [f for f in scan_text(("a.js", body + "function g() {")) if f.rule_id == "Q01"]
    assert [(f.line_no, f.code_snippet) for f in found] == [(1, "function f() ... [61 lines]")]


def test_comment_density_text(scan_text):
    """Ties of the one-decimal text go up, as 1 of 80 (1.25) shows."""
    text = "\n".join(["x = 1"] * 80 + ["// c"])
    found = [f for f in scan_text(("a.js", text)) if f.rule_id == "Q05"]
    assert found[0].description == "File has 80 lines of code but only 1 lines of comments (1.3% doc ratio)."
    assert not any(f.rule_id == "Q05" for f in scan_text(("a.js", "\n".join(["x = 1"] * 50))))
    assert not any(f.rule_id == "Q05" for f in scan_text(("a.js", "\n".join(["x = 1"] * 60 + ["# c"] * 3))))


def test_first_empty_catch_and_all_debug(scan_text):
    text = "} catch (e) {}\nconsole.log(1)\n// debugger;\nexcept: pass\ndebugger;"
    found = sorted((f.rule_id, f.line_no) for f in scan_text(("a.js", text), security=False))
    assert found == [("Q03", 1), ("Q04", 2), ("Q04", 5)]


def test_empty_and_missing_content(spark):
    files = spark.createDataFrame([("r", "a.js", ""), ("r", "b.js", None)], "repo string, file_path string, content string")
    assert security.findings(files).count() == 0
    stats = quality.line_statistics(files).collect()
    assert {(s.code_lines, s.comment_lines) for s in stats} == {(0, 0)}
