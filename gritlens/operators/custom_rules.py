"""Rules that users bring as a table, next to the built-in catalogue.

A row is a rule: what its findings say, where it looks (``scope``: all, js, python or
code) and what it looks for. ``anchors`` are lower-case words of which one must be in
a line before its pattern is tried; without any every line is. The rules become
part of the plan: one search for all anchors lets most lines leave, what is left
is tested by the rules whose anchors it has. Lines are not shuffled, and files are read once.

The number of rules is bounded by ``most``, since each is a part of the plan.
Patterns have the dialect of the catalogue. A rule without a pattern, with one that
is none, with an unknown scope or an id that is taken is an error, not a rule that
finds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.functions import paths
from gritlens.functions import text as X
from gritlens.operators.security import with_scan_id
from gritlens.rules import catalogue as C
from gritlens.rules import compiler
from gritlens.schemas import DEPENDENCY_INFO, FINDING_COLUMNS

RULE_COLUMNS = (
    "rule_id string, severity string, category string, title string, description string, recommendation string, "
    "cwe string, owasp string, scope string, anchors array<string>, pattern string, unless string"
)
MOST = 1000
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def read_rules(rules: DataFrame, most: int = MOST) -> list[C.Rule]:
    """The rows of a table with ``RULE_COLUMNS`` as rules of the last stage, by id."""
    rows = rules.select(*[part.split()[0] for part in RULE_COLUMNS.split(", ")]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules: each is a part of the plan")
    compiled = rules.sparkSession._jvm.java.util.regex.Pattern
    taken = {rule.rule_id for rule in C.RULES}
    found = []
    for row in sorted(rows, key=lambda r: r["rule_id"] or ""):
        name = row["rule_id"]
        scope = row["scope"] or "all"
        if not name or name in taken:
            raise ValueError(f"rule id {name!r} is missing or taken")
        if row["severity"] not in SEVERITIES or scope not in ("all", *compiler.SCOPES) or not row["pattern"]:
            raise ValueError(f"rule {name}: severity, scope or pattern is none")
        for pattern in filter(None, (row["pattern"], row["unless"])):
            try:
                compiled.compile(X.java_pattern(pattern))
            except Exception as error:
                raise ValueError(f"rule {name}: {pattern!r} is no pattern") from error
        taken.add(name)
        found.append(C.Rule(
            name, C.HEURISTIC, row["severity"], row["title"] or name, row["cwe"], row["owasp"], "CUSTOM", None,
            row["description"] or "", row["recommendation"] or "", category=row["category"] or "SECURITY", scope=scope,
            anchors=tuple(a.lower() for a in row["anchors"] or () if a), every=(row["pattern"],),
            none=(row["unless"],) if row["unless"] else (),
        ))
    return found


def custom_findings(files: DataFrame, rules: DataFrame | list[C.Rule]) -> DataFrame:
    """The findings of the table's rules, in the shape of ``security.findings``: a row per line and rule."""
    rules = read_rules(rules) if isinstance(rules, DataFrame) else rules
    lines = with_scan_id(files).select(
        "scan_id", "repo", "file_path",
        paths.is_js(F.col("file_path")).alias("is_js"), paths.is_python(F.col("file_path")).alias("is_python"), "content",
    ).select("*", F.posexplode(X.split_lines(F.col("content"))).alias("pos", "line")).drop("content")
    words = sorted({a for rule in rules for a in rule.anchors})
    if rules and all(rule.anchors for rule in rules):
        lines = lines.where(F.lower("line").rlike(compiler.word_pattern(words)))

    def test(rule):
        own = F.expr(compiler.condition(rule, anchored=False))
        return X.contains_any(F.lower("line"), rule.anchors) & own if rule.anchors else own

    fields = ("rule_id", "severity", "category", "title", "description", "recommendation", "cwe", "owasp", "method")
    told = [F.when(test(rule), F.struct(*[F.lit(getattr(rule, f)).cast("string").alias(f) for f in fields])) for rule in rules]
    none = F.array().cast("array<struct<" + ",".join(f"{f}:string" for f in fields) + ">>")
    hits = lines.select("*", F.explode(F.array_compact(F.array(*told)) if told else none).alias("r"))
    values = {
        "finding_id": F.sha2(F.concat_ws("|", "scan_id", "file_path", F.col("pos") + 1, "r.rule_id", F.lit(0)), 256),
        "line_no": F.col("pos") + 1, "code_snippet": X.trim(F.col("line")),
        "dependency_info": F.lit(None).cast(DEPENDENCY_INFO), "node_type": F.lit(None).cast("string"),
        **{f: F.col(f"r.{f}") for f in fields},
    }
    return hits.select(*[(values[c] if c in values else F.col(c)).alias(c) for c in FINDING_COLUMNS])
