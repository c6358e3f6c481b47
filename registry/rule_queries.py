"""The rule kernel and the code-node tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import custom_rules, lines, nodes, security
from gritlens.rules import catalogue as R
from gritlens.rules.compiler import LINE_RULES, STRING_LITERAL
from registry import corpora as C
from registry.base import query, quoted, table
from registry.snippets import CASES, CUSTOM_FOUND, CUSTOM_RULES, LINES, LOOKED_FOR, SNIPPETS

CODE_SQL = f"regexp_replace(regexp_replace(line, {quoted(STRING_LITERAL)}, '\"\"', 'g'), '//.*', '')"
CALL_SQL = r"""CASE WHEN trimmed LIKE 'def %' THEN '' ELSE regexp_extract(trimmed, '([a-zA-Z0-9_.]+)\s*\((.*)\)', 1) END"""
SCOPE_SQL = {"all": "true", "js": "is_js", "python": "is_python", "code": "(is_js OR is_python)"}
GUARD_SQL = {
    "no_allowlist": "NOT regexp_matches(content, '(?i)validateUrl|isAllowedHost|allowlist|ALLOWED_HOSTS')",
    "no_path_cleaning": "NOT regexp_matches(content, '(?i)path\\.normalize|replace\\(/\\.\\./')",
    "no_expiry": "position('expiresIn:' IN content) = 0",
    "credentials_header": "position('Access-Control-Allow-Credentials' IN content) > 0",
}


# First arguments as patterns: brackets two deep, which is enough for the code of these corpora.
_ROUND = r"\([^()]*(?:\([^()]*\)[^()]*){0,8}\)"
FIRST_ARGUMENT_TO = rf"[^,()]*(?:{_ROUND}[^,()]*){{0,8}}(?:\([^()]*){{0,3}}"
ARGUMENT_PATTERNS = {
    "built_query": (R.QUERIES, R.FIRST_ARGUMENT_BUILT), "built_command": (R.COMMANDS, R.FIRST_ARGUMENT_BUILT),
    "outer_request": (R.REQUESTS, FIRST_ARGUMENT_TO + R.REQUEST_INPUT),
}
CALL_PATTERNS = dict(nodes.CALLS) | {
    rule.rule_id: (r"(?i)", r"[\w$.]*" + ARGUMENT_PATTERNS[rule.call][0], r"\s*\(\s*" + ARGUMENT_PATTERNS[rule.call][1])
    for rule in R.RULES if rule.call
}


def rule_sql(rule: R.Rule) -> str:
    # No call goes on below its line in these corpora; see calls_over_lines.
    subject = {"line": "line", "statement": "line", "trimmed": "trimmed", "code": "code_text"}[rule.subject]

    def test(pattern, column=subject):
        return f"regexp_matches({column}, {quoted(pattern)})"

    tests = [SCOPE_SQL[rule.scope]]
    tests += [f"NOT starts_with(trimmed, {quoted(mark)})" for mark in rule.skip]
    tests += [rule.guard] if rule.guard else []
    tests += [test(rule.callee, "callee")] if rule.callee else []
    every = rule.every + (("(?i)" + r"\s*\(\s*".join(ARGUMENT_PATTERNS[rule.call]),) if rule.call else ())
    found = " AND ".join(test(p) for p in every) or "true"
    if rule.instead:
        found = f"({found} OR ({rule.instead[1]} AND {test(rule.instead[0])}))"
    tests.append(found)
    tests += [f"NOT {test(p)}" for p in rule.none]
    if rule.callee_none:
        words = " OR ".join(f"contains({subject}, {quoted(w)})" for w in rule.callee_none[1])
        tests.append(f"NOT (callee = {quoted(rule.callee_none[0])} AND ({words}))")
    return " AND ".join(tests)


RULE_ROWS = [
    (R.RULE_NUMBER[r.rule_id], r.rule_id, r.severity, r.cwe or r.title, r.group or r.rule_id, r.title, r.stage * 10 + r.block,
     r.category)
    for r in R.RULES
]
RULES_SQL = (
    "rules(rule_no, rule_id, severity, weakness, first_of, title, emit_block, category) AS (VALUES "
    + C.values(RULE_ROWS) + ")"
)
HITS_SQL = f"""tested AS (
  SELECT repo, file_path, line_no, line, trimmed, is_js, is_python, {", ".join(GUARD_SQL)}, {CALL_SQL} AS callee, {CODE_SQL} AS code_text
  FROM (SELECT *, trim(line, {C.BLANKS}) AS trimmed FROM (
    SELECT repo, file_path, regexp_matches(file_path, '(?i)\\.(js|jsx|ts|tsx|mjs|cjs)$') AS is_js,
      ends_with(file_path, '.py') AS is_python, {", ".join(f"{sql} AS {name}" for name, sql in GUARD_SQL.items())},
      unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_no
    FROM files))),
hits AS (
  SELECT * FROM (SELECT *, unnest([{", ".join(f"CASE WHEN {rule_sql(r)} THEN '{r.rule_id}' END" for r in LINE_RULES)}]) AS rule_id
    FROM tested) WHERE rule_id IS NOT NULL)"""
KEPT_SQL = f"""{HITS_SQL}, {RULES_SQL},
counted AS (SELECT h.*, r.* EXCLUDE (rule_id) FROM hits h JOIN rules r USING (rule_id)
  QUALIFY row_number() OVER (PARTITION BY repo, file_path, line_no, first_of ORDER BY rule_no) = 1),
kept AS (SELECT * FROM counted
  QUALIFY row_number() OVER (PARTITION BY repo, file_path, line_no, weakness ORDER BY rule_no) = 1)"""


@query("rule_hits", f"""WITH {C.SEEDED_SQL}, {HITS_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id FROM hits""")
def rule_hits(spark, sf_dir):
    return security.rule_hits(C.seeded_files(spark, sf_dir))


@query("rule_hits_dense", f"""WITH {C.DENSE_SQL}, {HITS_SQL}
SELECT rule_id, count(*) AS hits, count(DISTINCT file_path) AS files FROM hits GROUP BY rule_id""")
def rule_hits_dense(spark, sf_dir):
    hits = security.rule_hits(C.dense_files(spark, sf_dir))
    return hits.groupBy("rule_id").agg(
        F.count("*").alias("hits"), F.count_distinct("file_path").alias("files")
    )


def _security(files):
    return security.findings(files, quality=False, advisories=None)


@query("security_findings", f"""WITH {C.SEEDED_SQL}, {KEPT_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id, severity, category, weakness AS cwe FROM kept""")
def security_findings(spark, sf_dir):
    found = _security(C.seeded_files(spark, sf_dir))
    return found.select("repo", "file_path", "line_no", "rule_id", "severity", "category", "cwe")


@query("findings_after_dedup", f"""WITH {C.DENSE_SQL}, {KEPT_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id, severity FROM kept""")
def findings_after_dedup(spark, sf_dir):
    found = _security(C.dense_files(spark, sf_dir))
    return found.select("repo", "file_path", "line_no", "rule_id", "severity")


EXPECTED = [(n, line[:3], line[4] == "+") for n, line in enumerate(LINES) if not line.startswith("Q")]


@query("rule_expectations", f"""WITH expected(i, rule_id, reported) AS (VALUES {C.values(EXPECTED)})
SELECT doc_id, rule_id, reported FROM documents JOIN expected ON doc_id % {len(LINES)} = i""")
def rule_expectations(spark, sf_dir):
    """Whether a document's first line is reported by the rule it was written for; the answers are written by hand."""
    hits = security.rule_hits(C.seeded_files(spark, sf_dir)).where(F.col("line_no") == 1)
    own = C.documents(spark, sf_dir).join(C.snippet_table(spark), F.col("doc_id") % C.COUNT == F.col("i")).where(
        ~F.startswith("rule", F.lit("Q"))
    ).select("doc_id", F.col("rule").alias("rule_id"), F.col("doc_id").cast("string").alias("key"))
    found = hits.select("rule_id", F.regexp_extract("file_path", "doc_([0-9]+)", 1).alias("key"), F.lit(True).alias("hit"))
    return own.join(found, ["rule_id", "key"], "left").select("doc_id", "rule_id", F.coalesce("hit", F.lit(False)).alias("reported"))


@query("argument_expectations", f"""WITH expected(i, rules) AS (VALUES {C.values([(n, ",".join(sorted(r))) for n, (_, r) in enumerate(CASES)])})
SELECT doc_id, rules FROM documents JOIN expected ON doc_id % {len(CASES)} = i""")
def argument_expectations(spark, sf_dir):
    """Rules that look into calls and declarations, on code of one and more lines; the answers are written by hand."""
    cases = F.broadcast(spark.createDataFrame([(n, code) for n, (code, _) in enumerate(CASES)], "i int, code string"))
    files = table(spark, sf_dir, "documents").join(cases, F.col("doc_id") % len(CASES) == F.col("i")).select(
        F.lit("r").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("file_path"),
        F.concat("code", F.lit("\n;\n"), "text").alias("content"),
    )
    hits = security.rule_hits(files).where((F.col("line_no") == 1) & F.col("rule_id").isin(*LOOKED_FOR))
    rules = hits.groupBy("file_path").agg(F.array_join(F.sort_array(F.collect_set("rule_id")), ",").alias("rules"))
    return files.select("file_path").join(rules, "file_path", "left").select(
        F.regexp_extract("file_path", "^[0-9]+", 0).cast("bigint").alias("doc_id"), F.coalesce("rules", F.lit("")).alias("rules")
    )


GUARDED_RULES = [r.rule_id for r in R.RULES if r.guard or r.instead]


@query("file_guards", f"""WITH {C.DENSE_SQL}, {HITS_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id FROM hits
WHERE rule_id IN ({", ".join(quoted(r) for r in GUARDED_RULES)})""")
def file_guards(spark, sf_dir):
    return security.rule_hits(C.dense_files(spark, sf_dir)).where(F.col("rule_id").isin(GUARDED_RULES))


NODES_SQL = f"""py AS (SELECT * FROM lines WHERE ends_with(file_path, '.py') AND trimmed <> '' AND NOT starts_with(trimmed, '#')),
nodes AS (
  SELECT repo, file_path, line_no, 'FunctionDef' AS node, regexp_extract(trimmed, '^def\\s+([a-zA-Z0-9_]+)\\s*\\((.*?)\\):', 1) AS name,
    CAST(NULL AS VARCHAR) AS callee,
    array_to_string(list_filter(list_transform(string_split(regexp_extract(trimmed, '^def\\s+([a-zA-Z0-9_]+)\\s*\\((.*?)\\):', 2), ','),
      lambda a: trim(a, {C.BLANKS})), lambda a: a <> ''), '|') AS args, trimmed AS raw
  FROM py WHERE regexp_matches(trimmed, '^def\\s+([a-zA-Z0-9_]+)\\s*\\((.*?)\\):')
  UNION ALL SELECT repo, file_path, line_no, 'Assign', regexp_extract(trimmed, '^([a-zA-Z0-9_]+)\\s*=\\s*(.*)$', 1), NULL, NULL, trimmed
  FROM py WHERE regexp_matches(trimmed, '^([a-zA-Z0-9_]+)\\s*=\\s*(.*)$') AND NOT regexp_matches(trimmed, '^(if|return)')
  UNION ALL SELECT repo, file_path, line_no, 'Call', NULL, {CALL_SQL}, NULL, trimmed FROM py WHERE {CALL_SQL} <> ''
  UNION ALL SELECT repo, file_path, line_no, 'TryExcept', NULL, NULL, NULL, trimmed FROM py
  WHERE regexp_matches(trimmed, 'except(\\s+[a-zA-Z0-9_]+)?\\s*:\\s*pass'))"""


def _node_rows(files):
    return nodes.python_nodes(lines.explode_lines(files)).select(
        "repo", "file_path", "line_no", "node", "name", "callee",
        F.array_join("args", "|").alias("args"), "raw",
    )


@query("python_nodes", f"""WITH {C.DENSE_SQL}, {C.LINES_SQL}, {NODES_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, node, name, callee, args, raw FROM nodes""")
def python_nodes(spark, sf_dir):
    return _node_rows(C.dense_files(spark, sf_dir))


@query("python_nodes_of_words", f"""WITH {C.WORDS_SQL.replace("lines AS (", "raw_lines AS (")},
lines AS (SELECT *, trim(line, {C.BLANKS}) AS trimmed FROM raw_lines), {NODES_SQL}
SELECT node, name, callee, args, count(*) AS n FROM nodes GROUP BY ALL""")
def python_nodes_of_words(spark, sf_dir):
    rows = _node_rows(C.word_files(spark, sf_dir))
    return rows.groupBy("node", "name", "callee", "args").agg(F.count("*").alias("n"))


LIVE_SQL = """js AS (SELECT * FROM lines WHERE regexp_matches(file_path, '(?i)\\.(js|jsx|ts|tsx|mjs|cjs)$')
  AND NOT (starts_with(trimmed, '//') OR starts_with(trimmed, '/*') OR starts_with(trimmed, '*')))"""
SITE_SQL = quoted(r"([\w$.]+)\s*\(\s*(" + R.FIRST_ARGUMENT_BUILT + r")?")


@query("call_sites", f"""WITH {C.DENSE_SQL}, {C.LINES_SQL}, {LIVE_SQL},
sites AS (SELECT repo, file_path, line_no, unnest(regexp_extract_all(line, {SITE_SQL}, 1)) AS callee,
    coalesce(unnest(regexp_extract_all(line, {SITE_SQL}, 2)), '') AS first,
    generate_subscripts(regexp_extract_all(line, {SITE_SQL}, 1), 1) - 1 AS site_no FROM js)
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, CAST(site_no AS INTEGER) AS site_no, callee,
  CASE WHEN first = '' THEN 'plain' WHEN ends_with(first, '${{') THEN 'template' ELSE 'concatenation' END AS first_argument
FROM sites WHERE callee NOT IN ({", ".join(quoted(w) for w in nodes.NOT_CALLEES)})""")
def call_sites(spark, sf_dir):
    return nodes.call_sites(lines.explode_lines(C.dense_files(spark, sf_dir)))


LITERAL_SQL = quoted(nodes.DECLARED_LITERAL)


@query("declared_literals", f"""WITH {C.DENSE_SQL}, {C.LINES_SQL}, {LIVE_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, {LITERAL_SQL}, 1) AS name,
  regexp_extract(line, {LITERAL_SQL}, 2) || regexp_extract(line, {LITERAL_SQL}, 3) AS value
FROM js WHERE regexp_matches(line, {LITERAL_SQL})""")
def declared_literals(spark, sf_dir):
    return nodes.declared_literals(lines.explode_lines(C.dense_files(spark, sf_dir)))


TARGET_SQL = quoted(nodes.ASSIGNED_MARKUP)


@query("markup_targets", f"""WITH {C.DENSE_SQL}, {C.LINES_SQL}, {LIVE_SQL}, bare AS (SELECT *, {CODE_SQL} AS c FROM js)
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, 'assignment' AS kind, regexp_extract(c, {TARGET_SQL}, 1) AS target
FROM bare WHERE regexp_matches(c, {TARGET_SQL}) AND NOT regexp_matches(c, '(?:^|\\s)dangerouslySetInnerHTML\\s*=\\s*\\{{')
UNION ALL SELECT repo, file_path, CAST(line_no AS INTEGER), 'attribute', 'dangerouslySetInnerHTML' FROM bare
WHERE regexp_matches(c, 'dangerouslySetInnerHTML\\s*=')""")
def markup_targets(spark, sf_dir):
    return nodes.markup_targets(lines.explode_lines(C.dense_files(spark, sf_dir)))


def _callee_sql(rule_id: str, text: str) -> str:
    before, name, after = CALL_PATTERNS[rule_id]
    return f"regexp_extract({text}, {quoted(f'{before}({name}){after}')}, 1)"


def _call_sql(rule_id: str) -> str:
    before, name, _ = CALL_PATTERNS[rule_id]
    body = r"(?:\((?:[^()]+|\((?:[^()]+|\([^()]*\))*\))*\)|\(.*)"
    return f"trim(regexp_extract(line, {quoted(f'{before}({name}' + chr(92) + f's*{body})')}, 1), {C.BLANKS})"


_AWS, _CREDENTIAL = quoted(nodes.AWS_DECLARED), quoted(nodes.CREDENTIAL_DECLARED)
_ASSIGN, _HASH = quoted(R.PYTHON_ASSIGN), quoted(nodes.HASH_NAME)
SNIPPET_SQL = "CASE rule_id " + " ".join(
    f"WHEN '{name}' THEN {_call_sql(name)}" for name in CALL_PATTERNS
) + f"""
  WHEN 'J07' THEN trim(regexp_extract(line, {quoted(nodes.MARKUP_ASSIGNMENT)}, 1), {C.BLANKS})
  WHEN 'J08' THEN regexp_extract(line, '(dangerouslySetInnerHTML\\s*=\\s*\\{{(?:[^{{}}]+|\\{{[^{{}}]*\\}})*\\}}?)', 1)
  WHEN 'J09' THEN regexp_extract(line, {_AWS}, 1) || ' = "' || left(regexp_extract(line, {_AWS}, 2), 8) || '..."'
  WHEN 'J10' THEN regexp_extract(line, {_CREDENTIAL}, 1) || ' = "' || left(regexp_extract(line, {_CREDENTIAL}, 2), 4) || '***"'
  WHEN 'P07' THEN regexp_extract(trimmed, {_ASSIGN}, 1) || ' = "***REDACTED***"'
  ELSE trimmed END"""
TITLE_SQL = f"""CASE rule_id
  WHEN 'J04' THEN replace(title, '{{upper_algorithm}}', upper(regexp_extract(line, {_HASH}, 1)))
  WHEN 'J10' THEN replace(title, '{{name}}', regexp_extract(line, {_CREDENTIAL}, 1))
  WHEN 'P07' THEN replace(title, '{{name}}', regexp_extract(trimmed, {_ASSIGN}, 1))
  WHEN 'P04' THEN replace(title, '{{algorithm}}', CASE WHEN contains(callee, 'md5') THEN 'MD5' ELSE 'SHA-1' END)
  ELSE replace(title, '{{callee}}', callee) END"""


@query("finding_texts", f"""WITH {C.SEEDED_SQL}, {KEPT_SQL}
SELECT file_path, CAST(line_no AS INTEGER) AS line_no, rule_id, {TITLE_SQL} AS title, {SNIPPET_SQL} AS code_snippet,
  sha2_256 AS finding_id FROM (SELECT *, sha256('scan-' || repo || '|' || file_path || '|' || line_no || '|' || rule_id || '|0') AS sha2_256 FROM kept)""")
def finding_texts(spark, sf_dir):
    found = _security(C.seeded_files(spark, sf_dir))
    return found.select("file_path", "line_no", "rule_id", "title", "code_snippet", "finding_id")


# Ways to write a call over several lines; @ is a word that differs per document.
SPANNING = [
    'db.query(\n  "SELECT * FROM @ WHERE id = " + id,\n  cb)', "await pool.query(\n  `SELECT *\n   FROM @\n   WHERE id = ${id}`\n)",
    "db.query(`SELECT a\n  FROM @\n  WHERE b = ${b}`)", "db.query(\n  'SELECT 1 FROM @',\n  [a + b])", "exec(\n  'ping ' + @\n)",
    "execSync(`rm\n @`)", "crypto.createHash(\n  'MD5'\n)", "axios.get(\n  req.query.@,\n  opts)", "fetch(\n  url,\n  req.body)",
    "// db.query(\n  'a' + @)", "log(\n  db.query(\n    'a' + @))",
]
# What the spanning calls report: (rule, line, the whole call), none for the safe ones.
SPANNING_FOUND = [
    ("J02", 1, 'db.query(\n  "SELECT * FROM @ WHERE id = " + id,\n  cb)'),
    ("J02", 1, "pool.query(\n  `SELECT *\n   FROM @\n   WHERE id = ${id}`\n)"),
    ("J02", 1, "db.query(`SELECT a\n  FROM @\n  WHERE b = ${b}`)"), None, ("J03", 1, "exec(\n  'ping ' + @\n)"), None,
    ("J04", 1, "crypto.createHash(\n  'MD5'\n)"), ("J06", 1, "axios.get(\n  req.query.@,\n  opts)"), None, None,
    ("J02", 2, "db.query(\n    'a' + @)"),
]
SPANNING_SQL = "forms(n, rule_id, line_no, code_snippet) AS (VALUES " + C.values(
    [(n, *found) for n, found in enumerate(SPANNING_FOUND) if found]
) + ")"


@query("calls_over_lines", f"""WITH {SPANNING_SQL}
SELECT 'src/doc_' || doc_id || '.ts' AS file_path, rule_id, CAST(line_no AS INTEGER) AS line_no, replace(code_snippet, '@', source) AS code_snippet
FROM documents JOIN forms ON doc_id % {len(SPANNING)} = n""")
def calls_over_lines(spark, sf_dir):
    """Calls whose first argument stands below the line of the call."""
    forms = F.array(*[F.lit(form) for form in SPANNING])
    form = F.element_at(forms, (F.col("doc_id") % len(SPANNING) + 1).cast("int"))
    files = C.documents(spark, sf_dir).select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit(".ts")).alias("file_path"),
        F.concat(F.replace(form, F.lit("@"), F.col("source")), F.lit("\n"), "text").alias("content"),
    )
    found = _security(files).where(F.col("rule_id").isin("J02", "J03", "J04", "J06"))
    return found.select("file_path", "rule_id", "line_no", "code_snippet")


CUSTOM_EXPECTED = [(i, rule) for i, _, _, line in SNIPPETS for rule, found in CUSTOM_FOUND.items() if line in found]


@query("custom_rules", f"""WITH expected(i, rule_id) AS (VALUES {C.values(CUSTOM_EXPECTED)}),
named(r, rule_id) AS (VALUES {C.values([(n, rule[0]) for n, rule in enumerate(CUSTOM_RULES)])})
SELECT doc_id, e.rule_id, CASE WHEN r_regionkey % 2 = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, r_name || ': ' || e.rule_id AS title
FROM documents JOIN expected e ON doc_id % {C.COUNT} = i JOIN named USING (rule_id) JOIN region ON r_regionkey = r""")
def custom_rules_(spark, sf_dir):
    """Rules that come from a table (a row per region), on the first lines of files; what they find is written by hand."""
    own = spark.createDataFrame(
        [(n, *rule) for n, rule in enumerate(CUSTOM_RULES)], "r int, rule_id string, scope string, anchors array<string>, pattern string, unless string"
    )
    text = F.lit("")
    rules = table(spark, sf_dir, "region").join(F.broadcast(own), F.col("r_regionkey") == F.col("r")).select(
        "rule_id", F.when(F.col("r_regionkey") % 2 == 0, "HIGH").otherwise("LOW").alias("severity"), F.lit("SECURITY").alias("category"),
        F.concat("r_name", F.lit(": "), "rule_id").alias("title"), text.alias("description"), text.alias("recommendation"),
        F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("string").alias("owasp"), "scope", "anchors", "pattern", "unless",
    )
    found = custom_rules.custom_findings(C.seeded_files(spark, sf_dir), rules).where("line_no = 1")
    return found.select(F.regexp_extract("file_path", "doc_([0-9]+)", 1).cast("bigint").alias("doc_id"), "rule_id", "severity", "title")
