"""Reports, remediation, patches, prompts and conversation context."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import remediation as M
from gritlens.operators import reports as R
from registry import corpora as C
from registry.base import query, quoted, table


def template_sql(template: str, values: dict[str, str]) -> str:
    """The template as a SQL concatenation, markers replaced by expressions."""
    out, rest = [], template
    while rest:
        hits = [(rest.find("{" + k + "}"), k) for k in values if "{" + k + "}" in rest]
        if not hits:
            out.append(quoted(rest))
            break
        at, name = min(hits)
        if at:
            out.append(quoted(rest[:at]))
        out.append(f"coalesce(CAST({values[name]} AS VARCHAR), '')")
        rest = rest[at + len(name) + 2 :]
    return "concat(" + ", ".join(out) + ")"


TOTAL_SQL = "(critical + high + medium + low + info)"
SUMMARY_SQL = template_sql(R.SUMMARY, {"files": "total_files", "lines": "total_lines", "repo": "repo",
                                       "total": TOTAL_SQL, "critical": "critical", "high": "high"})


@query("executive_report", f"""WITH {C.SCANS_SQL} SELECT 'report-' || scan_id AS report_id, scan_id, repo, overall AS overall_score,
  {SUMMARY_SQL} AS executive_summary, CAST({TOTAL_SQL} AS BIGINT) AS total_findings, CAST(critical AS BIGINT) AS critical_findings FROM scans""")
def executive_report(spark, sf_dir):
    return R.executive_reports(C.scans(spark, sf_dir))


HEADER_SQL = template_sql(R.HEADER, {
    **{c: c for c in ("repo", "overall", "status", "total_files", "total_lines", "security", "quality", "maintainability",
                      "documentation", "critical", "high", "medium")},
    "title": quoted(R.TITLE), "date": "strftime(started_at, '%a, %d %b %Y %H:%M:%S GMT')", "low_info": "low + info",
    "security_band": "CASE WHEN security >= 80 THEN 'STRONG' WHEN security >= 60 THEN 'MODERATE' ELSE 'CRITICAL' END",
    "quality_band": "CASE WHEN quality >= 80 THEN 'STRONG' ELSE 'NEEDS IMPROVEMENT' END",
    "maintainability_band": "CASE WHEN maintainability >= 80 THEN 'OPTIMAL' ELSE 'REFACTOR RECOMMENDED' END",
    "documentation_band": "CASE WHEN documentation >= 80 THEN 'DOCUMENTED' ELSE 'SPARSE' END",
})
FINDING_SQL = template_sql(R.FINDING, {
    **{c: c for c in ("number", "severity", "title", "file_path", "line_no", "category", "description", "code_snippet", "recommendation")},
    "cwe": "coalesce(cwe, 'N/A')", "owasp": "coalesce(owasp, 'N/A')",
})


NUMBERED_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_no, finding_id) AS number FROM findings)"
ENDS_SQL = "ends AS (SELECT scan_id, count(f.finding_id) + 1 AS number FROM scans LEFT JOIN findings f USING (scan_id) GROUP BY scan_id)"


@query("markdown_report", f"""WITH {C.SCANS_SQL}, {C.FINDINGS_SQL}, {NUMBERED_SQL}, {ENDS_SQL}
SELECT scan_id, 0 AS number, {HEADER_SQL} AS text FROM scans
UNION ALL SELECT scan_id, number, CASE WHEN number > 1 THEN chr(10) || chr(10) ELSE '' END || {FINDING_SQL} FROM numbered
UNION ALL SELECT scan_id, number, {quoted(R.FOOTER)} FROM ends""")
def markdown_report(spark, sf_dir):
    """The report of every scan: rows that in order are its document, at any length."""
    return R.markdown_documents(C.scans(spark, sf_dir), C.stored_findings(spark, sf_dir))


@query("markdown_report_in_parts", f"""WITH {C.SCANS_SQL}, {C.FINDINGS_SQL}, {NUMBERED_SQL},
parts AS (SELECT scan_id, CAST(floor((number - 1) / 2) AS INTEGER) AS part_no,
  string_agg(CASE WHEN number > 1 THEN chr(10) || chr(10) ELSE '' END || {FINDING_SQL}, '' ORDER BY number) AS body
  FROM numbered GROUP BY ALL),
joined AS (SELECT *, coalesce(part_no, 0) AS p, max(coalesce(part_no, 0)) OVER (PARTITION BY scan_id) AS last FROM scans LEFT JOIN parts USING (scan_id))
SELECT scan_id, p AS part_no, CASE WHEN p = 0 THEN {HEADER_SQL} ELSE '' END || coalesce(body, '')
  || CASE WHEN p = last THEN {quoted(R.FOOTER)} ELSE '' END AS text FROM joined""")
def markdown_report_in_parts(spark, sf_dir):
    return R.in_parts(R.markdown_documents(C.scans(spark, sf_dir), C.stored_findings(spark, sf_dir)), 2)


@query("json_report", f"""WITH {C.SCANS_SQL}, {C.FINDINGS_SQL}, {NUMBERED_SQL}
SELECT scan_id, repo, status, overall, coalesce(number, 0) AS number, finding_id, severity, title, line_no
FROM scans LEFT JOIN numbered USING (scan_id)""")
def json_report(spark, sf_dir):
    """Scans with their findings below them, clean scans too, without JSON's text."""
    nested = R.nested_scans(
        C.scans(spark, sf_dir).select("scan_id", "repo", "status", "overall"), C.stored_findings(spark, sf_dir)
    )
    return nested.select(
        "scan_id", "repo", "status", "overall", "number",
        *[F.col(f"finding.{name}").alias(name) for name in ("finding_id", "severity", "title", "line_no")],
    )


def json_sql(columns: list[str]) -> str:
    """The columns as a JSON object without its braces, null fields written out."""
    parts = [f"'\"{c}\":' || coalesce(CAST(to_json({c}) AS VARCHAR), 'null')" for c in columns]
    return " || ',' || ".join(parts)


JSON_SCAN = ["scan_id", "user_id", "repo", "status", "overall", "security", "quality", "critical", "high", "total_files", "total_lines"]
JSON_FINDING = ["finding_id", "severity", "category", "title", "cwe", "owasp", "file_path", "line_no", "code_snippet", "description", "recommendation"]


@query("json_documents", f"""WITH {C.SCANS_SQL}, {C.FINDINGS_SQL}, {NUMBERED_SQL}, {ENDS_SQL}
SELECT scan_id, 0 AS number, '{{' || {json_sql(JSON_SCAN)} || ',"findings":[' AS text FROM scans
UNION ALL SELECT scan_id, number, CASE WHEN number > 1 THEN ',' ELSE '' END || '{{' || {json_sql(JSON_FINDING)} || '}}' FROM numbered
UNION ALL SELECT scan_id, number, ']}}' FROM ends""")
def json_documents(spark, sf_dir):
    """The whole scan as JSON: rows that in order are its document."""
    found = C.stored_findings(spark, sf_dir)
    return R.json_documents(C.scans(spark, sf_dir).select(*JSON_SCAN), found.select("scan_id", *JSON_FINDING))


def advice_sql(advice) -> str:
    return "advice(kind, problem, impact, steps, code) AS (VALUES " + C.values(
        [(a.name, a.problem, a.impact, "|".join(a.steps), a.code) for a in advice]
    ) + ")"


def fill_sql(text: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


TITLE_KIND_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join([f"contains(lower(title), {quoted(w)})" for w in words] + (["cve IS NOT NULL"] if name == "dependency" else []))
    + f" THEN '{name}'" for name, words in M.TITLE_LADDER
) + " ELSE 'general' END"
TITLE_VALUES = {
    "package": "coalesce(package_name, 'a third-party library')", "package_or_library": "coalesce(package_name, 'library')",
    "fixed_or_patch": "coalesce(fixed_version, 'the latest secure patch')", "fixed_or_latest": "coalesce(fixed_version, 'latest')",
    "description": "description",
}


def marked_sql(text: str, mark: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, chr(10)), lambda l: '{mark}' || l), chr(10))"


@query("remediation_by_title", f"""WITH {C.FINDINGS_SQL}, {advice_sql(M.TITLE_ADVICE)},
j AS (SELECT f.*, a.kind AS advice_kind, {fill_sql("problem", TITLE_VALUES)} AS problem_explanation, impact AS security_impact,
   {fill_sql("steps", TITLE_VALUES)} AS steps, {fill_sql("code", TITLE_VALUES)} AS remediated_code
  FROM findings f JOIN advice a ON a.kind = {TITLE_KIND_SQL})
SELECT finding_id, advice_kind AS kind, problem_explanation, security_impact, steps, remediated_code,
  '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -1,' || len(string_split(code_snippet, chr(10))) || ' +1,'
  || len(string_split(remediated_code, chr(10))) || ' @@' || chr(10) || {marked_sql(f"trim(code_snippet, {C.BLANKS})", "- ")} || chr(10)
  || {marked_sql(f"trim(remediated_code, {C.BLANKS})", "+ ")} AS diff_snippet FROM j""")
def remediation_by_title(spark, sf_dir):
    done = M.remediate_by_title(C.stored_findings(spark, sf_dir))
    return done.select(
        "finding_id", "kind", "problem_explanation", "security_impact",
        F.array_join("step_by_step_fix", "|").alias("steps"), "remediated_code", "diff_snippet",
    )


WEAKNESS_KIND_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(coalesce(cwe, ''), 'CWE-{code}(\\D|$)') OR contains(lower(title), '{word}') THEN '{name}'"
    for name, code, word in M.WEAKNESS_LADDER
) + " WHEN category = 'DEPENDENCY' THEN 'dependency' ELSE 'general' END"
WEAKNESS_VALUES = {
    "package": "coalesce(package_name, '')", "version": "coalesce(installed_version, '')", "cve": "coalesce(cve, '')",
    "fixed": "coalesce(fixed_version, '')", "fixed_or_latest": "coalesce(fixed_version, 'latest')",
    "file_path": "file_path", "line_no": "CAST(line_no AS VARCHAR)", "code_snippet": "code_snippet",
}
REWRITTEN_SQL = f"regexp_replace(code_snippet, {quoted(M.INTERPOLATED)}, '$1', 'g')"


@query("remediation_by_weakness", f"""WITH {C.FINDINGS_SQL}, {advice_sql(M.WEAKNESS_ADVICE)},
j AS (SELECT f.*, a.kind AS advice_kind, {fill_sql("problem", WEAKNESS_VALUES)} AS problem_explanation, {fill_sql("steps", WEAKNESS_VALUES)} AS steps,
   CASE WHEN a.kind = 'sql' AND contains({REWRITTEN_SQL}, '[$1]') THEN {REWRITTEN_SQL}
        WHEN a.kind = 'xss' AND contains(code_snippet, 'innerHTML') THEN
          left(code_snippet, position('innerHTML' IN code_snippet) - 1) || 'textContent' || substr(code_snippet, position('innerHTML' IN code_snippet) + 9)
        ELSE {fill_sql("code", WEAKNESS_VALUES)} END AS remediated_code
  FROM findings f JOIN advice a ON a.kind = {WEAKNESS_KIND_SQL})
SELECT finding_id, advice_kind AS kind, problem_explanation, steps, remediated_code,
  '--- a/' || file_path || chr(10) || '+++ b/' || file_path || chr(10) || '@@ -' || line_no || ',' || len(string_split(code_snippet, chr(10)))
  || ' +' || line_no || ',' || len(string_split(remediated_code, chr(10))) || ' @@' || chr(10) || {marked_sql("code_snippet", "-")} || chr(10)
  || {marked_sql("remediated_code", "+")} AS diff_snippet FROM j""")
def remediation_by_weakness(spark, sf_dir):
    done = M.remediate_by_weakness(C.stored_findings(spark, sf_dir))
    return done.select(
        "finding_id", "kind", "problem_explanation", F.array_join("step_by_step_fix", "|").alias("steps"),
        "remediated_code", "diff_snippet",
    )


REWRITE_SQL = """words AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'run([${' || lang || '}, b + c.d])' WHEN 1 THEN 'x = [+' || lang || ']; y = z + ' || source
  WHEN 2 THEN 'a.innerHTML = ' || source || '; b.innerHTML = ' || lang ELSE source || ' = 1' END AS code_snippet FROM documents)"""


@query("snippet_rewrite", f"""WITH {REWRITE_SQL}
SELECT doc_id, code_snippet, CASE WHEN contains({REWRITTEN_SQL}, '[$1]') THEN {REWRITTEN_SQL}
    ELSE {quoted(M.WEAKNESS_ADVICE[0].code)} END AS parameterised,
  CASE WHEN contains(code_snippet, 'innerHTML') THEN left(code_snippet, position('innerHTML' IN code_snippet) - 1) || 'textContent'
     || substr(code_snippet, position('innerHTML' IN code_snippet) + 9) ELSE {quoted(M.WEAKNESS_ADVICE[1].code)} END AS text_content FROM words""")
def snippet_rewrite(spark, sf_dir):
    kind = F.col("doc_id") % 4
    snippet = (
        F.when(kind == 0, F.concat(F.lit("run([${"), "lang", F.lit("}, b + c.d])")))
        .when(kind == 1, F.concat(F.lit("x = [+"), "lang", F.lit("]; y = z + "), "source"))
        .when(kind == 2, F.concat(F.lit("a.innerHTML = "), "source", F.lit("; b.innerHTML = "), "lang"))
        .otherwise(F.concat("source", F.lit(" = 1")))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", snippet.alias("code_snippet"))
    return rows.select(
        "*", M.parameterised(F.col("code_snippet")).alias("parameterised"),
        M.text_content(F.col("code_snippet")).alias("text_content"),
    )


def _diff_inputs(spark, sf_dir):
    """A document's text against its upper-cased form."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("path"),
        F.concat(F.lit("\n "), F.col("text"), F.lit("\n")).alias("old"), F.substring_index("text", "\n", 2).alias("new"),
    )


DIFF_SQL = """d AS (SELECT doc_id, 'docs/' || doc_id AS path, chr(10) || ' ' || text || chr(10) AS old,
  array_to_string(string_split(text, chr(10))[1:2], chr(10)) AS new FROM documents)"""


@query("diff_from_top", f"""WITH {DIFF_SQL} SELECT doc_id, md5('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,'
  || len(string_split(old, chr(10))) || ' +1,' || len(string_split(new, chr(10))) || ' @@' || chr(10)
  || {marked_sql(f"trim(old, {C.BLANKS})", "- ")} || chr(10) || {marked_sql(f"trim(new, {C.BLANKS})", "+ ")}) AS diff FROM d""")
def diff_from_top(spark, sf_dir):
    diff = M.diff_from_top(F.col("old"), F.col("new"), F.col("path"))
    return _diff_inputs(spark, sf_dir).select("doc_id", F.md5(diff).alias("diff"))


@query("diff_at_line", f"""WITH {DIFF_SQL} SELECT doc_id, md5('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -' || doc_id || ','
  || len(string_split(old, chr(10))) || ' +' || doc_id || ',' || len(string_split(new, chr(10))) || ' @@' || chr(10)
  || {marked_sql("old", "-")} || chr(10) || {marked_sql("new", "+")}) AS diff FROM d""")
def diff_at_line(spark, sf_dir):
    diff = M.diff_at_line(F.col("path"), F.col("doc_id"), F.col("old"), F.col("new"))
    return _diff_inputs(spark, sf_dir).select("doc_id", F.md5(diff).alias("diff"))


PROMPT_VALUES = {
    **{c: c for c in ("title", "file_path", "line_no", "category", "severity", "code_snippet")},
    "product": quoted(M.PRODUCT), "cwe": "coalesce(cwe, 'N/A')", "owasp": "coalesce(owasp, 'N/A')",
    "node_type": "coalesce(node_type, 'Syntax Node')", "method": "coalesce(method, 'AST Analysis')",
    "dependency_line": "CASE WHEN cve IS NULL THEN '' ELSE '- Dependency: ' || package_name || ' (Installed: ' || installed_version || ', Fixed: ' || fixed_version || ')' END",
}


@query("remediation_prompts", f"WITH {C.FINDINGS_SQL} SELECT finding_id, {template_sql(M.PROMPT, PROMPT_VALUES)} AS prompt FROM findings")
def remediation_prompts(spark, sf_dir):
    return M.remediation_prompts(C.stored_findings(spark, sf_dir))


CONTEXT_SQL = """ctx AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Developer' ELSE 'Copilot' END || ': ' || text, chr(10) ORDER BY turn) AS context
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4 GROUP BY conv_id)"""


@query("conversation_context", f"WITH {CONTEXT_SQL} SELECT conv_id, context FROM ctx")
def conversation_context(spark, sf_dir):
    return M.conversation_context(table(spark, sf_dir, "conversations"))


QUESTION_VALUES = {
    **PROMPT_VALUES, "question": "'Is ' || finding_id || ' real?'",
    "conversation": "CASE WHEN context IS NULL THEN '' ELSE 'RECENT CONVERSATION:' || chr(10) || context || chr(10) END",
}


@query("question_prompts", f"""WITH {C.FINDINGS_SQL}, {CONTEXT_SQL},
q AS (SELECT f.*, context FROM findings f LEFT JOIN ctx ON scan_id = 'scan-' || conv_id)
SELECT finding_id, {template_sql(M.QUESTION_PROMPT, QUESTION_VALUES)} AS prompt FROM q""")
def question_prompts(spark, sf_dir):
    context = M.conversation_context(table(spark, sf_dir, "conversations")).select(
        F.concat(F.lit("scan-"), F.col("conv_id").cast("string")).alias("scan_id"), "context"
    )
    asked = C.stored_findings(spark, sf_dir).join(context, "scan_id", "left").withColumn(
        "question", F.concat(F.lit("Is "), "finding_id", F.lit(" real?"))
    )
    return M.question_prompts(asked)
