"""Quality and documentation rules over code made of the documents' words."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import quality, security
from gritlens.rules import catalogue as R
from registry import corpora as C
from registry.base import query, quoted

START = quoted(R.FUNCTION_START)
SEGMENTS_SQL = f"""marked AS (
  SELECT *, trim(line, {C.BLANKS}) AS t,
    CASE WHEN regexp_matches(line, {START}) THEN 1 ELSE 0 END AS is_fn,
    CASE WHEN regexp_matches(line, {quoted(R.BRANCH)}) THEN 1 ELSE 0 END AS is_br FROM lines),
code AS (SELECT * FROM marked WHERE t <> '' AND NOT regexp_matches(t, '^(//|#|/\\*|\\*)')),
seg AS (SELECT *, max(CASE WHEN is_fn = 1 THEN line_no END)
  OVER (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fs FROM code),
m AS (SELECT *, 1 + sum(is_br) OVER (PARTITION BY file_path, fs ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS bc
  FROM seg WHERE fs IS NOT NULL),
names AS (SELECT file_path, line_no AS fs, coalesce(nullif(regexp_extract(line, {START}, 1), ''), nullif(regexp_extract(line, {START}, 2), ''),
  nullif(regexp_extract(line, {START}, 3), ''), 'anonymous') AS name FROM code WHERE is_fn = 1),
g AS (SELECT repo, file_path, fs, count(*) AS n FROM m GROUP BY ALL),
g2 AS (SELECT g.*, name, lead(fs) OVER (PARTITION BY file_path ORDER BY fs) AS nx FROM g JOIN names USING (file_path, fs))"""


def _of_rule(spark, sf_dir, rule_id):
    found = security.findings(C.word_files(spark, sf_dir), security=False, quality={rule_id})
    return found.where(F.col("rule_id") == rule_id)


@query("function_segments", f"""WITH {C.WORDS_SQL}, {SEGMENTS_SQL}
SELECT repo, file_path, CAST(fs AS INTEGER) AS start_line, name, CAST(n AS INTEGER) AS n_lines, CAST(nx AS INTEGER) AS next_start FROM g2""")
def function_segments(spark, sf_dir):
    return quality.function_segments(C.word_files(spark, sf_dir))


@query("long_functions", f"""WITH {C.WORDS_SQL}, {SEGMENTS_SQL}
SELECT file_path, CAST(fs AS INTEGER) AS line_no, 'MEDIUM' AS severity, 'Excessive Function Length (' || name || ')' AS title,
  'function ' || name || '() ... [' || n || ' lines]' AS code_snippet,
  'Function ''' || name || ''' is ' || n || ' lines long, exceeding recommended clean-code threshold (40 lines).' AS description
FROM g2 WHERE nx IS NOT NULL AND n > 45""")
def long_functions(spark, sf_dir):
    return _of_rule(spark, sf_dir, "Q01").select(
        "file_path", "line_no", "severity", "title", "code_snippet", "description"
    )


# Only code lines up to the sixteenth of a function count, so they are summed, not
# followed line by line, and texts are looked at for functions that qualify.
COMPLEX_SQL = f"""code AS (
  SELECT file_path, line_no, line, regexp_matches(line, {START}) AS is_fn,
    regexp_matches(line, {quoted(R.BRANCH)}) AS is_br
  FROM lines WHERE NOT regexp_matches(line, {quoted("^[" + C.WHITESPACE.replace(chr(10), "") + "]*(//|#|/[*]|[*]|$)")})),
seg AS (SELECT file_path, line_no, is_br, max(CASE WHEN is_fn THEN line_no END)
  OVER (PARTITION BY file_path ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS fs FROM code),
counted AS (SELECT file_path, fs, 1 + count(*) FILTER (is_br) AS bc FROM seg WHERE line_no <= fs + 15
  GROUP BY file_path, fs HAVING bool_or(line_no = fs + 15)),
complex AS (SELECT file_path, fs, bc FROM counted WHERE bc >= 10)"""


@query("complex_functions", f"""WITH {C.WORDS_SQL}, {COMPLEX_SQL}
SELECT x.file_path, CAST(fs AS INTEGER) AS line_no, CASE WHEN bc >= 15 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  trim(l.line, {C.BLANKS}) AS code_snippet,
  'High Cyclomatic Complexity (' || coalesce(nullif(regexp_extract(f.line, {START}, 1), ''), nullif(regexp_extract(f.line, {START}, 2), ''),
    nullif(regexp_extract(f.line, {START}, 3), ''), 'anonymous') || ': CC ' || bc || ')' AS title
FROM complex x JOIN code f ON f.file_path = x.file_path AND f.line_no = fs
JOIN code l ON l.file_path = x.file_path AND l.line_no = fs + 15""")
def complex_functions(spark, sf_dir):
    return _of_rule(spark, sf_dir, "Q02").select("file_path", "line_no", "severity", "code_snippet", "title")


@query("empty_catch", f"""WITH {C.WORDS_SQL}, {SEGMENTS_SQL}
SELECT file_path, CAST(line_no AS INTEGER) AS line_no, t AS code_snippet FROM code WHERE regexp_matches(line, {quoted(R.EMPTY_CATCH)})
QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY line_no) = 1""")
def empty_catch(spark, sf_dir):
    return _of_rule(spark, sf_dir, "Q03").select("file_path", "line_no", "code_snippet")


@query("debug_statements", f"""WITH {C.WORDS_SQL}, {SEGMENTS_SQL}
SELECT file_path, CAST(line_no AS INTEGER) AS line_no, t AS code_snippet FROM code
WHERE regexp_matches(line, '(console\\.log\\(|print\\("DEBUG|debugger;)')""")
def debug_statements(spark, sf_dir):
    return _of_rule(spark, sf_dir, "Q04").select("file_path", "line_no", "code_snippet")


STATISTICS_SQL = f"""stats AS (SELECT repo, file_path,
   count(*) FILTER (t <> '' AND NOT regexp_matches(t, '^(//|#|/\\*|\\*)')) AS code_lines,
   count(*) FILTER (regexp_matches(t, '^(//|#|/\\*|\\*)')) AS comment_lines, min_by(line, line_no) AS first_line
  FROM (SELECT *, trim(line, {C.BLANKS}) AS t FROM lines) GROUP BY repo, file_path)"""


@query("line_statistics", f"""WITH {C.WORDS_SQL}, {STATISTICS_SQL}
SELECT repo, file_path, CAST(code_lines AS INTEGER) AS code_lines, CAST(comment_lines AS INTEGER) AS comment_lines FROM stats""")
def line_statistics(spark, sf_dir):
    return quality.line_statistics(C.word_files(spark, sf_dir))


@query("comment_density", f"""WITH {C.WORDS_SQL}, {STATISTICS_SQL},
low AS (SELECT *, CAST(comment_lines AS DOUBLE) / code_lines * 100 AS pct FROM stats
  WHERE code_lines > 50 AND CAST(comment_lines AS DOUBLE) / code_lines < 0.05)
SELECT file_path, 1 AS line_no, CASE WHEN first_line = '' THEN '// File header' ELSE first_line END AS code_snippet,
  'File has ' || code_lines || ' lines of code but only ' || comment_lines || ' lines of comments ('
  || printf('%.1f', CASE WHEN pct * 4 = floor(pct * 4) AND (pct * 4) % 2 = 1 THEN pct + 0.01 ELSE pct END) || '% doc ratio).' AS description
FROM low""")
def comment_density(spark, sf_dir):
    return _of_rule(spark, sf_dir, "Q05").select("file_path", "line_no", "code_snippet", "description")
