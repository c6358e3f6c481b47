"""Sources and input preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.functions import paths as P
from gritlens.operators import ingest, lines
from gritlens.sources import files as sources
from registry import corpora as C
from registry.base import query, quoted, table

LANGUAGE_SQL = """CASE
  WHEN name LIKE '.env%' THEN 'env' WHEN name = 'package.json' THEN 'json' WHEN name = 'requirements.txt' THEN 'requirements'
  WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext IN ('js', 'jsx', 'mjs', 'cjs') THEN 'javascript'
  WHEN ext = 'py' THEN 'python' WHEN ext = 'yml' THEN 'yaml' WHEN ext = 'rb' THEN 'ruby' WHEN ext = 'sh' THEN 'shell'
  WHEN ext IN ('java', 'sql', 'json', 'yaml', 'go', 'php') THEN ext ELSE 'plaintext' END"""
NAMED_SQL = """named AS (SELECT *, lower(regexp_extract(file_path, '[^/]*$')) AS name,
  lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+\\.([^.]*)$', 1)) AS ext FROM {source})"""


@query("source_files", f"""WITH {C.SEEDED_SQL}, {NAMED_SQL.format(source="files")}
SELECT repo, file_path, {LANGUAGE_SQL} AS language, CAST(octet_length(encode(content)) AS BIGINT) AS size,
  md5(content) AS digest FROM named""")
def source_files(spark, sf_dir):
    files = sources.describe(C.seeded_files(spark, sf_dir))
    return files.select("repo", "file_path", "language", "size", F.md5("content").alias("digest"))


@query("snippet_source", f"""WITH s AS (
  SELECT 'chat-' || conv_id AS repo, CASE WHEN role = 'user' THEN 'turn' || turn || '.py' ELSE 'snippet.ts' END AS file_path,
    CASE WHEN role = 'user' THEN 'python' ELSE 'typescript' END AS language,
    CASE WHEN turn % 3 = 2 THEN '  ' || chr(10) ELSE ' ' || text END AS content FROM conversations)
SELECT repo, file_path, language, CAST(octet_length(encode(content)) AS BIGINT) AS size, md5(content) AS digest
FROM s WHERE trim(content, {C.BLANKS}) <> ''""")
def snippet_source(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("chat-"), F.col("conv_id").cast("string")).alias("name"),
        F.when(F.col("role") == "user", F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".py")))
        .alias("file_name"),
        F.when(F.col("turn") % 3 == 2, F.lit("  \n")).otherwise(F.concat(F.lit(" "), F.col("text"))).alias("code"),
    )
    return sources.snippet_files(turns).select(
        "repo", "file_path", "language", "size", F.md5("content").alias("digest")
    )


SAFE_SQL = """segs AS (SELECT DISTINCT file_path, string_split(file_path, '/') AS s FROM paths),
depth AS (SELECT file_path, min(d) AS lowest FROM (
    SELECT file_path, sum(CASE WHEN seg = '..' THEN -1 WHEN seg IN ('', '.') THEN 0 ELSE 1 END)
      OVER (PARTITION BY file_path ORDER BY i ROWS UNBOUNDED PRECEDING) AS d
    FROM (SELECT file_path, unnest(s) AS seg, generate_subscripts(s, 1) AS i FROM segs)) GROUP BY file_path),
safe AS (SELECT p.*, p.file_path <> '' AND left(p.file_path, 1) <> '/' AND lowest >= 0
    AND NOT (contains(p.file_path, '\\') AND regexp_matches(replace(p.file_path, '\\', '/'), '(^|/)\\.\\.(/|$)')) AS is_safe
  FROM paths p JOIN depth USING (file_path))"""


@query("path_safety", f"WITH {C.PATHS_SQL}, {SAFE_SQL} SELECT doc_id, file_path, is_safe FROM safe")
def path_safety(spark, sf_dir):
    return C.paths(spark, sf_dir).select(
        "doc_id", "file_path", P.is_safe(F.col("file_path")).alias("is_safe")
    )


@query("strict_path_check", f"""WITH {C.PATHS_SQL} SELECT doc_id, file_path,
  file_path <> '' AND position('..' IN file_path) = 0 AND left(file_path, 1) <> '/' AS accepted FROM paths""")
def strict_path_check(spark, sf_dir):
    return C.paths(spark, sf_dir).select(
        "doc_id", "file_path", P.is_strictly_safe(F.col("file_path")).alias("accepted")
    )


EXTENSIONS_SQL = ", ".join(quoted(e[1:]) for e in P.SOURCE_EXTENSIONS)
DIRECTORIES_SQL = ", ".join(quoted(d) for d in P.IGNORED_DIRECTORIES)
IGNORED_SQL = ", ".join(quoted(f) for f in P.IGNORED_FILES)


@query("analysable_files", f"""WITH {C.PATHS_SQL}, {SAFE_SQL},
turned AS (SELECT doc_id, file_path AS original, replace(file_path, '\\', '/') AS file_path FROM safe WHERE is_safe),
{NAMED_SQL.format(source="turned")}
SELECT doc_id, original AS file_path FROM named
WHERE NOT list_bool_or(list_transform(string_split(file_path, '/')[:-2], lambda d: lower(d) IN ({DIRECTORIES_SQL}) OR left(d, 1) = '.'))
   IS TRUE AND regexp_extract(file_path, '[^/]*$') NOT IN ({IGNORED_SQL})
  AND (regexp_extract(file_path, '[^/]*$') LIKE '.env%' OR regexp_extract(file_path, '[^/]*$') IN ('requirements.txt', 'package.json')
       OR ext IN ({EXTENSIONS_SQL}))""")
def analysable_files(spark, sf_dir):
    return ingest.analysable_files(C.paths(spark, sf_dir)).select("doc_id", "file_path")


@query("language_detection", f"""WITH {C.PATHS_SQL}, {NAMED_SQL.format(source="paths")}
SELECT doc_id, file_path, {LANGUAGE_SQL} AS language FROM named""")
def language_detection(spark, sf_dir):
    return C.paths(spark, sf_dir).select(
        "doc_id", "file_path", P.language(F.col("file_path")).alias("language")
    )


ROOT_SQL = """roots AS (SELECT repo, min(split_part(file_path, '/', 1)) AS root FROM files GROUP BY repo
  HAVING count(DISTINCT split_part(file_path, '/', 1)) = 1 AND bool_and(file_path LIKE '_%/%'))"""


@query("common_root", f"""WITH {C.ARCHIVE_SQL}, {ROOT_SQL}
SELECT repo, CASE WHEN root IS NULL THEN file_path ELSE substr(file_path, length(root) + 2) END AS file_path, md5(content) AS digest
FROM files LEFT JOIN roots USING (repo)""")
def common_root(spark, sf_dir):
    stripped = ingest.strip_common_root(C.archive_files(spark, sf_dir))
    return stripped.select("repo", "file_path", F.md5("content").alias("digest"))


@query("archive_limits", f"""WITH {C.ARCHIVE_SQL}, sized AS (
  SELECT *, octet_length(encode(content)) AS size FROM files),
fit AS (SELECT repo, file_path, size, CAST(count(*) FILTER (size <= 4000) OVER w AS BIGINT) AS n_files,
    CAST(coalesce(sum(size) FILTER (size <= 4000) OVER w, 0) AS BIGINT) AS total FROM sized
  WINDOW w AS (PARTITION BY repo ORDER BY file_path ROWS UNBOUNDED PRECEDING))
SELECT *, size <= 4000 AND n_files <= 30 AND total <= 40000 AS fits FROM fit""")
def archive_limits(spark, sf_dir):
    limits = ingest.Limits(files=30, file_size=4000, total_size=40_000)
    return ingest.limit_marks(C.archive_files(spark, sf_dir), limits)


@query("fetch_limits", f"""WITH {C.ARCHIVE_SQL}, ranked AS (
  SELECT repo, file_path, length(content) AS size, row_number() OVER w AS n_files,
    CAST(coalesce(sum(length(content)) FILTER (length(content) <= 5000) OVER w, 0) AS BIGINT) AS total FROM files
  WINDOW w AS (PARTITION BY repo ORDER BY file_path ROWS UNBOUNDED PRECEDING))
SELECT *, n_files <= 45 AND size <= 5000 AS fits FROM ranked""")
def fetch_limits(spark, sf_dir):
    limits = ingest.Limits(files=ingest.FETCH_LIMITS.files, file_size=5000, unit="characters", size_first=False)
    return ingest.limit_marks(C.archive_files(spark, sf_dir), limits)


SUFFIX_SQL = " OR ".join(f"ends_with(lower(file_path), {quoted(s)})" for s in P.FETCH_SUFFIXES)
EXCLUDED_SQL = " OR ".join(f"contains(lower(file_path), {quoted(s)})" for s in P.FETCH_EXCLUDED)


@query("fetch_candidates", f"""WITH {C.PATHS_SQL} SELECT doc_id, file_path FROM paths
WHERE NOT ({EXCLUDED_SQL}) AND ({SUFFIX_SQL})""")
def fetch_candidates(spark, sf_dir):
    return ingest.fetch_candidates(C.paths(spark, sf_dir)).select("doc_id", "file_path")


REFERENCE_SQL = """refs AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN url
  WHEN 1 THEN 'https://github.com/o' || page_id || '/r' || page_id || '.git/' WHEN 2 THEN ' o' || page_id || '/r.x '
  WHEN 3 THEN 'git@github.com:o/r' || page_id || '.git' WHEN 4 THEN 'https://www.github.com/o/r' || page_id || '/tree/main'
  WHEN 5 THEN 'o/r/' || page_id ELSE 'HTTPS://GITHUB.COM/O' || page_id || '/R//' END AS ref FROM pages)"""


def _references(spark, sf_dir):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 7
    ref = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.concat(F.lit("https://github.com/o"), n, F.lit("/r"), n, F.lit(".git/")))
        .when(kind == 2, F.concat(F.lit(" o"), n, F.lit("/r.x ")))
        .when(kind == 3, F.concat(F.lit("git@github.com:o/r"), n, F.lit(".git")))
        .when(kind == 4, F.concat(F.lit("https://www.github.com/o/r"), n, F.lit("/tree/main")))
        .when(kind == 5, F.concat(F.lit("o/r/"), n))
        .otherwise(F.concat(F.lit("HTTPS://GITHUB.COM/O"), n, F.lit("/R//")))
    )
    return table(spark, sf_dir, "pages").select("page_id", ref.alias("ref"))


@query("repository_reference", f"""WITH {REFERENCE_SQL},
clean AS (SELECT *, regexp_replace(trim(ref), '/$', '') AS c FROM refs),
found AS (SELECT *, regexp_extract(c, '(?:github\\.com/|^)([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)', ['o', 'r']) AS m,
   regexp_matches(c, 'github\\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+') AS long,
   regexp_matches(c, '^[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+$') AS short FROM clean)
SELECT page_id, ref, CASE WHEN long OR short THEN m.o END AS owner,
  CASE WHEN long OR short THEN regexp_replace(m.r, '\\.git$', '') END AS repo FROM found""")
def repository_reference(spark, sf_dir):
    parsed = _references(spark, sf_dir).withColumn("p", P.repository_reference(F.col("ref")))
    return parsed.select("page_id", "ref", "p.owner", "p.repo")


@query("repository_url_reference", f"""WITH {REFERENCE_SQL},
found AS (SELECT page_id, ref, regexp_extract(regexp_replace(regexp_replace(trim(ref), '/+$', ''), '\\.git$', ''),
   '(?i)github\\.com[/:]([a-zA-Z0-9_.-]+)/([a-zA-Z0-9_.-]+)', ['o', 'r']) AS m FROM refs)
SELECT page_id, ref, nullif(m.o, '') AS owner, nullif(m.r, '') AS repo FROM found""")
def repository_url_reference(spark, sf_dir):
    parsed = _references(spark, sf_dir).withColumn("p", P.repository_url_reference(F.col("ref")))
    return parsed.select("page_id", "ref", "p.owner", "p.repo")


@query("line_table", f"""WITH {C.SEEDED_SQL}, {C.LINES_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, line, trimmed FROM lines""")
def line_table(spark, sf_dir):
    exploded = lines.explode_lines(C.seeded_files(spark, sf_dir))
    return exploded.select("repo", "file_path", "line_no", "line", "trimmed")


@query("code_volume", f"""WITH {C.SEEDED_SQL}
SELECT repo, count(*) AS total_files, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS total_lines
FROM files GROUP BY repo""")
def code_volume(spark, sf_dir):
    return lines.code_volume(C.seeded_files(spark, sf_dir))


@query("line_classes", f"""WITH {C.WORDS_SQL}, t AS (SELECT repo, trim(line, {C.BLANKS}) AS t FROM lines),
c AS (SELECT repo, CASE WHEN t = '' THEN 'blank' WHEN t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' OR t LIKE '*%' THEN 'comment'
        ELSE 'code' END AS line_class,
   t LIKE '//%' OR t LIKE '#%' OR t LIKE '/*%' AS h, t LIKE '//%' OR t LIKE '#%' OR t LIKE '*%' AS s, t LIKE '#%' AS p FROM t)
SELECT repo, line_class, count(*) AS n, count(*) FILTER (h) AS heuristic_comments, count(*) FILTER (s) AS shared_comments,
  count(*) FILTER (p) AS python_comments FROM c GROUP BY repo, line_class""")
def line_classes(spark, sf_dir):
    exploded = lines.explode_lines(C.word_files(spark, sf_dir))
    tests = lines.comment_tests(F.col("trimmed"))
    return (
        exploded.withColumns(tests)
        .groupBy("repo", lines.line_class(F.col("trimmed")).alias("line_class"))
        .agg(
            F.count("*").alias("n"),
            *[F.count_if(f"{name}_comment").alias(f"{name}_comments") for name in ("heuristic", "shared", "python")],
        )
    )


@query("file_routing", f"""WITH {C.PATHS_SQL} SELECT doc_id, file_path,
  regexp_matches(file_path, '(?i)\\.(js|jsx|ts|tsx|mjs|cjs)$') AS is_js, ends_with(file_path, '.py') AS is_python FROM paths""")
def file_routing(spark, sf_dir):
    path = F.col("file_path")
    return C.paths(spark, sf_dir).select(
        "doc_id", "file_path", P.is_js(path).alias("is_js"), P.is_python(path).alias("is_python")
    )
