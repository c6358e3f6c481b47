import posixpath
import random

from pyspark.sql import functions as F

from gritlens.functions import paths as P
from gritlens.operators import ingest, lines
from gritlens.plans import skew
from gritlens.sources import files as sources


def safe(path):
    if not path:
        return False
    norm = posixpath.normpath(path).replace("\\", "/")
    return not (norm.startswith("../") or "/../" in norm or norm == ".." or norm.startswith("/"))


def test_path_safety(spark):
    rng = random.Random(1)
    parts = ["a", "..", ".", "b.js", "", "..\\x", "c\\..\\d", "..."]
    paths = ["", "/", "..", ".", "a/../b", "../../etc/passwd", "..\\..\\windows\\system32", "/root/.ssh/id_rsa", "\\etc"]
    paths += ["/".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(400)]
    frame = spark.createDataFrame([(p,) for p in paths], "p string")
    rows = frame.select("p", P.is_safe(F.col("p")).alias("s"), P.is_strictly_safe(F.col("p")).alias("strict")).collect()
    # normpath keeps a leading double slash; both forms are absolute
    assert [(r.p, r.s) for r in rows if r.s != safe(r.p)] == []
    assert all(r.strict == (bool(r.p) and ".." not in r.p and not r.p.startswith("/")) for r in rows)


def test_extensions_and_languages(spark):
    expected = {
        "a.TS": "typescript", "x/.env": "env", "x/.ENV.local": "env", "package.json": "json", "requirements.txt": "requirements",
        "a.tar.yml": "yaml", "Makefile": "plaintext", ".bashrc": "plaintext", "a.": "plaintext", "b.mjs": "javascript", "c.rb": "ruby",
    }
    frame = spark.createDataFrame([(p,) for p in expected], "p string")
    assert {r.p: r.l for r in frame.select("p", P.language(F.col("p")).alias("l")).collect()} == expected


def test_analysable(spark):
    yes = ["src/a.ts", "a.PY", ".env", ".env.local", "x/requirements.txt", "a/b/package.json", "a/b.go"]
    no = ["node_modules/a.js", "a/Dist/b.js", ".hidden/a.py", "a/.venv/b.py", "yarn.lock", "a/package-lock.json", "README.md", "../a.js",
          "/a.js", "a\\tmp\\b.js", "", ".bashrc"]
    frame = spark.createDataFrame([(p,) for p in yes + no], "p string")
    assert {r.p for r in frame.where(P.is_analysable(F.col("p"))).collect()} == set(yes)


def test_repository_references(spark):
    cases = {
        "https://github.com/o/r.git": ("o", "r"), "https://github.com/o/r/": ("o", "r"), "o/r.git": ("o", "r"), " o/r ": ("o", "r"),
        "https://github.com/o/r/tree/x": ("o", "r"), "o/r/x": None, "git@github.com:o/r.git": None, "plain": None,
    }
    frame = spark.createDataFrame([(p,) for p in cases], "p string")
    rows = frame.select("p", P.repository_reference(F.col("p")).alias("r")).collect()
    assert {r.p: (tuple(r.r) if r.r else None) for r in rows} == cases
    older = frame.select("p", P.repository_url_reference(F.col("p")).alias("r")).collect()
    assert {r.p: tuple(r.r) for r in older if r.r}["git@github.com:o/r.git"] == ("o", "r")


def make(spark, rows):
    return spark.createDataFrame(rows, "repo string, file_path string, content string")


def test_common_root(spark):
    files = make(spark, [("a", "m/x.py", ""), ("a", "m/y/z.py", ""), ("b", "m/x.py", ""), ("b", "n.py", ""), ("c", "/m/x.py", ""), ("d", "one/f", "")])
    out = {(r.repo, r.file_path) for r in ingest.strip_common_root(files).collect()}
    assert out == {("a", "x.py"), ("a", "y/z.py"), ("b", "m/x.py"), ("b", "n.py"), ("c", "/m/x.py"), ("d", "f")}


def test_limits_follow_the_loop(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"r{n % 7}", f"p{n:04d}.py", "é" * rng.randint(0, 40)) for n in range(600)]
    for limits in (ingest.Limits(files=20, file_size=60, total_size=900), ingest.Limits(files=15, file_size=30, unit="characters", size_first=False),
                   ingest.Limits(total_size=700), ingest.Limits(file_size=50), ingest.Limits(files=5)):
        expected = set()
        for repo in {r[0] for r in rows}:
            kept = total = 0
            for _, path, text in sorted(r for r in rows if r[0] == repo):
                size = len(text.encode()) if limits.unit == "bytes" else len(text)
                fits = limits.file_size is None or size <= limits.file_size
                if limits.size_first and not fits:
                    continue
                if limits.files is not None and kept >= limits.files:
                    break
                if not limits.size_first:
                    kept += 1
                    if not fits:
                        continue
                total += size
                if limits.total_size is not None and total > limits.total_size:
                    break
                if limits.size_first:
                    kept += 1
                expected.add((repo, path))
        got = {(r.repo, r.file_path) for r in ingest.within_limits(make(spark, rows), limits).collect()}
        assert got == expected, limits


def test_running_totals_cut_a_hot_group(spark):
    frame = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise(F.lit("hot")).alias("g"),
        F.col("id").alias("o"), (F.col("id") % 11).alias("v"),
    )
    out = skew.running_totals(frame, ["g"], ["o"], {"n": F.lit(1), "total": F.col("v")}).collect()
    expected, n, total = {}, {}, {}
    for r in frame.orderBy("o").collect():
        n[r.g] = n.get(r.g, 0) + 1
        total[r.g] = total.get(r.g, 0) + r.v
        expected[(r.g, r.o)] = (n[r.g], total[r.g])
    assert {(r.g, r.o): (r.n, r.total) for r in out} == expected


def test_sources(spark, tmp_path):
    for path, text in {"r1/src/a.py": "x = 1\n", "r1/b c.js": "é", "r2/c.go": "package c"}.items():
        target = tmp_path / "tree" / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    files = sources.read_folder(spark, str(tmp_path / "tree"))
    rows = {(r.repo, r.file_path, r.content, r.language, r.size) for r in files.collect()}
    assert rows == {("r1", "src/a.py", "x = 1\n", "python", 6), ("r2", "c.go", "package c", "go", 9),
                    ("r1", "b c.js", "é", "javascript", 2)}
    files.write.json(str(tmp_path / "json"))
    assert {r.content for r in sources.read_files(spark, str(tmp_path / "json"), "json").collect()} == {"x = 1\n", "é", "package c"}
    snippets = spark.createDataFrame([("  x ",), (" \n",), ("",)], "code string")
    kept = sources.snippet_files(snippets).collect()
    assert [(r.repo, r.file_path, r.content, r.language, r.size) for r in kept] == [("ad-hoc-snippet", "snippet.ts", "  x ", "typescript", 4)]


def test_line_numbers(spark):
    files = make(spark, [("r", "a", "x\n\n y \n"), ("r", "b", "")])
    rows = [(r.file_path, r.line_no, r.line, r.trimmed) for r in lines.explode_lines(files).collect()]
    assert rows == [("a", 1, "x", "x"), ("a", 2, "", ""), ("a", 3, " y ", "y"), ("a", 4, "", ""), ("b", 1, "", "")]
    volume = lines.code_volume(files).first()
    assert (volume.total_files, volume.total_lines) == (2, 5)


def test_archive_preparation(spark):
    files = make(spark, [("z", "main/src/a.py", "1"), ("z", "main/node_modules/b.js", "2"), ("z", "main/../../c.py", "3"), ("z", "main/d.py", "4")])
    assert {r.file_path for r in ingest.prepare_archive(files, ingest.ARCHIVE_LIMITS).collect()} == {"src/a.py", "d.py"}


def test_row_numbers_over_large_and_small_groups(spark):
    """Groups above the bound are cut into stretches, the others not; rows without a group go."""
    rows = [("hot", i * 7919 % 5000) for i in range(5000)] + [(f"g{i % 40}", i // 40) for i in range(400)] + [(None, 1)]
    rows += [("warm", i) for i in range(101)] + [("warm", None)]
    frame = spark.createDataFrame(rows, "g string, o int").repartition(16)
    for large in (100, 10_000):
        out = [tuple(r) for r in skew.row_numbers(frame, "g", ["o"], "n", large).collect()]
        expected = [(g, o, o + 1) for g, o in rows if g not in (None, "warm")]
        expected += [("warm", i, i + 2) for i in range(101)] + [("warm", None, 1)]
        assert sorted(out, key=repr) == sorted(expected, key=repr)


def test_row_numbers_shuffle_rows_once(spark):
    frame = spark.range(1000).selectExpr("id % 7 AS g", "id AS o", "repeat('x', 100) AS content")
    plan = skew.row_numbers(frame, "g", ["o"], "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
