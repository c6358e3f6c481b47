"""The search index gives what the plain search gives and reads less."""

import random

import pytest

from gritlens.operators import history, search_index

WORDS = ["SQL", "Injection", "eval()", "CVE-2021-1", "é\U0001f600x", "50%", "a_b", "path\\x", "\n", " ", "İ", "aaa", "aaaa"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    rows = [
        (f"f{i}", rng.choice(["HIGH", "LOW"]), rng.choice(["SECURITY", "DOCUMENTATION"]), text(3), text(2), text(6), None if i % 3 else text(2),
         text(4), (None, None, None, text(1) if i % 2 else None)) for i in range(400)
    ]
    frame = spark.createDataFrame(rows, (
        "finding_id string, severity string, category string, title string, file_path string, code_snippet string, node_type string, "
        "description string, dependency_info struct<package_name:string,installed_version:string,fixed_version:string,cve:string>"
    ))
    path = str(tmp_path_factory.mktemp("index"))
    search_index.write_index(frame.where("finding_id < 'f3'"), path)
    search_index.write_index(frame.where("finding_id >= 'f3'"), path)
    return frame, path


@pytest.mark.parametrize("query", ["injection", "INJ", "sqlinj", "aaaa", "a_b5", "0%", "é", "", "  ", " é\U0001f600", "path\\xs", "\n \n", "nowhere", "cve-2021-1", "i̇"])
def test_same_as_the_plain_search(spark, stored, query):
    frame, path = stored
    for severity, category in (("ALL", "ALL"), ("HIGH", "SECURITY")):
        expected = sorted(map(repr, history.search_findings(frame, query, severity, category).collect()))
        found = search_index.search(spark, path, query, severity, category).select(*frame.columns)
        assert sorted(map(repr, found.collect())) == expected


def test_reads_few_folders(spark, stored):
    _, path = stored
    plan = search_index.search(spark, path, "eval()")._jdf.queryExecution().executedPlan().toString()
    assert "list_folder" in plan.split("PartitionFilters: [", 1)[1]
    assert "dynamicpruning" in plan


def test_empty_index(spark, stored, tmp_path):
    frame, _ = stored
    search_index.write_index(frame.limit(0), str(tmp_path / "none"))
    frame.limit(1).write.parquet(str(tmp_path / "one"))
    search_index.write_index(frame.where("finding_id = 'f1'"), str(tmp_path / "none"))
    assert search_index.search(spark, str(tmp_path / "none"), "no such text").count() == 0


def test_lists_follow_blocks_not_findings(spark, tmp_path):
    """Ten thousand findings with the same words: a row for each triple and block, not for each finding."""
    frame = spark.range(10_000).selectExpr(
        "cast(id as string) AS finding_id", "'HIGH' AS severity", "'SECURITY' AS category",
        "if(id = 7777, 'needle', 'Potential SQL Injection Risk') AS title",
    )
    path = str(tmp_path / "index")
    search_index.write_index(frame, path)
    lists, rows = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/rows")
    blocks = rows.selectExpr("row_folder", "row_no div 1024 AS block").distinct().count()
    assert lists.count() <= blocks * 26 + 4 and lists.count() < 2 * 10_000
    assert lists.groupBy("row_folder", "block", "triple").count().where("count > 1").count() == 0
    assert [r.finding_id for r in search_index.search(spark, path, "NEEDLE").collect()] == ["7777"]
    assert search_index.search(spark, path, "injection").count() == 9_999
