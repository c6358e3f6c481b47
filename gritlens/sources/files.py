"""Where source files come from: tables, folders, submitted snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens.functions import paths
from gritlens.functions import text as X

# What an ad-hoc snippet is called unless the sender says.
SNIPPET_FILE = "snippet.ts"
SNIPPET_REPO = "ad-hoc-snippet"


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Spread a table that the scan cuts into fewer parts than there are cores.

    The parts follow ``spark.sql.files.maxPartitionBytes``, so a large table has
    many, in few files or in many, and is left alone: no shuffle of contents.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if parts >= cores else df.repartition(cores, *by)


def describe(files: DataFrame) -> DataFrame:
    """Add language and byte size to (repo, file_path, content)."""
    return files.withColumn("language", paths.language(F.col("file_path"))).withColumn(
        "size", F.octet_length("content").cast("bigint")
    )


def read_files(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A files table with at least repo, file_path, content."""
    files = spark.read.format(fmt)
    if fmt == "json":
        files = files.schema("repo string, file_path string, content string")
    return describe(files.load(path).select("repo", "file_path", "content"))


def read_folder(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Every file below ``root``; the first folder level is the repository.

    Spark's readers leave out files of length 0.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    below = F.regexp_replace(
        F.col("path"), "^.*?" + _quoted(root.rstrip("/").removeprefix("file:")) + "/", ""
    )
    return describe(
        reader.load(root)
        .withColumn("below", below)
        .select(
            F.substring_index("below", "/", 1).alias("repo"),
            F.regexp_replace("below", "^[^/]*/", "").alias("file_path"),
            F.decode("content", "UTF-8").alias("content"),
        )
    )


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def snippet_files(snippets: DataFrame) -> DataFrame:
    """Submitted code (``code``, optional ``file_name``, ``name``) as files.

    Blank code is rejected; the content is kept untrimmed.
    """

    def given(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in snippets.columns else F.lit(default)

    return describe(
        snippets.where(X.trim(F.col("code")) != "").select(
            given("name", SNIPPET_REPO).alias("repo"),
            given("file_name", SNIPPET_FILE).alias("file_path"),
            F.col("code").alias("content"),
        )
    )
