"""From files to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions import paths
from gritlens.functions import text as X

# Which lines count as comments differs between the rule families.
COMMENT_MARKS = {
    "heuristic": ("//", "#", "/*"),
    "shared": ("//", "#", "*"),
    "python": ("#",),
    "quality": ("//", "#", "/*", "*"),
}


def line_count(content: Column) -> Column:
    """Lines of a text; an empty text has one."""
    text = F.coalesce(content, F.lit(""))
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def explode_lines(files: DataFrame, *keep: str) -> DataFrame:
    """One row per line, numbered from 1, with the trimmed text and file routing.

    Only ``keep`` columns travel along, so the content itself is not repeated.
    """
    carried = [c for c in ("scan_id", "repo", "file_path", *keep) if c in files.columns]
    routed = files.select(
        *carried,
        paths.is_js(F.col("file_path")).alias("is_js"),
        paths.is_python(F.col("file_path")).alias("is_python"),
        "content",
    )
    return (
        routed.select("*", F.posexplode(X.split_lines(F.col("content"))).alias("pos", "line"))
        .withColumn("line_no", F.col("pos") + 1)
        .withColumn("trimmed", X.trim(F.col("line")))
        .drop("pos", "content")
    )


def comment_tests(trimmed: Column) -> dict[str, Column]:
    """One boolean per comment convention."""
    return {f"{name}_comment": X.starts_with_any(trimmed, marks) for name, marks in COMMENT_MARKS.items()}


def line_class(trimmed: Column) -> Column:
    """blank / comment / code in the sense of the quality rules."""
    comment = X.starts_with_any(trimmed, COMMENT_MARKS["quality"])
    return F.when(trimmed == "", F.lit("blank")).when(comment, F.lit("comment")).otherwise(F.lit("code"))


def code_volume(files: DataFrame) -> DataFrame:
    """Files and lines per repository."""
    return files.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.sum(line_count(F.col("content"))).cast("bigint").alias("total_lines"),
    )
