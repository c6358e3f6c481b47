"""Substring search over stored findings that reads few of them.

Findings lie in folders, numbered in the order they lie in, and 1,024 neighbours of a folder
are a block. Every three characters (of any searched column, in lower case) that occur in a
block are listed once, with a mask that tells which sixteenths of 64 rows hold them: bit n is
for the n-th 16 findings of the block. A text of three or more characters can only be in
findings whose bit is set for all of its own triples, so a search reads the folders of these
triples, lays their masks over each other, reads the folders of the findings that remain
(pruned when the query runs) and tests them as the plain search does. Shorter texts read all
findings.

A list has one row for each triple and block, however many findings of the block have the
triple. So its length follows the different triples of a block, not the characters of all
findings, and a triple that most findings have costs a row in 1,024 of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens.operators.history import SEARCHED, search_findings

LENGTH = 3
BLOCK_SHIFT, BIT_SHIFT = 10, 4  # 1,024 findings a block, 16 a bit
ROW_FOLDERS, LIST_FOLDERS = 256, 128


def triples(text: Column) -> Column:
    """All stretches of three characters, also overlapping ones, each once; none of null."""
    found = F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{%d}))" % LENGTH), F.lit(1))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _folder(value: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(folders)).cast("int")


def _columns(findings: DataFrame) -> list[Column]:
    named = [F.col(name) for name in SEARCHED if name in findings.columns]
    if "cve" not in findings.columns and "dependency_info" in findings.columns:
        named.append(F.col("dependency_info.cve"))
    return named


def _block(number: Column) -> Column:
    return F.shiftright(number, BLOCK_SHIFT)


def _mask(number: Column) -> Column:
    """The bit of a finding in the masks of its block."""
    bit = F.shiftright(number, BIT_SHIFT).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)


def write_index(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Findings and their lists below ``path``; later findings may be appended, each id once."""
    spark = findings.sparkSession
    batch = uuid.uuid4().int % 2**31  # tells apart the numbers of findings that were appended
    # each folder's rows stand together before they are numbered, so a block lies in one folder
    placed = (
        findings.withColumn("row_folder", _folder(F.col("finding_id"), ROW_FOLDERS))
        .hint("rebalance", F.col("row_folder")).sortWithinPartitions("row_folder")
        .withColumns({"row_batch": F.lit(batch), "row_no": F.monotonically_increasing_id()})
    )
    placed.write.mode(mode).partitionBy("row_batch", "row_folder").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows").where(F.col("row_batch") == batch)
    every = F.array_distinct(F.flatten(F.array(*[triples(c) for c in _columns(findings)])))
    lists = (
        stored.select("row_batch", "row_folder", "row_no", F.explode(every).alias("triple"))
        .groupBy("row_batch", "row_folder", _block(F.col("row_no")).alias("block"), "triple")
        .agg(F.bit_or(_mask(F.col("row_no"))).alias("mask"))
        .withColumn("list_folder", _folder(F.col("triple"), LIST_FOLDERS))
    )
    lists.hint("rebalance", F.col("list_folder")).sortWithinPartitions("list_folder", "triple", "block").write.mode(mode).partitionBy(
        "list_folder"
    ).parquet(f"{path}/lists")


def search(spark: SparkSession, path: str, query: str = "", severity: str = "ALL", category: str = "ALL") -> DataFrame:
    """What ``search_findings`` gives over all findings of the index."""
    rows = spark.read.parquet(f"{path}/rows")
    needle = query.lower()
    parts = sorted({needle[i : i + LENGTH] for i in range(len(needle) - LENGTH + 1)}) if query.strip() else []
    if parts:
        folders = spark.range(1).select(F.array_distinct(F.array(*[_folder(F.lit(p), LIST_FOLDERS) for p in parts]))).first()[0]
        listed = spark.read.parquet(f"{path}/lists").where(F.col("list_folder").isin(folders) & F.col("triple").isin(parts))
        named = (
            listed.groupBy("row_batch", "row_folder", "block")
            .agg(F.count("*").alias("n"), F.bit_and("mask").alias("mask"))
            .where((F.col("n") == len(parts)) & (F.col("mask") != 0))
        )
        place = ["row_batch", "row_folder", "block"]
        rows = rows.withColumn("block", _block(F.col("row_no"))).alias("rows").join(
            named.alias("named"),
            [F.col(f"rows.{c}") == F.col(f"named.{c}") for c in place]
            + [F.col("named.mask").bitwiseAND(_mask(F.col("rows.row_no"))) != 0],
            "left_semi",
        ).drop("block")
    return search_findings(rows, query, severity, category).drop("row_batch", "row_folder", "row_no")
