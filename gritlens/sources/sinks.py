"""Writing results: partitioned tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def write_scans(scans: DataFrame, path: str, mode: str = "append", period: str = "week") -> None:
    """Scans by the week (month, year) they started, so that history queries prune."""
    dated = scans.withColumn("scan_date", F.trunc("started_at", period))
    _balanced(dated, "scan_date").write.mode(mode).partitionBy("scan_date").parquet(path)


def scan_bucket(scan_id: Column) -> Column:
    """The folder that the findings of a scan lie in."""
    return F.pmod(F.xxhash64(scan_id), F.lit(BUCKETS)).cast("int")


def write_findings(findings: DataFrame, path: str, mode: str = "append") -> None:
    """Findings by a hash of their scan, so that a look-up of one scan reads one folder."""
    placed = findings.withColumn("scan_bucket", scan_bucket(F.col("scan_id")))
    _balanced(placed, "scan_bucket").write.mode(mode).partitionBy("scan_bucket").parquet(path)


def read_findings_of(spark: SparkSession, path: str, scan_id: str) -> DataFrame:
    """The stored findings of one scan; the other folders are pruned."""
    bucket = spark.range(1).select(scan_bucket(F.lit(scan_id))).first()[0]
    return spark.read.parquet(path).where((F.col("scan_bucket") == bucket) & (F.col("scan_id") == scan_id)).drop("scan_bucket")


def write_documents(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Document rows (scan_id, number, text) in order."""
    rows.repartitionByRange("scan_id", "number").sortWithinPartitions("scan_id", "number").write.mode(mode).parquet(path)


def _balanced(df: DataFrame, by: str) -> DataFrame:
    """Rows of one partition folder together, in files of the advised size.

    Without it every task leaves a small file in every folder; a large folder is
    still split over tasks.
    """
    return df.hint("rebalance", F.col(by))


def write_table(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per row."""
    df.write.mode(mode).json(path)
