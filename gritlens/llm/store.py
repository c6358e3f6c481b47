"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens.session import scratch_path


class Stage:
    """Tables written once and read many times; lost executors lose nothing of them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, table: DataFrame) -> None:
        """Delete a table of ``keep`` that nothing reads any more."""
        path = self._paths.pop(id(table), None)
        if path:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run within leave no shuffle files, unless the session says itself whether they do.

    Without it the files of all queries of an operator stay on the executors' disks until
    the driver happens to collect its garbage. Nothing reads them: what a query gave is a table.
    """
    if spark.conf.get(SHUFFLE_CLEANUP, None) is not None:
        yield
        return
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Python workers get their rows in batches of about ``most`` bytes, unless the session names a size itself.

    By rows alone a batch of long texts takes tens of megabytes, in the executor
    and in the worker, and neither gives them back. The setting stays: plans read
    it when they run.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, most)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs meets one of an operator's; ``row.*`` gives them back."""
    return F.struct(*[_column(c) for c in df.columns])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns; those of types that have none are hashed as text."""
    hashless = ("map<", "variant")
    return F.xxhash64(*[
        _column(f.name).cast("string") if any(t in f.dataType.simpleString() for t in hashless) else _column(f.name) for f in df.schema
    ])


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def tasks_for(df: DataFrame) -> int:
    """Shuffle partitions set for the session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
