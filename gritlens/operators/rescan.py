"""Scanning a table of files again: only files whose contents changed pass the rules.

Every run leaves three folders below ``path``: ``files/run=N`` (a small row per file:
digest, sums, the run that scanned it), ``findings/run=N`` (of the files scanned in that
run only) and ``sums/run=N`` (a row per scan). Unchanged files carry their row over, and
with it their findings, which stay where they are. Sums take the differences: what a
file added before is withdrawn when it changes or goes.

A run reads the one before it and writes its own folders, so it may be run again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens.operators import scoring, security, standing
from gritlens.session import written

KEY = ["scan_id", "file_path"]
STATE = ["scan_id", "repo", "file_path", "digest", "scanned_in", *scoring.ADDED]


def with_digest(files: DataFrame) -> DataFrame:
    """The files' own ``digest`` column (a blob id, a time with a size) or the hash of the contents.

    With a digest of their own, contents are not read to find out what changed.
    """
    if "digest" in files.columns:
        return files
    return files.withColumn("digest", F.sha2(F.coalesce("content", F.lit("")), 256))


def _matching(left: DataFrame, right: DataFrame, how: str, *names: str) -> DataFrame:
    """Rows of ``left`` with (left_semi) or without (left_anti) a row in ``right``; null is a value like others."""
    other = right.select(*[F.col(n).alias(f"_r_{n}") for n in names])
    tests: list[Column] = [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in names]
    return left.join(other, reduce(lambda a, b: a & b, tests), how)


def _scanned(items: DataFrame, changed: DataFrame, run: int) -> DataFrame:
    """The state rows of files just scanned. Copies of a file add alike, so one of them is a share of the sum."""
    totals = scoring.file_totals(items).withColumns({name: F.expr(f"{name} div total_files") for name in scoring.ADDED})
    digests = changed.select(*[F.col(n).alias(f"_r_{n}") for n in KEY], "digest")
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in KEY])
    return totals.join(digests, same).withColumn("scanned_in", F.lit(run)).select(*STATE)


def rescan(files: DataFrame, path: str, run: int, **options) -> None:
    """Scan what changed since run ``run - 1``; run 0 scans everything.

    A file is known by its scan and path. Of rows that share both, the one with the
    largest digest counts, once. Changed files are told by eight bytes each, so that a long
    list of them can still be sent to every task, as Spark measures; contents are shuffled
    only beyond that. A file that is taken for a changed one by chance of its eight bytes is
    scanned in vain: its row isn't replaced and its findings of this run aren't read.
    ``options`` go to ``security.scan_items``; a change of them (or of rules) needs a new run 0.
    """
    spark = files.sparkSession
    files = with_digest(security.with_scan_id(files))
    present = written(
        files.groupBy(*KEY).agg(F.max("digest").alias("digest"), F.min("digest").alias("_least")), "present"
    )
    changed = present
    if run:
        stored = spark.read.parquet(f"{path}/files/run={run - 1}")
        changed = written(_matching(present, stored, "left_anti", *KEY, "digest"), "changed")
    # in run 0 all files are scanned; a join is needed only to choose among rows of one path
    if run or not present.where(~F.col("digest").eqNullSafe(F.col("_least"))).isEmpty():
        mark = F.xxhash64(*KEY, "digest")
        files = files.join(changed.select(mark.alias("_mark")), mark == F.col("_mark"), "left_semi")
    items = written(security.scan_items(files, **options), "scan-items")
    fresh = written(_scanned(items, changed, run), "scanned")
    found = security.as_findings(items).dropDuplicates(["finding_id"])
    found.write.mode("overwrite").parquet(f"{path}/findings/run={run}")
    by = ["scan_id", "repo"]
    if run:
        gone = _matching(stored, present, "left_anti", *KEY, "digest")
        gained = standing.differences(gone, fresh, by, scoring.ADDED)
        sums = standing.merged(spark.read.parquet(f"{path}/sums/run={run - 1}"), gained, by, scoring.ADDED, "total_files")
        fresh = _matching(stored, present, "left_semi", *KEY, "digest").select(*STATE).unionByName(fresh)
    else:
        sums = standing.summed(fresh, by, scoring.ADDED)
    sums.write.mode("overwrite").parquet(f"{path}/sums/run={run}")
    fresh.write.mode("overwrite").parquet(f"{path}/files/run={run}")


def totals(spark: SparkSession, path: str, run: int) -> DataFrame:
    """Scan totals and scores after a run, from the kept sums."""
    return scoring.scored(spark.read.parquet(f"{path}/sums/run={run}"))


def findings(spark: SparkSession, path: str, run: int) -> DataFrame:
    """All findings after a run: those of each file from the run that scanned it."""
    state = spark.read.parquet(f"{path}/files/run={run}").withColumn("run", F.col("scanned_in"))
    found = spark.read.parquet(f"{path}/findings").where(F.col("run") <= run)
    return _matching(found, state, "left_semi", *KEY, "run").drop("run")


def changes(spark: SparkSession, path: str, run: int) -> DataFrame:
    """Files that a run found ADDED, CHANGED or REMOVED."""
    now = spark.read.parquet(f"{path}/files/run={run}")
    before = spark.read.parquet(f"{path}/files/run={run - 1}")
    new = _matching(now, before, "left_anti", *KEY, "digest").select(*KEY, F.lit(1).alias("n"))
    old = _matching(before, now, "left_anti", *KEY, "digest").select(*KEY, F.lit(2).alias("n"))
    status = F.when(F.sum("n") == 3, F.lit("CHANGED")).when(F.sum("n") == 1, F.lit("ADDED")).otherwise(F.lit("REMOVED"))
    return new.union(old).groupBy(*KEY).agg(status.alias("status"))
