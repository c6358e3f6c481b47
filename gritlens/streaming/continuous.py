"""Scanning files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gritlens.operators import scoring, security
from gritlens.session import written

COMPACTED = -1  # before every batch, so that whatever arrives later takes its place


def start_findings(
    files: DataFrame, out: str, checkpoint: str, quality: bool = True, **trigger
) -> StreamingQuery:
    """Append the findings of arriving files to a table. Keeps no state."""
    trigger = trigger or {"availableNow": True}
    return (
        security.findings(files, quality=quality)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .outputMode("append")
        .start()
    )


def start_history(files: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep what is known of every file of every scan, micro-batch by micro-batch.

    Two logs below ``path`` grow by one folder per batch: ``files`` with the sums
    of each file (lines, severity counts, penalties) and ``findings``. Nothing that
    was stored before is read. A batch that is run again replaces its own folder,
    so it changes nothing; a file that arrives again in a later batch takes the
    place of its earlier rows, findings too. ``stored_scans`` and
    ``stored_findings`` read the state. A scan's files may come in any batches.
    """
    trigger = trigger or {"availableNow": True}

    def store(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        items = written(security.scan_items(batch), "scan-items")
        found = security.as_findings(items)
        scoring.file_totals(items).write.mode("overwrite").parquet(f"{path}/files/batch_id={batch_id}")
        found.write.mode("overwrite").parquet(f"{path}/findings/batch_id={batch_id}")

    return (
        files.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def _latest_files(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every file; of a key that came very often one row per task travels."""
    log = spark.read.parquet(f"{path}/files")
    rest = [c for c in log.columns if c not in ("scan_id", "file_path")]
    newest = log.groupBy("scan_id", "file_path").agg(F.max_by(F.struct(*rest), "batch_id").alias("_row"))
    return newest.select("scan_id", "file_path", "_row.*")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Copy the newest state of a history, one folder per log, to the folder ``to``.

    Rows that later batches replaced stay behind. Meant between two runs of the stream: the next
    one goes on below ``to`` with the same checkpoint. A batch that is run again there only takes
    the place of equal rows. Readers of ``path`` are not disturbed; it may go when they are done.
    """
    newest = written(_latest_files(spark, path), "newest-files")
    found = spark.read.parquet(f"{path}/findings").join(
        newest.select("scan_id", "file_path", "batch_id"), ["scan_id", "file_path", "batch_id"], "left_semi"
    )
    for name, rows in (("findings", found), ("files", newest)):
        rows.drop("batch_id").write.mode("overwrite").parquet(f"{to}/{name}/batch_id={COMPACTED}")


def stored_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan totals and scores over the newest state of their files."""
    return scoring.totals_of_files(_latest_files(spark, path))


def stored_findings(spark: SparkSession, path: str) -> DataFrame:
    """The findings of the newest state of every file."""
    found = spark.read.parquet(f"{path}/findings")
    current = _latest_files(spark, path).select("scan_id", "file_path", "batch_id")
    return found.join(current, ["scan_id", "file_path", "batch_id"], "left_semi").drop("batch_id")
