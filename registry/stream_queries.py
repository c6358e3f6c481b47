"""Scanning files as a stream; the result is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.session import scratch_path
from gritlens.streaming import continuous
from registry import corpora as C
from registry.base import query
from registry.rule_queries import KEPT_SQL
from registry.score_queries import QUALITY_SQL, TOTALS_SQL

FOUND_SQL = f"{C.SEEDED_SQL}, {KEPT_SQL}"


def _arriving_files(spark, sf_dir):
    """The seeded documents, read as a stream of two batches that cut through repositories.

    Both halves lie in as many files as the table has parts; a batch takes as many files
    as the larger number of both, and files are taken in the order they were written.
    """
    folder = scratch_path(spark, "arriving")
    documents = C.documents(spark, sf_dir)
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    documents.where(half == 0).write.parquet(folder)
    stored = spark.read.schema(documents.schema)
    first = len(stored.parquet(folder).inputFiles())
    documents.where(half == 1).write.mode("append").parquet(folder)
    batch = max(first, len(stored.parquet(folder).inputFiles()) - first)
    arriving = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", batch).parquet(folder)
    s = C.snippet_table(spark)
    return arriving.join(s, F.col("doc_id") % C.COUNT == F.col("i")).select(
        F.col("source").alias("repo"),
        F.concat(F.lit("src/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("ext")).alias("file_path"),
        F.concat("snippet", F.lit("\n"), "text").alias("content"),
    )


@query("stream_findings", f"""WITH {C.SEEDED_SQL}, {KEPT_SQL}, {QUALITY_SQL}
SELECT repo, severity, category, count(*) AS n FROM everything GROUP BY ALL""")
def stream_findings(spark, sf_dir):
    """All findings of the stream, of every category, by repository and severity."""
    out = scratch_path(spark, "stream-findings")
    continuous.start_findings(
        _arriving_files(spark, sf_dir), out, scratch_path(spark, "stream-state")
    ).awaitTermination()
    return spark.read.parquet(out).groupBy("repo", "severity", "category").agg(F.count("*").alias("n"))


@query("stream_security_findings", f"""WITH {FOUND_SQL}
SELECT repo, file_path, CAST(line_no AS INTEGER) AS line_no, rule_id, severity FROM kept""")
def stream_security_findings(spark, sf_dir):
    """The security findings of the stream one by one."""
    out = scratch_path(spark, "stream-findings")
    continuous.start_findings(
        _arriving_files(spark, sf_dir), out, scratch_path(spark, "stream-state"), quality=False
    ).awaitTermination()
    return spark.read.parquet(out).select("repo", "file_path", "line_no", "rule_id", "severity")


@query("stream_history", TOTALS_SQL)
def stream_history(spark, sf_dir):
    """Totals and scores of scans whose files came in two batches; the same as over all files at once."""
    path = scratch_path(spark, "stream-history")
    continuous.start_history(_arriving_files(spark, sf_dir), path, scratch_path(spark, "stream-state")).awaitTermination()
    return continuous.stored_scans(spark, path)


@query("stream_history_compacted", TOTALS_SQL)
def stream_history_compacted(spark, sf_dir):
    """The same where the first batch was compacted before the second came, and sent again with it."""
    files, state = scratch_path(spark, "arriving"), scratch_path(spark, "stream-state")
    first, path = scratch_path(spark, "stream-history"), scratch_path(spark, "stream-compacted")
    seeded = C.seeded_files(spark, sf_dir)
    half = F.pmod(F.xxhash64("file_path"), F.lit(2)) == 0
    seeded.where(half).write.parquet(files)
    stream = spark.readStream.schema(seeded.schema).parquet(files)
    continuous.start_history(stream, first, state).awaitTermination()
    continuous.compact(spark, first, path)
    seeded.write.mode("append").parquet(files)
    continuous.start_history(stream, path, state).awaitTermination()
    return continuous.stored_scans(spark, path)
