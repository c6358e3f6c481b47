"""Evaluation of the rules against labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gritlens.operators import evaluation
from registry import corpora as C
from registry.base import query, table
from registry.rule_queries import KEPT_SQL, TITLE_SQL

LABELLED_SQL = f"""{C.SEEDED_SQL}, {KEPT_SQL},
per_file AS (SELECT file_path, count(*) AS found FROM kept GROUP BY file_path),
results AS (SELECT doc_id, repo, toxic = 1 AS truth, coalesce(found, 0) AS found, coalesce(found, 0) > 0 AS predicted
  FROM files JOIN labels USING (doc_id) LEFT JOIN per_file USING (file_path))"""
MATRIX_SQL = """count(*) FILTER (truth AND predicted) AS true_positives, count(*) FILTER (NOT truth AND predicted) AS false_positives,
  count(*) FILTER (NOT truth AND NOT predicted) AS true_negatives, count(*) FILTER (truth AND NOT predicted) AS false_negatives"""
METRICS_SQL = """coalesce(round(tp / nullif(tp + fp, 0), 3), 0) AS precision, coalesce(round(tp / nullif(tp + fn, 0), 3), 0) AS recall,
  coalesce(round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 3), 0) AS f1_score,
  coalesce(round((tp + tn) / nullif(tp + fp + tn + fn, 0), 3), 0) AS accuracy, coalesce(round(fp / nullif(fp + tn, 0), 3), 0) AS false_positive_rate,
  coalesce(round(fn / nullif(tp + fn, 0), 3), 0) AS false_negative_rate"""


def _counted(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""matrix AS (SELECT {lead}{MATRIX_SQL} FROM results {group}),
c AS (SELECT *, CAST(true_positives AS DOUBLE) AS tp, CAST(false_positives AS DOUBLE) AS fp, CAST(true_negatives AS DOUBLE) AS tn,
  CAST(false_negatives AS DOUBLE) AS fn FROM matrix)
SELECT {lead}true_positives, false_positives, true_negatives, false_negatives,
  true_positives + false_positives + true_negatives + false_negatives AS total_samples, {METRICS_SQL} FROM c"""


def _results(spark, sf_dir):
    """One row per labelled document: is it toxic, does any security rule fire."""
    files = C.seeded_files(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    labelled = files.withColumn(
        "doc_id", F.regexp_extract("file_path", r"doc_(\d+)\.", 1).cast("bigint")
    ).join(labels, "doc_id")
    found = evaluation.predictions(
        labelled.select(F.lit("evaluation").alias("scan_id"), F.col("file_path").alias("repo"), "file_path", "content")
    )
    truth = labelled.select("doc_id", F.col("repo").alias("source"), F.col("file_path").alias("repo"), "toxic")
    return truth.join(found, "repo").select(
        "doc_id", F.col("source").alias("repo"), (F.col("toxic") == 1).alias("truth"), "found",
        (F.col("found") > 0).alias("predicted"),
    )


@query("evaluation_predictions", f"WITH {LABELLED_SQL} SELECT doc_id, repo, truth, found, predicted FROM results")
def evaluation_predictions(spark, sf_dir):
    return _results(spark, sf_dir)


@query("confusion_matrix", f"WITH {LABELLED_SQL} SELECT {MATRIX_SQL} FROM results")
def confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_results(spark, sf_dir))


@query("evaluation_metrics", f"""WITH {LABELLED_SQL}, m AS (WITH {_counted()})
SELECT *, total_samples >= 10 AND precision >= 0.85 AND recall >= 0.8 AS accepted FROM m""")
def evaluation_metrics(spark, sf_dir):
    return evaluation.accepted(evaluation.metrics(evaluation.confusion(_results(spark, sf_dir))))


@query("metrics_by_source", f"WITH {LABELLED_SQL}, {_counted('repo')}")
def metrics_by_source(spark, sf_dir):
    return evaluation.metrics(evaluation.confusion(_results(spark, sf_dir), "repo"))


SAMPLES_SQL = LABELLED_SQL.replace(
    "'src/doc_' || CAST(d.doc_id AS VARCHAR) || '.' || s.ext",
    "'benchmark/' || CAST(d.doc_id AS VARCHAR) || CASE WHEN s.ext = 'py' THEN '.py' ELSE '.js' END",
)


@query("evaluation_details", f"""WITH {SAMPLES_SQL},
ranked AS (SELECT file_path, string_agg({TITLE_SQL}, '|' ORDER BY emit_block, line_no, rule_no) AS titles FROM kept GROUP BY file_path)
SELECT doc_id, CASE WHEN truth THEN 'VULNERABLE' ELSE 'SAFE' END AS ground_truth, CASE WHEN predicted THEN 'VULNERABLE' ELSE 'SAFE' END AS predicted,
  CASE WHEN truth = predicted THEN 'CORRECT' WHEN predicted THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS status,
  coalesce(titles, '') AS titles FROM results JOIN files USING (doc_id) LEFT JOIN ranked USING (file_path)""")
def evaluation_details(spark, sf_dir):
    """The detail rows of labelled samples: the seeded documents as samples."""
    results = evaluation.sample_results(_samples(spark, sf_dir))
    return results.select(
        _doc_id(), "ground_truth", "predicted", "status", F.array_join("titles", "|").alias("titles"),
    )


@query("evaluation_outcomes", f"""WITH {SAMPLES_SQL}
SELECT doc_id, CASE WHEN truth THEN 'VULNERABLE' ELSE 'SAFE' END AS ground_truth, CASE WHEN predicted THEN 'VULNERABLE' ELSE 'SAFE' END AS predicted,
  CASE WHEN truth = predicted THEN 'CORRECT' WHEN predicted THEN 'FALSE_POSITIVE' ELSE 'FALSE_NEGATIVE' END AS status FROM results""")
def evaluation_outcomes(spark, sf_dir):
    """Truth, prediction and status of every sample, from one count each."""
    results = evaluation.sample_outcomes(_samples(spark, sf_dir))
    return results.select(_doc_id(), "ground_truth", "predicted", "status")


@query("evaluation_titles", f"""WITH {SAMPLES_SQL}
SELECT f.doc_id, CAST(row_number() OVER (PARTITION BY f.file_path ORDER BY emit_block, line_no, rule_no) AS INTEGER) AS number, {TITLE_SQL} AS title
FROM kept JOIN files f ON kept.file_path = f.file_path WHERE f.doc_id IN (SELECT doc_id FROM results)""")
def evaluation_titles(spark, sf_dir):
    """The titles of every sample as rows in emission order."""
    return evaluation.sample_titles(_samples(spark, sf_dir)).select(_doc_id(), "number", "title")


def _doc_id():
    return F.substring_index("id", ".", 1).cast("bigint").alias("doc_id")


def _samples(spark, sf_dir):
    files = C.seeded_files(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    doc_id = F.regexp_extract("file_path", r"doc_(\d+)\.", 1)
    extension = F.substring_index("file_path", ".", -1)
    samples = files.withColumn("doc_id", doc_id.cast("bigint")).join(labels, "doc_id").select(
        "doc_id", F.concat("doc_id", F.lit("."), extension).alias("id"), F.col("repo").alias("name"),
        extension.alias("extension"), (F.col("toxic") == 1).alias("is_vulnerable"), F.col("content").alias("code"),
    )
    python = F.when(F.col("extension") == "py", F.lit("Python")).otherwise(F.lit("JavaScript"))
    return samples.withColumn("language", python)
