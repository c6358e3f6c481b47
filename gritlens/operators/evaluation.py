"""Scoring the rules themselves on labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.operators import security
from gritlens.plans.skew import running_totals

REPORTED = ["SECURITY", "DEPENDENCY"]
MIN_SAMPLES, MIN_PRECISION, MIN_RECALL = 10, 0.85, 0.80


def sample_files(samples: DataFrame) -> DataFrame:
    """Samples as files: the language gives the path."""
    path = (
        F.when(F.col("language") == "JSON", F.lit("benchmark/package.json"))
        .when(F.col("language") == "Python", F.concat(F.lit("benchmark/"), F.col("id"), F.lit(".py")))
        .otherwise(F.concat(F.lit("benchmark/"), F.col("id"), F.lit(".js")))
    )
    return samples.select(
        F.lit("benchmark").alias("scan_id"), F.col("id").alias("repo"),
        path.alias("file_path"), F.col("code").alias("content"),
    )


def predictions(files: DataFrame) -> DataFrame:
    """Per repository: the number of reported security findings, 0 included."""
    graded = security.graded(security.scan_items(files, quality=False))
    return graded.groupBy("repo").agg(
        F.count_if(F.col("category").isin(REPORTED)).cast("bigint").alias("found")
    )


def outcome(truth: Column, predicted: Column) -> Column:
    return (
        F.when(truth == predicted, F.lit("CORRECT"))
        .when(predicted, F.lit("FALSE_POSITIVE"))
        .otherwise(F.lit("FALSE_NEGATIVE"))
    )


def sample_titles(samples: DataFrame) -> DataFrame:
    """The titles of each sample's findings as rows (id, number from 1, title), in emission order.

    Nothing of a sample meets in one row: the order is counted over stretches, so a sample may
    have any number of findings.
    """
    found = security.as_findings(security.scan_items(sample_files(samples), quality=False), *security.EMIT_ORDER)
    rows = found.select(F.col("repo").alias("id"), "title", *security.EMIT_ORDER)
    numbered = running_totals(rows, ["id"], security.EMIT_ORDER, {"number": F.lit(1)})
    return numbered.select("id", F.col("number").cast("int").alias("number"), "title")


def sample_outcomes(samples: DataFrame) -> DataFrame:
    """``sample_results`` without the titles: one count per sample, combined before the shuffle."""
    found = predictions(sample_files(samples)).withColumnRenamed("repo", "id")
    reported = F.coalesce(F.col("found") > 0, F.lit(False))
    return samples.join(found, "id", "left").select(
        "id", "name", "language",
        _label(F.col("is_vulnerable")).alias("ground_truth"),
        _label(reported).alias("predicted"),
        outcome(F.col("is_vulnerable"), reported).alias("status"),
    )


def _label(flag: Column) -> Column:
    return F.when(flag, F.lit("VULNERABLE")).otherwise(F.lit("SAFE"))


def sample_results(samples: DataFrame) -> DataFrame:
    """Truth, prediction, status and titles in emission order per sample, the titles in one row.

    For samples of a size to be looked at; ``sample_outcomes`` and ``sample_titles`` have no such bound.
    """
    files = sample_files(samples)
    found = security.as_findings(security.scan_items(files, quality=False), *security.EMIT_ORDER)
    titles = F.array_sort(F.collect_list(F.struct(*security.EMIT_ORDER, "title", "category")))
    per_sample = found.groupBy(F.col("repo").alias("id")).agg(titles.alias("_t"))
    reported = F.coalesce(F.exists("_t", lambda x: x["category"].isin(REPORTED)), F.lit(False))

    return samples.join(per_sample, "id", "left").select(
        "id", "name", "language",
        _label(F.col("is_vulnerable")).alias("ground_truth"),
        _label(reported).alias("predicted"),
        outcome(F.col("is_vulnerable"), reported).alias("status"),
        F.coalesce(F.transform("_t", lambda x: x["title"]), F.array().cast("array<string>")).alias("titles"),
    )


def confusion(results: DataFrame, *by: str) -> DataFrame:
    """TP, FP, TN, FN of boolean ``truth`` and ``predicted``."""
    t, p = F.col("truth"), F.col("predicted")

    def count(test, name):
        return F.count_if(test).cast("bigint").alias(name)

    return results.groupBy(*by).agg(
        count(t & p, "true_positives"), count(~t & p, "false_positives"),
        count(~t & ~p, "true_negatives"), count(t & ~p, "false_negatives"),
    )


def metrics(counts: DataFrame) -> DataFrame:
    """Ratios of a confusion matrix, three decimals, 0 where undefined."""
    tp, fp, tn, fn = (
        F.col(c) for c in ("true_positives", "false_positives", "true_negatives", "false_negatives")
    )

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    values = {
        "precision": precision,
        "recall": recall,
        "f1_score": ratio(F.lit(2) * precision * recall, precision + recall),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, tp + fn),
    }
    return counts.select(
        "*",
        (tp + fp + tn + fn).alias("total_samples"),
        *[F.round(value, 3).alias(name) for name, value in values.items()],
    )


def accepted(measured: DataFrame) -> DataFrame:
    return measured.withColumn(
        "accepted",
        (F.col("total_samples") >= MIN_SAMPLES)
        & (F.col("precision") >= MIN_PRECISION)
        & (F.col("recall") >= MIN_RECALL),
    )
