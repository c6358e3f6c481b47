import math
import random

from pyspark.sql import functions as F

from gritlens.operators import evaluation, scoring, security
from gritlens.sources import samples


def test_one_critical_finding(spark):
    found = spark.createDataFrame([("s1", "CRITICAL", "SECURITY")], "scan_id string, severity string, category string")
    assert scoring.severity_counts(found, "scan_id").first().critical == 1
    row = scoring.with_scores(scoring.penalties(found, "scan_id")).first()
    assert (row.security, row.quality, row.overall) == (78, 100, 91)


def test_scores_follow_the_formula(spark):
    rng = random.Random(4)
    weights = {"CRITICAL": 22, "HIGH": 12, "MEDIUM": 6, "LOW": 2, "INFO": 2}
    categories = ["SECURITY", "CODE_QUALITY", "MAINTAINABILITY", "DOCUMENTATION", "DEPENDENCY"]
    rows = [(str(n % 200), rng.choice(list(weights)), rng.choice(categories)) for n in range(1500)]
    found = spark.createDataFrame(rows, "scan_id string, severity string, category string")
    for row in scoring.with_scores(scoring.penalties(found, "scan_id")).collect():
        lost = {c: sum(weights[s] for i, s, k in rows if i == row.scan_id and k == c) for c in categories}
        s, q, m, d = (max(floor, min(100, 100 - lost[c])) for c, floor in zip(categories, (10, 15, 20, 20)))
        overall = max(10, min(100, math.floor(s * 0.4 + q * 0.3 + m * 0.2 + d * 0.1 + 0.5)))
        assert (row.security, row.quality, row.maintainability, row.documentation, row.overall) == (s, q, m, d, overall)


def test_dashboard_without_scans(spark):
    empty = spark.createDataFrame([], "repo string, critical int, high int, overall int")
    row = scoring.dashboard_totals(empty).first()
    assert (row.total_scans, row.unique_repos, row.total_critical, row.average_score) == (0, 0, 0, 85)


def test_labelled_samples(spark):
    """All twenty samples are classified right; a full scan names these rules."""
    data = samples.labelled_samples(spark)
    results = evaluation.sample_results(data).collect()
    assert len(results) == 20 and {r.status for r in results} == {"CORRECT"}
    by_id = {r.id: r.titles for r in results}
    assert by_id["sample-16"] == ["Hardcoded JWT Signing Secret", "JWT Issued Without Expiration Time (exp)"]
    assert by_id["sample-11"] == ["Cross-Site Scripting (DOM XSS via innerHTML) [AST Verified]", "Cross-Site Scripting (XSS) Risk"]
    assert by_id["sample-5"] == []
    pairs = data.join(evaluation.predictions(evaluation.sample_files(data)).withColumnRenamed("repo", "id"), "id")
    judged = pairs.select(F.col("is_vulnerable").alias("truth"), (F.col("found") > 0).alias("predicted"))
    row = evaluation.accepted(evaluation.metrics(evaluation.confusion(judged))).first()
    assert (row.true_positives, row.false_positives, row.true_negatives, row.false_negatives) == (12, 0, 8, 0)
    assert (row.precision, row.recall, row.f1_score, row.accuracy, row.accepted) == (1.0, 1.0, 1.0, 1.0, True)
    found = security.findings(evaluation.sample_files(data), quality=False)
    rules = {}
    for f in found.collect():
        rules.setdefault(f.repo, set()).add(f.rule_id)
    assert rules["sample-1"] == {"P06"} and rules["sample-2"] == {"C04"} and rules["sample-3"] == {"J01"}
    assert rules["sample-8"] == {"H05"} and rules["sample-9"] == {"J03", "C04"} and rules["sample-17"] == {"D01"}


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([(True, False)], "truth boolean, predicted boolean")
    row = evaluation.metrics(evaluation.confusion(none)).first()
    assert (row.precision, row.recall, row.f1_score, row.false_positive_rate, row.false_negative_rate) == (0, 0, 0, 0, 1)


def test_sample_repositories(spark):
    totals = {r.repo: r for r in scoring.scan_totals(security.scan_items(samples.sample_files(spark))).collect()}
    bad, good = totals["ecommerce-backend-api"], totals["secure-auth-service"]
    assert (bad.total_files, good.total_files) == (4, 3)
    assert bad.critical >= 3 and bad.overall < good.overall
    scans = scoring.as_scans(scoring.scan_totals(security.scan_items(samples.sample_files(spark))))
    assert scans.where("scores.overall between 10 and 100 and status = 'COMPLETED'").count() == 2
