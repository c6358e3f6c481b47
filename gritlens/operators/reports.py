"""Reports: summary rows, Markdown and JSON documents.

A document may be longer than one row or one task should hold. So a document is
rows of text at any size: one in front of its findings, one for each finding and
one behind them, numbered; in order they are the document. ``in_order`` sorts them
for a writer, ``in_parts`` joins a stated number of findings to a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.operators.scoring import COUNT_NAMES, SCORE_NAMES, report_bands
from gritlens.plans.skew import row_numbers

FINDING_ORDER = ["file_path", "line_no", "finding_id"]

# The texts of the summary and of the Markdown document.
SUMMARY = (
    "AST analysis evaluated {files} source files ({lines} lines of code) in {repo}. A total of {total} "
    "findings were identified, including {critical} critical and {high} high severity risks. Key focus "
    "areas include injection mitigation, cryptographic security, and dependency updates."
)
TITLE = "Security & Code Intelligence Audit Report"
UTC_DATE = "EEE, dd MMM yyyy HH:mm:ss 'GMT'"
HEADER = """# {title}

**Repository:** `{repo}`  
**Scan Date:** {date}  
**Overall Health Score:** {overall}/100  
**Status:** {status}  
**Files Analyzed:** {total_files} | **Lines of Code:** {total_lines}  

---

## 1. Executive Summary & Health Scores

| Category | Score | Weight | Health Status |
| :--- | :--- | :--- | :--- |
| **Security** | {security}/100 | 40% | {security_band} |
| **Code Quality** | {quality}/100 | 30% | {quality_band} |
| **Maintainability** | {maintainability}/100 | 20% | {maintainability_band} |
| **Documentation** | {documentation}/100 | 10% | {documentation_band} |

### Vulnerability Breakdown by Severity
- **CRITICAL:** {critical}
- **HIGH:** {high}
- **MEDIUM:** {medium}
- **LOW / INFO:** {low_info}

---

## 2. Key Findings & Remediation Guidance

"""
FINDING = """### Finding #{number}: [{severity}] {title}
- **Location:** `{file_path}:{line_no}`
- **Category:** {category}
- **OWASP / CWE:** {cwe} - {owasp}
- **Description:** {description}

```
{code_snippet}
```

**Static Recommendation:**  
{recommendation}

---"""
FOOTER = "\n\n*Generated automatically.*\n"


def _text(template: str, values: dict[str, Column]) -> Column:
    """The template with each marker's value in place, as one concatenation."""
    pieces, rest = [], template
    while rest:
        start = rest.find("{")
        if start < 0:
            pieces.append(F.lit(rest))
            break
        end = rest.index("}", start)
        if start:
            pieces.append(F.lit(rest[:start]))
        pieces.append(F.coalesce(values[rest[start + 1 : end]].cast("string"), F.lit("")))
        rest = rest[end + 1 :]
    return F.concat(*pieces)


def executive_reports(scans: DataFrame) -> DataFrame:
    """One summary row per scan (flat score and count columns)."""
    total = sum((F.col(c) for c in COUNT_NAMES[1:]), F.col(COUNT_NAMES[0]))
    summary = _text(
        SUMMARY,
        {"files": F.col("total_files"), "lines": F.col("total_lines"), "repo": F.col("repo"),
         "total": total, "critical": F.col("critical"), "high": F.col("high")},
    )
    return scans.select(
        F.concat(F.lit("report-"), F.col("scan_id")).alias("report_id"),
        "scan_id", "repo",
        F.col("overall").alias("overall_score"),
        summary.alias("executive_summary"),
        total.cast("bigint").alias("total_findings"),
        F.col("critical").cast("bigint").alias("critical_findings"),
    )


def report_header(title: str = TITLE) -> Column:
    values = {name: F.col(name) for name in [*SCORE_NAMES, *COUNT_NAMES, "repo", "status", "total_files", "total_lines"]}
    values |= {f"{name}_band": band for name, band in report_bands().items()}
    values |= {
        "title": F.lit(title),
        "date": F.date_format("started_at", UTC_DATE),
        "low_info": F.col("low") + F.col("info"),
    }
    return _text(HEADER, values)


def finding_texts() -> Column:
    """The text of a finding after its number."""
    names = ["severity", "title", "file_path", "line_no", "category", "description", "code_snippet", "recommendation"]
    values = {name: F.col(name) for name in names}
    values |= {"cwe": F.coalesce("cwe", F.lit("N/A")), "owasp": F.coalesce("owasp", F.lit("N/A"))}
    return _text(FINDING.split("{number}")[1], values)


def numbered(findings: DataFrame, order: list[str] = FINDING_ORDER) -> DataFrame:
    """Findings with their ``number`` in their scan, from 1; no scan is one task's."""
    return row_numbers(findings, "scan_id", order, "number")


def document_rows(
    heads: DataFrame, findings: DataFrame, value: Column, order: list[str], joiner: str, foot: str
) -> DataFrame:
    """(scan_id, number, text): ``heads`` (scan_id, header), the findings' texts, the foot."""
    texts = numbered(findings, order).select("scan_id", "number", value.alias("text"))
    joined = F.when(F.col("number") > 1, F.concat(F.lit(joiner), F.col("text"))).otherwise(F.col("text"))
    many = findings.groupBy("scan_id").agg((F.count("*") + 1).alias("number"))
    last = heads.select("scan_id").join(many, "scan_id", "left").select(
        "scan_id", F.coalesce("number", F.lit(1)).cast("bigint").alias("number"), F.lit(foot).alias("text")
    )
    return (
        heads.select("scan_id", F.lit(0).cast("bigint").alias("number"), F.col("header").alias("text"))
        .unionByName(texts.withColumn("text", joined).withColumn("number", F.col("number").cast("bigint")))
        .unionByName(last)
    )


def in_order(rows: DataFrame) -> DataFrame:
    """Document rows sorted for a writer, however long a document is."""
    return rows.repartitionByRange("scan_id", "number").sortWithinPartitions("scan_id", "number")


def in_parts(rows: DataFrame, part_size: int) -> DataFrame:
    """(scan_id, part_no, text): rows of ``part_size`` findings each, which in order are the document.

    The row in front belongs to the first part, the one behind to the last.
    """
    last = rows.groupBy("scan_id").agg(F.max("number").alias("_last"))
    own = F.least(F.greatest(F.col("number"), F.lit(1)), F.greatest(F.col("_last") - 1, F.lit(1)))
    part = F.floor((own - 1) / F.lit(part_size)).cast("int")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "text"))), lambda r: r["text"]), "")
    return (
        rows.join(last, "scan_id").withColumn("part_no", part)
        .groupBy("scan_id", "part_no").agg(text.alias("text"))
    )


def markdown_documents(
    scans: DataFrame, findings: DataFrame, order: list[str] = FINDING_ORDER, title: str = TITLE
) -> DataFrame:
    """The Markdown report as document rows."""
    heads = scans.select("scan_id", report_header(title).alias("header"))
    lead = F.lit(FINDING.split("{number}")[0])
    text = F.concat(lead, F.col("number").cast("string"), finding_texts())
    return document_rows(heads, findings, text, order, "\n\n", FOOTER)


def nested_scans(scans: DataFrame, findings: DataFrame, order: list[str] = FINDING_ORDER) -> DataFrame:
    """Every scan with its findings below it: a row per finding, in order by ``number``.

    A scan without findings has one row with number 0 and no finding.
    """
    fields = F.struct(*[c for c in findings.columns if c != "scan_id"]).alias("finding")
    below = numbered(findings, order).select("scan_id", F.col("number").cast("bigint").alias("number"), fields)
    return scans.join(below, "scan_id", "left").select(
        *scans.columns, F.coalesce("number", F.lit(0).cast("bigint")).alias("number"), "finding"
    )


def json_documents(scans: DataFrame, findings: DataFrame, order: list[str] = FINDING_ORDER) -> DataFrame:
    """The whole scan with its findings nested, as JSON in document rows."""
    written = {"ignoreNullFields": "false"}
    scan = F.to_json(F.struct(*scans.columns), written)
    head = F.concat(F.substring(scan, F.lit(1), F.length(scan) - 1), F.lit(',"findings":['))
    heads = scans.select("scan_id", head.alias("header"))
    finding = F.to_json(F.struct(*[c for c in findings.columns if c != "scan_id"]), written)
    return document_rows(heads, findings, finding, order, ",", "]}")
