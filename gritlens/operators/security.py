"""Security findings of source lines: one pass, no shuffle."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions import paths
from gritlens.functions import text as X
from gritlens.functions.lists import let
from gritlens.operators import dependencies as D
from gritlens.operators import nodes
from gritlens.operators.items import no_items
from gritlens.operators.lines import line_count
from gritlens.operators.quality import RULES as QUALITY_RULES
from gritlens.operators.quality import with_quality_items
from gritlens.rules import catalogue as C
from gritlens.rules import compiler
from gritlens.schemas import DEPENDENCY_INFO, FILE_ITEM, FINDING_COLUMNS

FILE_ROW = -1  # rule number of the row that stands for the file itself


def with_scan_id(files: DataFrame) -> DataFrame:
    """One scan per repository unless the files say which scan they belong to."""
    if "scan_id" in files.columns:
        return files
    return files.withColumn("scan_id", F.concat(F.lit("scan-"), F.col("repo")))


def _line_columns(anchored: bool) -> dict[str, Column]:
    """What the compiled rules read besides the text, for lines worth testing."""

    def needed(column, value):
        return F.when(compiler.needs(column), value) if anchored else value

    marks = {name: X.starts_with_any(F.col("trimmed"), skip) for skip, name in compiler.COMMENTS.items()}
    bare = needed("bare", compiler.code_only(F.col("line")))
    callee = needed("callee", compiler.leftmost_call(F.col("trimmed")))
    asked = X.matches(F.col("argument"), compiler.CALL)
    calls = F.when(compiler.needs("calls") & asked if anchored else F.col("is_js") & asked, compiler.asked_calls(F.col("_code")))
    return {**marks, "bare": bare, "callee": F.coalesce(callee, F.lit("")), "calls": calls}


def tested_lines(
    files: DataFrame, keep: dict[str, Column], wanted: Column, anchored: bool = True, joined: bool = True
) -> DataFrame:
    """The wanted lines of files with everything the compiled rules read.

    ``joined`` looks for calls that go on below their line.
    """
    code = paths.is_js(F.col("file_path")) | paths.is_python(F.col("file_path"))
    conditions = compiler.file_conditions(F.col("content"), F.col("_low"))
    flagged = files.withColumn("_low", F.when(code, F.lower("content"))).select(
        "scan_id", "repo", "file_path",
        paths.is_js(F.col("file_path")).alias("is_js"), paths.is_python(F.col("file_path")).alias("is_python"),
        *[F.coalesce(F.when(code, test), F.lit(False)).alias(name) for name, test in conditions.items()],
        *[value.alias(name) for name, value in keep.items()],
        "content",
    )
    # Two steps: what stands next to a generator in one select runs per line. The
    # lines, with what goes on below them, are made inside the generator: nothing of
    # the file stands beside a line, and a filter below doesn't make them again.
    split = X.split_lines(F.col("content"))
    numbered = let(split, compiler.plain_lines)
    if joined:
        goes_on = F.col("is_js") & compiler.may_continue(F.col("content"))
        numbered = F.when(goes_on, let(split, compiler.code_lines)).otherwise(numbered)
    return (
        flagged.select("*", F.posexplode(numbered).alias("pos", "_line")).drop("content")
        .select("*", "_line.line", F.col("_line.argument").alias("_argument"), F.col("_line.statement").alias("_statement"))
        .where(wanted | F.col("_argument").isNotNull())
        .withColumns({
            "trimmed": X.trim(F.col("line")),
            "argument": F.coalesce(compiler.without_comments(F.concat("line", F.lit("\n"), "_argument")), F.col("line")),
            "statement": F.coalesce(F.concat("line", F.lit("\n"), "_statement"), F.col("line")),
        })
        .withColumn("_code", F.when(F.col("is_js"), compiler.without_comments(F.col("statement"))))
        .withColumn("anchors", compiler.found_anchors(F.col("argument")))
        .withColumns(_line_columns(anchored))
        .drop("_line", "_argument", "_statement", "_code")
    )


def rule_hits(files: DataFrame, anchored: bool = True) -> DataFrame:
    """Every rule match before duplicates go: repo, file_path, line_no, rule_id."""
    wanted = compiler.anchor_filter() if anchored else F.lit(True)
    names = F.array(*[F.lit(rule.rule_id) for rule in C.RULES])
    return (
        tested_lines(with_scan_id(files), {}, wanted, anchored)
        .select("repo", "file_path", (F.col("pos") + 1).alias("line_no"),
                F.explode(compiler.all_hits(anchored=anchored)).alias("rule_no"))
        .select("repo", "file_path", "line_no", F.get(names, F.col("rule_no")).alias("rule_id"))
    )


def scan_items(
    files: DataFrame,
    security: bool = True,
    quality: bool | Collection[str] = True,
    advisories: list[D.Advisory] | None = D.ADVISORIES,
    anchored: bool = True,
) -> DataFrame:
    """All findings and one row per file.

    Two branches over the files: what is worked out for a file as a whole, and
    the rules of single lines. No line carries anything of its file but its
    names, so a file with findings on every line costs as much as its lines.
    ``advisories=None`` leaves the dependency rules to a join with a table;
    ``quality`` may name the quality rules wanted.
    """
    staged = with_scan_id(files)
    of_files = _file_entries(staged, advisories if security else None, quality)
    if not security:
        return of_files
    wanted = compiler.anchor_filter() if anchored else F.lit(True)
    of_lines = (
        tested_lines(staged, {}, wanted, anchored)
        .select(
            "scan_id", "repo", "file_path", "pos", "line", "trimmed", "argument", "statement", "callee", "calls",
            F.explode(compiler.kept_hits(anchored=anchored)).alias("rule_no"),
        )
        .withColumn("call", compiler.call_of(F.col("rule_no"))).drop("calls")
        .withColumns({"n_lines": F.lit(None).cast("int"), "item": F.lit(None).cast(FILE_ITEM)})
    )
    return of_files.unionByName(of_lines)


def _file_entries(files: DataFrame, advisories: list[D.Advisory] | None, quality) -> DataFrame:
    """The row of every file, and its findings as a whole (dependency, quality)."""
    items = no_items()
    if advisories:
        items = D.dependency_items(F.col("file_path"), F.col("content"), advisories)
    if quality:
        files = with_quality_items(files, rules=QUALITY_RULES if quality is True else quality)
        items = F.concat(items, F.col("quality_items"))
    entry = "struct<rule_no:int,item:" + FILE_ITEM + ">"
    own = F.struct(F.lit(FILE_ROW).alias("rule_no"), F.lit(None).cast(FILE_ITEM).alias("item")).cast(entry)
    found = F.transform(items, lambda i: F.struct(i["rule_no"].alias("rule_no"), i.alias("item")).cast(entry))
    text = F.lit(None).cast("string")
    return files.select(
        "scan_id", "repo", "file_path", line_count(F.col("content")).alias("n_lines"),
        F.explode(F.concat(F.array(own), found)).alias("entry"),
    ).select(
        "scan_id", "repo", "file_path", F.lit(0).alias("pos"),
        *[text.alias(name) for name in ("line", "trimmed", "argument", "statement", "callee")],
        F.lit(None).cast(compiler.CALLED).alias("call"),
        F.when(F.col("entry.rule_no") == FILE_ROW, F.col("n_lines")).alias("n_lines"),
        F.col("entry.rule_no").alias("rule_no"), F.col("entry.item").alias("item"),
    )


def graded(items: DataFrame) -> DataFrame:
    """Items with category and severity; the file rows have neither."""
    rules = F.broadcast(compiler.rules_table(items.sparkSession))  # as long as the catalogue
    return items.join(rules, "rule_no", "left").withColumn(
        "severity", F.coalesce("item.severity", "rule_severity")
    )


EMIT_ORDER = ["emit_block", "emit_line", "rule_no", "ordinal"]
TEXT_COLUMNS = {
    "title": "title_text", "description": "description_text",
    "recommendation": "recommendation_text", "node_type": "node_text",
}
# Marker values of file-level findings. Free text comes last, so that nothing in
# it is taken for a marker.
ITEM_TEXTS = ["count", "code", "comments", "ratio", "package", "version", "fixed", "title", "about", "advice"]


def _marker_values() -> dict[str, Column]:
    """Every marker's value: from the file-level finding or from the line."""
    of_line = nodes.node_values(F.col("rule_id"))
    names = [*[n for n in of_line if n != "argument"], *ITEM_TEXTS, "argument"]

    def value(name):
        given = [F.col("item.texts")[name]] if name in ITEM_TEXTS or name == "name" else []
        return F.coalesce(*given, *([of_line[name]] if name in of_line else []), F.lit(""))

    return {name: value(name) for name in names}


def _filled(field: str, names: list[str]) -> Column:
    """The rule's text with those markers filled that occur in any such text."""
    templates = [getattr(rule, field) or "" for rule in C.RULES]
    used = {n: F.col(f"_{n}") for n in names if any("{" + n + "}" in t for t in templates)}
    return X.fill(F.col(TEXT_COLUMNS[field]), used)


def as_findings(items: DataFrame, *extra: str) -> DataFrame:
    """The finding rows of ``scan_items``, with texts filled in."""
    values = _marker_values()
    names = list(values)
    numbered = graded(items.where(F.col("rule_no") != FILE_ROW)).withColumns({
        "line_no": F.coalesce(F.col("item.line_no"), F.col("pos") + 1),
        "emit_line": F.coalesce("item.emit_line", F.col("pos") + 1),
        "ordinal": F.coalesce("item.ordinal", F.lit(0)),
        "code_snippet": F.coalesce("item.snippet", nodes.snippets(F.col("rule_id"))),
        **{f"_{name}": value for name, value in values.items()},
    })
    key = F.concat_ws("|", "scan_id", "file_path", "line_no", "rule_id", "ordinal")
    dependency = F.when(
        F.col("item.texts")["cve"].isNotNull(),
        F.struct(
            F.col("_package").alias("package_name"), F.col("_version").alias("installed_version"),
            F.col("_fixed").alias("fixed_version"), F.col("item.texts")["cve"].alias("cve"),
        ),
    )
    return numbered.withColumns({
        "finding_id": F.sha2(key, 256),
        **{field: _filled(field, names) for field in TEXT_COLUMNS},
        "dependency_info": dependency.cast(DEPENDENCY_INFO),
    }).select(*FINDING_COLUMNS, *extra)


def findings(files: DataFrame, **options) -> DataFrame:
    """Security, dependency and quality findings of a files table."""
    return as_findings(scan_items(files, **options))
