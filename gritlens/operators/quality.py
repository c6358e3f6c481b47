"""Quality and documentation findings of a file.

The running counters of a line-by-line fold become positions in the array of
the file's code lines: a function reaches from its own position to that of the
next one, so its length is a difference, and the branch count is needed over at
most sixteen lines. All of it stays inside the file's row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions import text as X
from gritlens.functions.lists import empty_as_null, let
from gritlens.operators.items import NO_ITEMS, item, no_items
from gritlens.rules import catalogue as C

RULES = ("Q01", "Q02", "Q03", "Q04", "Q05")

COMMENT_LINE = r"^\s*(//|#|/\*|\*)"
NOT_CODE = r"^\s*(//|#|/\*|\*|$)"
FUNCTION_ANCHORS = ("function", "=>", "def")
CATCH_ANCHORS = ("catch", "except")


def code_lines(lines: Column) -> Column:
    """Non-blank, non-comment lines: array of struct(pos, n, l), pos from 0."""
    numbered = F.transform(
        lines, lambda line, i: F.struct((i + 1).alias("n"), line.alias("l"))
    )
    code = F.filter(numbered, lambda x: ~X.matches(x["l"], NOT_CODE))
    return F.transform(
        code, lambda x, i: F.struct(i.alias("pos"), x["n"].alias("n"), x["l"].alias("l"))
    )


def function_starts(code: Column) -> Column:
    return F.filter(
        code,
        lambda x: X.contains_any(x["l"], FUNCTION_ANCHORS) & X.matches(x["l"], C.FUNCTION_START),
    )


def function_name(line: Column) -> Column:
    groups = [empty_as_null(X.extract(line, C.FUNCTION_START, g)) for g in (1, 2, 3)]
    return F.coalesce(*groups, F.lit("anonymous"))


def _too_long(fn: Column, following: Column) -> Column:
    length = following["pos"] - fn["pos"]

    def finding(name):
        return item(
            "Q01",
            fn["n"],
            F.concat(F.lit("function "), name, F.lit("() ... ["), length.cast("string"), F.lit(" lines]")),
            {"name": name, "count": length},
            emit_line=following["n"],
        )

    return F.when(length > C.MAX_FUNCTION_LINES, let(function_name(fn["l"]), finding))


def _too_complex(fn: Column, following: Column, code: Column) -> Column:
    """Reported only if the line fifteen below the start is code of the function."""
    last_line = fn["n"] + C.COMPLEXITY_OFFSET
    window = F.filter(
        F.slice(code, fn["pos"] + 1, F.lit(C.COMPLEXITY_OFFSET + 1)),
        lambda y: (y["n"] <= last_line)
        & F.coalesce(y["pos"] < following["pos"], F.lit(True)),
    )

    def finding(w):
        branches = 1 + F.size(F.filter(w, lambda y: X.matches(y["l"], C.BRANCH)))
        return let(
            branches,
            lambda cc: F.when(
                cc >= C.COMPLEX,
                item(
                    "Q02",
                    fn["n"],
                    X.trim(F.element_at(w, -1)["l"]),
                    {"name": function_name(fn["l"]), "count": cc},
                    emit_line=last_line,
                    severity=F.when(cc >= C.VERY_COMPLEX, F.lit("HIGH")).otherwise(F.lit("MEDIUM")),
                ),
            ),
        )

    reached = F.element_at(window, -1)["n"] == last_line
    return F.when(reached, let(window, finding))


def function_items(code: Column, starts: Column, rules: Collection[str] = RULES) -> Column:
    def per_function(fn, k):
        following = F.get(starts, k + 1)
        tests = {"Q01": lambda: _too_long(fn, following), "Q02": lambda: _too_complex(fn, following, code)}
        return F.array(*[test() for name, test in tests.items() if name in rules])

    return F.array_compact(F.flatten(F.transform(starts, per_function)))


def empty_catch(line: Column) -> Column:
    return X.contains_any(line, CATCH_ANCHORS) & X.matches(line, C.EMPTY_CATCH)


def catch_items(code: Column) -> Column:
    first_catch = F.slice(F.filter(code, lambda x: empty_catch(x["l"])), F.lit(1), F.lit(1))
    return F.transform(first_catch, lambda x: item("Q03", x["n"], X.trim(x["l"]), {}))


def debug_items(code: Column) -> Column:
    debug = F.filter(code, lambda x: X.contains_any(x["l"], C.DEBUG_TEXTS))
    return F.transform(debug, lambda x: item("Q04", x["n"], X.trim(x["l"]), {}))


def density_item(lines: Column, code: Column) -> Column:
    def finding(comments):
        ratio = comments / F.size(code)
        return F.when(
            ratio < C.MIN_COMMENT_RATIO,
            item(
                "Q05",
                F.lit(1),
                F.coalesce(empty_as_null(F.get(lines, F.lit(0))), F.lit("// File header")),
                {
                    "code": F.size(code),
                    "comments": comments,
                    "ratio": X.one_decimal(ratio * 100),
                },
                emit_line=F.size(lines) + 1,
            ),
        )

    comments = F.size(F.filter(lines, lambda line: X.matches(line, COMMENT_LINE)))
    return F.when(F.size(code) > C.MIN_CODE_LINES, let(comments, finding))


def with_quality_items(
    files: DataFrame, content: str = "content", out: str = "quality_items", rules: Collection[str] = RULES
) -> DataFrame:
    """Add the array of a file's quality findings; only ``rules`` become part of the plan."""
    staged = (
        files.withColumn("_lines", X.split_lines(F.col(content)))
        .withColumn("_code", code_lines(F.col("_lines")))
        .withColumn("_starts", function_starts(F.col("_code")))
    )
    code, starts = F.col("_code"), F.col("_starts")
    parts = []
    if "Q01" in rules or "Q02" in rules:
        parts.append(F.when(F.size(starts) > 0, function_items(code, starts, rules)).otherwise(no_items()))
    if "Q03" in rules:
        parts.append(catch_items(code))
    if "Q04" in rules:
        parts.append(debug_items(code))
    if "Q05" in rules:
        parts.append(F.array_compact(F.array(density_item(F.col("_lines"), code))))
    found = F.concat(no_items(), *parts).cast(NO_ITEMS)
    return staged.withColumn(out, found).drop("_lines", "_code", "_starts")


def function_segments(files: DataFrame) -> DataFrame:
    """Functions of each file with the code lines up to the next function."""
    staged = files.withColumn("_code", code_lines(X.split_lines(F.col("content")))).withColumn(
        "_starts", function_starts(F.col("_code"))
    )
    segments = F.transform(
        F.col("_starts"),
        lambda fn, k: F.struct(
            fn["n"].alias("start_line"),
            function_name(fn["l"]).alias("name"),
            (F.coalesce(F.get(F.col("_starts"), k + 1)["pos"], F.size("_code")) - fn["pos"]).alias("n_lines"),
            F.get(F.col("_starts"), k + 1)["n"].alias("next_start"),
        ),
    )
    return staged.select("repo", "file_path", F.explode(segments).alias("s")).select(
        "repo", "file_path", "s.start_line", "s.name", "s.n_lines", "s.next_start"
    )


def line_statistics(files: DataFrame) -> DataFrame:
    """Code and comment lines per file and their ratio."""
    lines = X.split_lines(F.col("content"))
    comments = F.size(F.filter(lines, lambda line: X.matches(line, COMMENT_LINE)))
    code = F.size(F.filter(lines, lambda line: ~X.matches(line, NOT_CODE)))
    return files.select("repo", "file_path", code.alias("code_lines"), comments.alias("comment_lines"))
