"""Code nodes read from line text: Python nodes, call sites, declared literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions import text as X
from gritlens.functions.lists import empty_as_null
from gritlens.rules import catalogue as C
from gritlens.rules.compiler import code_only, leftmost_call, without_comments

PYTHON_DEF = r"^def\s+([a-zA-Z0-9_]+)\s*\((.*?)\):"
PYTHON_EXCEPT_PASS = r"except(\s+[a-zA-Z0-9_]+)?\s*:\s*pass"
NOT_ASSIGNED = ("if", "return")

CALL_SITE = r"(?<![\w$.])([\w$.]++)\s*\(\s*(" + C.FIRST_ARGUMENT_BUILT + r")?"
NOT_CALLEES = ["if", "for", "while", "switch", "catch", "function", "return", "typeof"]
DECLARED_LITERAL = C.DECLARATION + r"""([\w$]+)(?:\s*:\s*[^=]+)?\s*=\s*(?:"([^"]*)"|'([^']*)')"""
ASSIGNED_MARKUP = r"(?i)([^\s;{}=]*(?:innerHTML|outerHTML))\s*=(?:[^=]|$)"
JSX_MARKUP = r"(dangerouslySetInnerHTML)\s*="

# A call up to its closing parenthesis, three levels deep, else the statement's rest.
CALL_BODY = r"(?:\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)|\([\s\S]*)"

# Per rule, the call in question: what may stand before the callee, the callee,
# and what must follow it.
CALLS = {
    "J01": (r"(?:^|[^\w$.])", r"(?:eval|Function|window\.eval)", r"\s*\("),
    "J04": (r"(?i)", r"[\w$.]*createHash", r"""\s*\(\s*["']?(?:md5|sha1)["']?\s*(?:[,)]|$)"""),
    "J05": (r"(?:^|[^\w$.])", r"Math\.random", r"\s*\("),
}
CALLS["J11"] = CALLS["J01"]


def _callee(rule_id: str, line: Column) -> Column:
    before, name, after = CALLS[rule_id]
    return X.extract(line, f"{before}({name}){after}")


def _call_text(rule_id: str, line: Column) -> Column:
    before, name, after = CALLS[rule_id]
    return X.extract(line, f"{before}({name}(?={after})\\s*{CALL_BODY})")


HASH_NAME = r"""(?i)createHash\s*\(\s*["']?(md5|sha1)"""
REQUEST_ARGUMENT = r"(?i)(?:axios\.get|axios\.post|fetch|http\.get|https\.get)\s*\(\s*([^,)]*)"
AWS_DECLARED = C.DECLARATION + r"""([\w$]+)(?:\s*:\s*[^=]+)?\s*=\s*["']([^"']*""" + C.AWS_KEY + r")"
CREDENTIAL_DECLARED = (
    r"(?i)" + C.DECLARATION + r"([\w$]*(?:api_?key|secret_?key|auth_?token|jwt_?secret|db_?pass|password)[\w$]*)"
    r"""(?:\s*:\s*[^=]+)?\s*=\s*["']([^"']{10,})"""
)
MARKUP_ASSIGNMENT = r"(?i)([^\s;{}=]*(?:innerHTML|outerHTML)\s*=[^;]*)"
JSX_ATTRIBUTE = r"(dangerouslySetInnerHTML\s*=\s*\{(?:[^{}]++|\{[^{}]*+\})*+\}?)"


def python_nodes(lines: DataFrame) -> DataFrame:
    """Function definitions, assignments, calls and ``except: pass`` per line."""
    t = F.col("trimmed")
    live = (t != "") & ~F.startswith(t, F.lit("#"))
    no_args = F.lit(None).cast("array<string>")

    def node(kind, test, name=None, callee=None, args=None):
        return F.when(
            test,
            F.struct(
                F.lit(kind).alias("node"),
                (F.lit(None).cast("string") if name is None else name).alias("name"),
                (F.lit(None).cast("string") if callee is None else callee).alias("callee"),
                (no_args if args is None else args).alias("args"),
            ),
        )

    args = F.filter(
        F.transform(F.split(X.extract(t, PYTHON_DEF, 2), ","), X.trim), lambda a: a != ""
    )
    def holds(text):
        return F.contains(t, F.lit(text))

    defined = F.startswith(t, F.lit("def")) & X.matches(t, PYTHON_DEF)
    assigned = holds("=") & X.matches(t, C.PYTHON_ASSIGN) & ~X.starts_with_any(t, NOT_ASSIGNED)
    found = F.array_compact(
        F.array(
            node("FunctionDef", defined, name=X.extract(t, PYTHON_DEF, 1), args=args),
            node("Assign", assigned, name=X.extract(t, C.PYTHON_ASSIGN, 1)),
            node("Call", F.col("_callee") != "", callee=F.col("_callee")),
            node("TryExcept", holds("except") & X.matches(t, PYTHON_EXCEPT_PASS)),
        )
    )
    callee = F.when(holds("("), leftmost_call(t)).otherwise(F.lit(""))
    return (
        lines.where(F.col("is_python") & live)
        .withColumn("_callee", callee)
        .select("repo", "file_path", "line_no", F.col("trimmed").alias("raw"), F.explode(found).alias("n"))
        .select("repo", "file_path", "line_no", "n.node", "n.name", "n.callee", "n.args", "raw")
    )


def _live_js(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("is_js") & ~X.starts_with_any(F.col("trimmed"), C.NODE_SKIP))


def call_sites(lines: DataFrame) -> DataFrame:
    """Calls on a JS / TS line with the kind of their first argument."""
    pattern = F.lit(X.java_pattern(CALL_SITE))
    sites = F.arrays_zip(
        F.regexp_extract_all(F.col("line"), pattern, F.lit(1)).alias("callee"),
        F.regexp_extract_all(F.col("line"), pattern, F.lit(2)).alias("first"),
    )
    kind = (
        F.when(F.col("site.first") == "", F.lit("plain"))
        .when(F.endswith("site.first", F.lit("${")), F.lit("template"))
        .otherwise(F.lit("concatenation"))
    )
    return (
        _live_js(lines)
        .select("repo", "file_path", "line_no", F.posexplode(sites).alias("site_no", "site"))
        .where(~F.col("site.callee").isin(NOT_CALLEES))
        .select("repo", "file_path", "line_no", "site_no", F.col("site.callee").alias("callee"),
                kind.alias("first_argument"))
    )


def declared_literals(lines: DataFrame) -> DataFrame:
    """Variable name and string value of the first declared literal on a line."""
    line = F.col("line")
    value = F.coalesce(
        empty_as_null(X.extract(line, DECLARED_LITERAL, 2)), X.extract(line, DECLARED_LITERAL, 3)
    )
    return (
        _live_js(lines)
        .where(X.matches(line, DECLARED_LITERAL))
        .select("repo", "file_path", "line_no", X.extract(line, DECLARED_LITERAL, 1).alias("name"),
                value.alias("value"))
    )


def markup_targets(lines: DataFrame) -> DataFrame:
    """Assignments to markup properties and JSX attributes that set markup."""
    bare = code_only(F.col("line"))
    jsx = X.matches(bare, JSX_MARKUP)
    is_attribute = X.matches(bare, r"(?:^|\s)dangerouslySetInnerHTML\s*=\s*\{")
    target = F.when(X.matches(bare, ASSIGNED_MARKUP) & ~is_attribute, X.extract(bare, ASSIGNED_MARKUP, 1))
    found = F.array_compact(
        F.array(
            F.when(target.isNotNull(), F.struct(F.lit("assignment").alias("kind"), target.alias("target"))),
            F.when(jsx, F.struct(F.lit("attribute").alias("kind"), X.extract(bare, JSX_MARKUP).alias("target"))),
        )
    )
    return (
        _live_js(lines)
        .where(X.contains_any(F.lower("line"), ("innerhtml", "outerhtml")))
        .select("repo", "file_path", "line_no", F.explode(found).alias("t"))
        .select("repo", "file_path", "line_no", "t.kind", "t.target")
    )


def _by_rule(cases: dict[str, Column], rule_id: Column) -> Column:
    ids = list(cases)
    chain = F.when(rule_id == ids[0], cases[ids[0]])
    for name in ids[1:]:
        chain = chain.when(rule_id == name, cases[name])
    return chain


def node_values(rule_id: Column) -> dict[str, Column]:
    """What fills the markers of a line rule's texts."""
    line, trimmed, python_callee = F.col("line"), F.col("trimmed"), F.col("callee")
    statement = F.col("argument")
    bare = code_only(line)
    callee = {name: _callee(name, bare if name in ("J01", "J05", "J11") else statement) for name in CALLS}
    formatted = (
        F.when(F.contains(trimmed, F.lit(" + ")), F.lit("BinOp(+)"))
        .when(X.matches(trimmed, C.FORMATTED), F.lit("FormattedValue (f-string)"))
        .otherwise(F.lit(".format()"))
    )
    assigned = X.extract(trimmed, C.PYTHON_ASSIGN)
    return {
        "callee": F.coalesce("call.callee", _by_rule(callee, rule_id), python_callee),
        "name": _by_rule(
            {"J09": X.extract(statement, AWS_DECLARED), "J10": X.extract(statement, CREDENTIAL_DECLARED),
             "P06": assigned, "P07": assigned},
            rule_id,
        ),
        "detail": _by_rule({"J02": F.col("call.kind"), "P01": formatted}, rule_id),
        "algorithm": _by_rule(
            {"J04": F.lower(X.extract(statement, HASH_NAME)),
             "P04": F.when(F.contains(python_callee, F.lit("md5")), F.lit("MD5")).otherwise(F.lit("SHA-1"))},
            rule_id,
        ),
        "upper_algorithm": F.upper(X.extract(statement, HASH_NAME)),
        "argument": X.extract(statement, REQUEST_ARGUMENT),
        "target": X.extract(bare, ASSIGNED_MARKUP),
    }


def snippets(rule_id: Column) -> Column:
    """The code a finding shows: whole node text, redacted value or trimmed line.

    Who displays it may cut it; the table keeps it whole.
    """
    line, trimmed, statement = F.col("line"), F.col("trimmed"), F.col("argument")

    whole = F.col("statement")
    # comments are shown, unless the call is only seen without them
    calls = {
        name: X.trim(F.coalesce(empty_as_null(_call_text(name, whole)), _call_text(name, without_comments(whole)))) for name in CALLS
    }
    calls["J11"] = X.trim(_call_text("J11", line))
    # as do calls found by their first argument, if they stand in the statement as they were read
    calls |= {name: X.trim(F.col("call.text")) for name in ("J02", "J03", "J06")}
    return F.coalesce(
        _by_rule(
            {
                **calls,
                "J07": X.trim(X.extract(line, MARKUP_ASSIGNMENT)),
                "J08": X.trim(X.extract(line, JSX_ATTRIBUTE)),
                "J09": F.concat(X.extract(statement, AWS_DECLARED, 1), F.lit(' = "'),
                                F.substring(X.extract(statement, AWS_DECLARED, 2), 1, 8), F.lit('..."')),
                "J10": F.concat(X.extract(statement, CREDENTIAL_DECLARED, 1), F.lit(' = "'),
                                F.substring(X.extract(statement, CREDENTIAL_DECLARED, 2), 1, 4), F.lit('***"')),
                "P07": F.concat(X.extract(trimmed, C.PYTHON_ASSIGN), F.lit(' = "***REDACTED***"')),
            },
            rule_id,
        ),
        trimmed,
    )
