"""Column helpers for text: trimming, line splitting, dialect-exact patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space and line ends of the pattern dialect the rules
# are written in (ECMAScript).
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_SPACE_CLASS = r"\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_DOT_CLASS = r"[^\n\r\u2028\u2029]"
_WORD_EDGE = r"(?:(?<=[a-zA-Z0-9_])(?![a-zA-Z0-9_])|(?<![a-zA-Z0-9_])(?=[a-zA-Z0-9_]))"


def java_pattern(pattern: str) -> str:
    r"""The Java regex with the meaning ``pattern`` has in the rules' dialect.

    Only four tokens differ: ``\b`` looks at ASCII letters, ``\s`` covers the
    Unicode spaces, ``.`` stops at four line ends, ``$`` is the very end.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == r"\s":
            token = _SPACE_CLASS if in_class else f"[{_SPACE_CLASS}]"
        elif in_class:
            in_class = token != "]"
        elif token == "[":
            in_class = True
        else:
            token = {r"\b": _WORD_EDGE, ".": _DOT_CLASS, "$": r"\z"}.get(token, token)
        out.append(token)
    return "".join(out)


def sql_text(text: str) -> str:
    """A SQL string literal (in Spark's default escaping)."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java_pattern(pattern))


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, ``''`` where there is none."""
    return F.regexp_extract(text, java_pattern(pattern), group)


def trim(text: Column) -> Column:
    """Strip every kind of white space; linear, unlike a ``\\s+$`` pattern."""
    return F.btrim(text, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def contains_any(text: Column, words) -> Column:
    cond = F.lit(False)
    for n, word in enumerate(words):
        test = F.contains(text, F.lit(word))
        cond = test if n == 0 else cond | test
    return cond


def starts_with_any(text: Column, prefixes) -> Column:
    cond = F.lit(False)
    for n, prefix in enumerate(prefixes):
        test = F.startswith(text, F.lit(prefix))
        cond = test if n == 0 else cond | test
    return cond


def one_decimal(value: Column) -> Column:
    """Fixed one-decimal text; exact ties (x.25, x.75) go up."""
    tie = F.pmod(value, F.lit(0.5)) == F.lit(0.25)
    return F.format_number(F.when(tie, value + F.lit(0.01)).otherwise(value), 1)


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Put each value in place of its ``{name}`` marker."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template
