"""Findings worked out for a whole file (dependency and quality rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gritlens.rules import catalogue as C
from gritlens.schemas import FILE_ITEM

NO_ITEMS = f"array<{FILE_ITEM}>"


def no_items() -> Column:
    return F.expr(f"CAST(array() AS {NO_ITEMS})")


def item(
    rule_id: str,
    line_no: Column,
    snippet: Column,
    texts: dict[str, Column],
    emit_line: Column | None = None,
    ordinal: Column | None = None,
    severity: Column | None = None,
) -> Column:
    """One finding; ``texts`` are the values of the markers in the rule's texts."""
    number = C.RULE_NUMBER[rule_id]
    pairs = [part for name, value in texts.items() for part in (F.lit(name), value.cast("string"))]
    return F.struct(
        F.lit(number).alias("rule_no"),
        line_no.alias("line_no"),
        (line_no if emit_line is None else emit_line).alias("emit_line"),
        (F.lit(0) if ordinal is None else ordinal).alias("ordinal"),
        (F.lit(C.RULES[number].severity) if severity is None else severity).alias("severity"),
        snippet.alias("snippet"),
        (F.create_map(*pairs) if pairs else F.expr("CAST(map() AS map<string,string>)")).alias("texts"),
    ).cast(FILE_ITEM)
