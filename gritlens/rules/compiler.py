"""Turns catalogue rows into expressions over the lines table.

The rules become one SQL expression text, so a plan costs one parse however long
the catalogue is. A line row carries ``line``, ``anchors`` (the anchor words found
in it), ``trimmed``, ``bare`` (literals and trailing comment out), ``statement``
(with the first argument of a call that goes on below), ``callee``,
``is_js``, ``is_python``, one boolean per comment convention and one per
file-level condition.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gritlens.functions import text as X
from gritlens.functions.lists import let
from gritlens.functions.text import sql_text
from gritlens.rules import catalogue as C

LINE_STAGES = (C.NODES, C.SHARED, C.SECOND_PASS, C.HEURISTIC)
LINE_RULES = [rule for rule in C.RULES if rule.stage in LINE_STAGES]

# Leftmost call of a Python line. The name is taken whole and only from its
# start, which matches the same text as an unanchored name in linear time.
LEFTMOST_CALL = r"(?<![a-zA-Z0-9_.])([a-zA-Z0-9_.]++)\s*\((.*)\)"
STRING_LITERAL = r'''"[^"]*"|'[^']*\''''
TRAILING_COMMENT = r"//.*"
STRING_OR_COMMENT = (
    r"""("[^"\\\n]*+(?:\\.[^"\\\n]*+){0,999}+"|'[^'\\\n]*+(?:\\.[^'\\\n]*+){0,999}+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+){0,999}+`)"""
    r"|//[^\n]*|/\*[\s\S]*?\*/"
)

# A call some rule looks at.
LOOKED_FOR = f"(?:{C.QUERIES}|{C.COMMANDS}|{C.REQUESTS}|createHash)" + r"\s*\("
CALL = "(?i)" + LOOKED_FOR
# A line that ends inside the first argument of such a call, or before the value of a declaration.
OPEN_CALL = r"(?i)(?:(?:^|[^\w$])(?:const|let|var)\s[^;]*[^=!<>]=\s*$|" + LOOKED_FOR + r"\s*(`[^`]*)?$)"
# What can open or close a bracket, string, template, comment or regular expression;
# a slash behind an operator or an opening bracket begins the latter (but in markup).
PATTERN_START = r"(?<=[(,=:\[!&|?{;+\-*%~^])[ \t]*+/(?![/*>])"
TOKEN = CALL + r"""|\\.|//|/\*|\*/|""" + PATTERN_START + r"""|/|\$\{|["'`()\[\]{},]"""
SCOPES = {"js": "is_js", "python": "is_python", "code": "(is_js OR is_python)"}
SUBJECTS = {"line": "line", "trimmed": "trimmed", "code": "bare", "statement": "argument"}
COMMENTS = {
    C.HEURISTIC_SKIP: "heuristic_comment", C.SHARED_SKIP: "shared_comment",
    C.PYTHON_SKIP: "python_comment", C.NODE_SKIP: "node_comment",
}
CONDITION_NAMES = [*C.GUARD_ABSENT, "no_expiry", "credentials_header"]


def file_conditions(content: Column, low: Column) -> dict[str, Column]:
    """The file-level conditions, by name."""
    found = {name: ~X.contains_any(low, words) for name, words in C.GUARD_ABSENT.items()}
    found["no_expiry"] = ~F.contains(content, F.lit(C.NO_EXPIRY_TEXT))
    found["credentials_header"] = F.contains(content, F.lit(C.CREDENTIALS_HEADER))
    return found


def code_only(line: Column) -> Column:
    """The line with string literals emptied and a trailing comment cut."""
    bare = F.regexp_replace(line, STRING_LITERAL, '""')
    return F.regexp_replace(bare, X.java_pattern(TRAILING_COMMENT), "")


def without_comments(code: Column) -> Column:
    """Code of one or more lines with its comments out; strings stay."""
    return F.regexp_replace(code, X.java_pattern(STRING_OR_COMMENT), "$1")


def may_continue(content: Column) -> Column:
    """Whether any call or declaration of a file can go on below its line."""
    return X.contains_any(content, ("=\n", "=\r\n", "= \n")) | F.contains(content, F.lit("\n")) & X.matches(content, CALL)


def _after(state: Column, token: Column, i: Column) -> Column:
    """The state behind a token of line ``i``.

    The stack holds the openers that are open, the last one in front: C is a call
    looked for, c one behind its first argument, R a regular expression, K a
    class in it. ``calls`` are the calls among them, ``ended`` those that ended in this
    line below their own.
    """
    stack, calls, ended = state["stack"], state["calls"], state["ended"]
    top, cut = F.substring(stack, 1, 1), F.substring(stack, 2, 1 << 30)
    code = ~top.isin('"', "'", "`", "*", "/", "R", "K")
    opens = code & (F.length(token) > 2) & F.endswith(token, F.lit("("))
    closes = code & token.isin(")", "]", "}")
    ends_call, ends_first = closes & top.isin("C", "c"), code & (token == ",") & (top == "C")
    last, outer = F.try_element_at(calls, F.lit(-1)), F.try_element_at(calls, F.lit(-2))
    first = F.coalesce(last["first"], i)

    def but(n, *more):
        kept = F.slice(calls, F.lit(1), F.greatest(F.size(calls) - n, F.lit(0)))
        return F.concat(kept, F.array(*more)) if more else kept

    def call(pos, first):
        return F.struct(pos.alias("pos"), first.cast("int").alias("first"))

    # A call in another one of the same line is part of it.
    within = outer["pos"] == last["pos"]
    new_stack = (
        F.when(top.isin('"', "'"), F.when(token == top, cut).otherwise(stack))
        .when(top == "`", F.when(token == "`", cut).when(token == "${", F.concat(F.lit("$"), stack)).otherwise(stack))
        .when(top == "*", F.when(token == "*/", cut).otherwise(stack))
        .when(top == "R", F.when(F.endswith(token, F.lit("/")), cut).when(token == "[", F.concat(F.lit("K"), stack)).otherwise(stack))
        .when(top == "K", F.when(token == "]", cut).otherwise(stack))
        .when(top == "/", stack)
        .when(closes, cut)
        .when(token == ",", F.when(top == "C", F.concat(F.lit("c"), cut)).otherwise(stack))
        .when(opens, F.concat(F.lit("C"), stack))
        .when(token.isin("*/", "/") | F.startswith(token, F.lit("\\")), stack)
        .when((token != "//") & F.endswith(token, F.lit("/")), F.concat(F.lit("R"), stack))
        .otherwise(F.concat(F.substring(token, -1, 1), stack))
    )
    new_calls = (
        F.when(opens, F.concat(calls, F.array(call(i, F.lit(None)))))
        .when(ends_first, but(1, call(last["pos"], i)))
        .when(ends_call & within, but(2, call(outer["pos"], F.when(outer["first"].isNotNull(), F.greatest(outer["first"], first)))))
        .when(ends_call, but(1)).otherwise(calls)
    )
    one = F.array(F.struct(last["pos"].alias("pos"), first.alias("first"), i.alias("last")))
    adds = ends_call & (i > last["pos"]) & ~F.coalesce(within, F.lit(False))
    return F.struct(
        new_stack.alias("stack"), new_calls.alias("calls"), F.when(adds, F.concat(ended, one)).otherwise(ended).alias("ended")
    )


# Of each ended call its line, that of its first argument's end and that of its closing bracket.
ENDED = "array<struct<pos:int,first:int,last:int>>"


def open_calls(lines: Column) -> Column:
    """(calls still open, calls looked for that ended below their line), by one fold over the lines.

    Brackets are counted outside strings, comments and regular expressions,
    however deep. Lines between such calls are only searched for the next one.
    A fold copies its state at each step, so what has ended is not kept in it: that
    of a line's tokens holds the line's, that of a stretch of lines the stretch's,
    and stretches are as many as lines in one.
    """
    none = F.array().cast(ENDED)

    def state(stack, calls, ended):
        return F.struct(stack.alias("stack"), calls.alias("calls"), ended.alias("ended"))

    def line_after(before, i):
        tokens = F.regexp_extract_all(F.get(lines, i), F.lit(X.java_pattern(TOKEN)), F.lit(0))
        start = state(before["stack"], before["calls"], none)
        return let(
            F.aggregate(tokens, start, lambda s, token: _after(s, token, i)), lambda found: line_ended(found, before["ended"])
        )

    def line_ended(found, ended):
        # A string, line comment and regular expression end with the line, and all does when no call is open.
        stack = found["stack"]
        kept = (
            F.when(F.size(found["calls"]) == 0, F.lit(""))
            .when(F.substring(stack, 1, 1) == "K", F.substring(stack, 3, 1 << 30))
            .when(F.substring(stack, 1, 1).isin('"', "'", "/", "R"), F.substring(stack, 2, 1 << 30))
            .otherwise(stack)
        )
        return state(kept, found["calls"], F.concat(ended, found["ended"]))

    def step(before, i):
        line = F.get(lines, i)
        idle = (F.size(before["calls"]) == 0) & (~X.matches(line, CALL) | X.starts_with_any(X.trim(line), C.NODE_SKIP))
        return F.when(idle, before).otherwise(line_after(before, i))

    many = F.size(lines)
    long_ = F.ceil(F.sqrt(many)).cast("int")

    def stretch(before, b):
        inside = F.sequence(b * long_, F.least((b + 1) * long_, many) - 1)
        found = F.aggregate(inside, state(before["stack"], before["calls"], none), step)
        return let(found, lambda f: state(f["stack"], f["calls"], F.concat(before["ended"], f["ended"])))

    start = state(F.lit(""), F.array().cast("array<struct<pos:int,first:int>>"), none)
    stretches = F.sequence(F.lit(0), F.floor((many - 1) / long_).cast("int"))
    return F.aggregate(
        stretches, start, stretch, lambda s: F.struct(s["calls"]["pos"].alias("open"), s["ended"].alias("ended"))
    )


def _next_at(places: Column) -> Column:
    """For each number up to the last of ``places`` (rising) the least one of them that is not smaller."""
    return let(places, lambda of: F.flatten(F.transform(
        of, lambda p, j: F.array_repeat(p, p - F.when(j > 0, F.get(of, j - 1)).otherwise(-1))
    )))


CODE_LINE = "struct<line:string,argument:string,statement:string>"


def code_lines(lines: Column) -> Column:
    """Each line, and the texts that follow where a call or declaration goes on below it (CODE_LINE).

    ``argument`` ends with the line in which the call's first argument ends,
    ``statement`` with that of its closing bracket; comment lines are left out. A
    declaration, and a call without a closing bracket, takes all lines up to the end
    of a template literal, else up to the next line with a closing bracket or a semicolon.
    Entries are put in the order of their lines and met with these by position, so
    no line searches for its own.
    """

    def positions(test):
        return F.array_compact(F.transform(lines, lambda line, i: F.when(test(line), i)))

    def has_tick(line):
        return F.contains(line, F.lit("`"))

    def is_comment(line):
        return X.starts_with_any(X.trim(line), C.NODE_SKIP)

    def is_open(line):
        bare = F.rtrim(line)
        cheap = F.endswith(bare, F.lit("(")) | F.endswith(bare, F.lit("(\r")) | F.endswith(bare, F.lit("=")) | (
            F.endswith(bare, F.lit("=\r")) | has_tick(line)
        )
        return cheap & X.matches(line, OPEN_CALL)

    def is_end(line):
        return X.contains_any(line, (")", ";")) & ~is_comment(line)

    def entry(i, rank, first, last):
        return F.struct(i.alias("pos"), F.lit(rank).alias("rank"), first.cast("int").alias("first"), last.cast("int").alias("last"))

    def following(i, ticks, ends):
        second = F.coalesce(F.get(lines, i + 1), F.lit(""))
        odd = (F.length(second) - F.length(F.replace(second, F.lit("`"), F.lit("")))) % 2 == 1
        inside = X.extract(F.get(lines, i), OPEN_CALL, 1) != ""
        first = F.when(inside, i).when(odd, i + 1)
        close = F.get(ticks, first + 1)  # the tick after it
        last = F.coalesce(F.get(ends, F.coalesce(close, i + 1)), close, i + 1)
        return entry(i, 1, last, last)

    def rest(opens):
        found = let(_next_at(positions(has_tick)), lambda ticks: let(
            _next_at(positions(is_end)), lambda ends: F.transform(opens, lambda i: following(i, ticks, ends))
        ))
        return F.when(F.size(opens) > 0, found).otherwise(F.array().cast("array<struct<pos:int,rank:int,first:int,last:int>>"))

    def entries(found):
        ended = F.transform(found["ended"], lambda c: entry(c["pos"], 0, c["first"], c["last"]))
        return F.array_sort(F.concat(ended, rest(F.concat(positions(is_open), found["open"]))))

    def by_line(sorted_):
        # one entry a line: the call that ended comes first
        return F.flatten(F.transform(sorted_, lambda e, j: let(
            F.when(j > 0, F.get(sorted_, j - 1)["pos"]).otherwise(F.lit(-1)),
            lambda before: F.when(e["pos"] == before, F.array().cast("array<struct<first:int,last:int>>")).otherwise(F.concat(
                F.array_repeat(F.lit(None).cast("struct<first:int,last:int>"), e["pos"] - before - 1),
                F.array(F.struct(e["first"].alias("first"), e["last"].alias("last"))),
            )),
        )))

    def below(i, last):
        return F.array_join(F.filter(F.slice(lines, i + 2, last - i), lambda line: ~is_comment(line)), "\n")

    def with_texts(own):
        return F.transform(lines, lambda line, i: let(F.get(own, i), lambda e: F.struct(
            line.alias("line"), F.when(e["first"] > i, below(i, e["first"])).alias("argument"),
            F.when(e.isNotNull(), below(i, e["last"])).alias("statement"),
        )))

    return let(let(open_calls(lines), entries), lambda sorted_: let(by_line(sorted_), with_texts))


def plain_lines(lines: Column) -> Column:
    """As ``code_lines`` for a text in which nothing goes on below its line."""
    none = F.lit(None).cast("string")
    return F.transform(lines, lambda line: F.struct(line.alias("line"), none.alias("argument"), none.alias("statement")))


# What the rules ask of a call's first argument, and how its call is named.
ASKED = {"built_query": ("q", C.QUERIES), "built_command": ("e", C.COMMANDS), "outer_request": ("f", C.REQUESTS)}
# A call that is found: its name, how the argument is put together, the whole call.
CALLED = "struct<callee:string,kind:string,text:string>"
# Cuts code into pieces that cover it: calls asked for (with a back tick right behind
# the bracket), words, operators, brackets, quotes, the rest.
PIECE = (
    r"(?i)[\w$.]*(?:" + "|".join(name for _, name in ASKED.values()) + r")\s*\(\s*`?"
    + r"""|(?:[\w.]|\$(?!\{))++|\\[\s\S]?|""" + PATTERN_START + r"""|\$\{|\+[+=]?|["'`()\[\]{},=<>?:&|;/\n]"""
    + r"""|[^\w$.\\"'`()\[\]{},+=<>?:&|;/\n]+"""
)
BINARY, TEMPLATE = "BinaryExpression (+) string concatenation", "TemplateExpression (${...}) variable interpolation"


def _after_piece(state: Column, piece: Column) -> Column:
    """The state behind a piece of code.

    On the stack, the last opener in front, are brackets, quotes and the calls
    asked for: q and e while the first argument may still be a sum or template (Q
    and E: it is a sum, t and T: it is a template that is filled in), f within that of
    a request, c behind it. s is a template that begins the argument (S: with
    something filled in), R a regular expression, K a class in it.
    """
    stack, opened, at = state["stack"], state["open"], state["at"]
    top, cut = F.substring(stack, 1, 1), F.substring(stack, 2, 1 << 30)
    code = ~top.isin('"', "'", "`", "s", "S", "R", "K")
    is_call = code & (F.length(piece) > 1) & F.contains(piece, F.lit("("))
    closes = code & piece.isin(")", "]", "}")
    ends = closes & top.isin("q", "Q", "t", "e", "E", "T", "f", "c")
    comma = code & (piece == ",")
    tick = F.endswith(piece, F.lit("`"))
    low = code & (piece.isin("=", "<", ">", "?", ":", "&", "|", ";", "{", "+="))
    kind = F.lit("q")
    for letter, name in list(ASKED.values())[1:]:
        kind = F.when(X.matches(piece, r"(?i)(?:^|[\w$.])" + name + r"\s*\(\s*`?$"), F.lit(letter)).otherwise(kind)
    kind = F.when(X.matches(piece, r"(?i)" + C.QUERIES + r"\s*\(\s*`?$"), F.lit("q")).otherwise(kind)

    def put(new, under=stack):
        return F.concat(new if isinstance(new, Column) else F.lit(new), under)

    # Behind a template anything but an end or a sum makes it part of something else.
    turned = F.when(top == "t", put("q", cut)).when(top == "T", put("e", cut)).otherwise(stack)
    dead = F.when(top.isin("q", "Q", "t", "e", "E", "T"), put("c", cut)).otherwise(stack)
    new_stack = (
        F.when(top.isin('"', "'"), F.when((piece == top) | (piece == "\n"), cut).otherwise(stack))
        .when(top.isin("`", "s") & (piece == "${"), F.when(top == "s", put("$S", cut)).otherwise(put("$")))
        .when((top == "S") & (piece == "${"), put("$"))
        .when(top.isin("`", "s"), F.when(tick, cut).otherwise(stack))
        .when(top == "S", F.when(tick, F.when(F.substring(cut, 1, 1) == "q", put("t", F.substring(cut, 2, 1 << 30)))
              .when(F.substring(cut, 1, 1) == "e", put("T", F.substring(cut, 2, 1 << 30))).otherwise(cut)).otherwise(stack))
        .when(top == "R", F.when(piece.isin("/", "\n"), cut).when(piece == "[", put("K")).otherwise(stack))
        .when(top == "K", F.when(piece == "]", cut).when(piece == "\n", F.substring(stack, 3, 1 << 30)).otherwise(stack))
        .when(is_call, F.when(tick, put(F.concat(F.lit("s"), kind), turned)).otherwise(put(kind, turned)))
        .when(closes, cut)
        .when(comma, F.when(top == "f", put("c", cut)).otherwise(dead))
        .when(piece == "+", F.when(top.isin("q", "t"), put("Q", cut)).when(top.isin("e", "T"), put("E", cut)).otherwise(stack))
        .when(low, F.when(piece == "{", put("{", dead)).otherwise(dead))
        .when(piece.isin("(", "[", '"', "'", "`"), put(piece, turned))
        .when((F.length(piece) > 1) & F.endswith(piece, F.lit("/")) | (piece == "/") & state["operator"], put("R", turned))
        .when(F.btrim(piece, F.lit(X.WHITESPACE)) == "", stack)
        .otherwise(turned)
    )
    last = F.try_element_at(opened, F.lit(-1))
    new_open = (
        F.when(is_call, F.concat(opened, F.array(F.struct(kind.alias("letter"), piece.alias("callee"), at.alias("start")))))
        .when(ends, F.slice(opened, F.lit(1), F.size(opened) - 1)).otherwise(opened)
    )
    behind = at + F.length(piece)

    def found(name, letter, now, which, how):
        """What is found for a question; the first call counts, its size is known at its end."""
        before = state[name]
        new = F.struct(
            which["callee"].alias("callee"), how.alias("kind"), which["start"].alias("start"),
            F.when(ends & (which["start"] == last["start"]), behind - which["start"]).alias("size"),
        )
        whole = F.struct(
            before["callee"].alias("callee"), before["kind"].alias("kind"), before["start"].alias("start"),
            F.when(ends & (last["start"] == before["start"]), behind - before["start"]).otherwise(before["size"]).alias("size"),
        )
        return F.when(before.isNotNull(), whole).when(now, new).alias(name)

    over = ends | comma
    request = F.try_element_at(F.filter(opened, lambda o: o["letter"] == "f"), F.lit(-1))
    return F.struct(
        behind.alias("at"), new_stack.alias("stack"), new_open.alias("open"),
        F.when(F.btrim(piece, F.lit(X.WHITESPACE)) == "", state["operator"]).otherwise(
            X.matches(piece, r"^[(,=:\[!&|?{;+\-*%~^]$|[(=+!*%~^-]\s*$")).alias("operator"),
        found("built_query", "q", over & top.isin("Q", "t"), last, F.when(top == "Q", F.lit(BINARY)).otherwise(F.lit(TEMPLATE))),
        found("built_command", "e", over & top.isin("E", "T"), last, F.when(top == "E", F.lit(BINARY)).otherwise(F.lit(TEMPLATE))),
        found("outer_request", "f", F.contains(stack, F.lit("f")) & X.matches(piece, "(?i)" + C.REQUEST_INPUT), request, F.lit("")),
    )


def asked_calls(code: Column) -> Column:
    """What the rules ask of first arguments: per name in ``ASKED`` the first call for which it is so (CALLED).

    One fold over the pieces of a statement without comments; its state is what is open.
    """
    record = "struct<callee:string,kind:string,start:int,size:int>"
    start = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("stack"),
        F.array().cast("array<struct<letter:string,callee:string,start:int>>").alias("open"), F.lit(True).alias("operator"),
        *[F.lit(None).cast(record).alias(name) for name in ASKED],
    )

    def called(end, name, letters):
        # a sum in a call that is not closed: the outermost one
        at = F.try_element_at(F.filter(end["open"], lambda o: o["letter"] == ASKED[name][0]), F.lit(1))
        open_ = F.when(F.contains(end["stack"], F.lit(letters)), F.struct(
            at["callee"].alias("callee"), F.lit(BINARY).alias("kind"), at["start"].alias("start"), F.lit(None).cast("int").alias("size")
        ))
        hit = F.coalesce(end[name], open_) if letters else end[name]
        text = F.substring(code, hit["start"] + 1, F.coalesce(hit["size"], F.length(code)))
        return F.when(hit["callee"].isNotNull(), F.struct(
            X.extract(hit["callee"], r"^([\w$.]*)").alias("callee"), hit["kind"].alias("kind"), text.alias("text")
        )).cast(CALLED).alias(name)

    pieces = F.regexp_extract_all(code, F.lit(X.java_pattern(PIECE)), F.lit(0))
    return let(F.aggregate(pieces, start, _after_piece), lambda end: F.struct(
        called(end, "built_query", "Q"), called(end, "built_command", "E"), called(end, "outer_request", ""),
    ))


def call_of(rule_no: Column) -> Column:
    """Of the line's ``calls`` the one that the rule has found (CALLED)."""
    found = F.lit(None).cast(CALLED)
    for rule in LINE_RULES:
        if rule.call:
            found = F.when(rule_no == _number(rule), F.col(f"calls.{rule.call}")).otherwise(found)
    return found


def leftmost_call(trimmed: Column) -> Column:
    """Name of the leftmost call, ``''`` without one or on a ``def`` line."""
    call = F.regexp_extract(trimmed, X.java_pattern(LEFTMOST_CALL), 1)
    return F.when(F.startswith(trimmed, F.lit("def ")), F.lit("")).otherwise(call)


def _any_word(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {sql_text(w)})" for w in words) + ")"


def _shortest(words: set[str]) -> list[str]:
    """Words of which no other one is a part: enough to find any of them."""
    kept: list[str] = []
    for word in sorted(words, key=lambda w: (len(w), w)):
        if not any(k in word for k in kept):
            kept.append(word)
    return sorted(kept)


# The words looked for. Every anchor of a rule contains one of them.
ANCHORS = _shortest({a for rule in LINE_RULES for a in rule.anchors})


# Characters from rare to common in code and prose. An anchor is looked for at its
# rarest character: nearly all positions of a line then fail on one class test.
RARE_FIRST = "qzjx%+$_-/6941k25vwybgfp.(mucdhlsinrtaoe"


def _split_at_rarest(word: str) -> tuple[str, str]:
    at = min(range(len(word)), key=lambda i: RARE_FIRST.find(word[i]) % 100)
    return word[:at], word[at:]


def _escaped(text: str) -> str:
    return "".join(c if c.isalnum() or c in " _" else "\\" + c for c in text)


def word_pattern(words: list[str]) -> str:
    """Finds any of the words at its rarest character, looking back at what precedes."""
    branches: dict[str, list[str]] = {}
    for head, tail in map(_split_at_rarest, words):
        rare = tail[0]
        before = f"(?<={_escaped(head + rare)})" if head else ""
        branches.setdefault(rare, []).append(before + _escaped(tail[1:]))
    letters = sorted(branches, key=RARE_FIRST.find, reverse=True)
    some = "|".join(f"{_escaped(c)}(?:{'|'.join(branches[c])})" for c in letters)
    return f"(?=[{''.join(map(_escaped, letters))}])(?:{some})"


def anchor_filter() -> Column:
    """One cheap necessary test for all rules: lets most lines leave early."""
    return F.expr(f"line RLIKE {sql_text('(?i)' + word_pattern(ANCHORS))}")


def found_anchors(line: Column) -> Column:
    """All anchor words in a line (their ends), also where they overlap."""
    pattern = F.lit(f"(?=({word_pattern(ANCHORS)}))")
    return F.array_distinct(F.regexp_extract_all(F.lower(line), pattern, F.lit(1)))


def _any_anchor(anchors: Iterable[str]) -> str:
    ends = sorted({_split_at_rarest(next(w for w in ANCHORS if w in anchor))[1] for anchor in anchors})
    return "(" + " OR ".join(f"array_contains(anchors, {sql_text(e)})" for e in ends) + ")"


def _match(column: str, pattern: str) -> str:
    return f"{column} RLIKE {sql_text(X.java_pattern(pattern))}"


def condition(rule: C.Rule, anchored: bool = True) -> str:
    """Whether the rule matches the line. Cheap tests come first."""
    subject = SUBJECTS[rule.subject]
    tests = [SCOPES[rule.scope]] if rule.scope != "all" else []
    if rule.skip:
        tests.append(f"NOT {COMMENTS[rule.skip]}")
    if anchored:
        tests.append(_any_anchor(rule.anchors))
    if rule.guard:
        tests.append(rule.guard)
    if rule.callee:
        tests.append(_match("callee", rule.callee))
    if rule.call:
        tests.append(f"calls.{rule.call} IS NOT NULL")
    found = " AND ".join(_match(subject, pattern) for pattern in rule.every)
    if rule.instead:
        pattern, name = rule.instead
        found = f"(({found}) OR ({name} AND {_match(subject, pattern)}))"
    tests += [found] if found else []
    tests += [f"NOT ({_match(subject, pattern)})" for pattern in rule.none]
    if rule.callee_none:
        name, words = rule.callee_none
        tests.append(f"NOT (callee = {sql_text(name)} AND {_any_word(subject, words)})")
    return "(" + " AND ".join(tests) + ")"


def needs(column: str) -> Column:
    """Whether any rule that reads ``callee``, ``calls`` or ``bare`` may match the line."""
    of = {"callee": lambda r: r.callee, "calls": lambda r: r.call, "bare": lambda r: SUBJECTS[r.subject] == "bare"}[column]
    reading = [r for r in LINE_RULES if of(r)]
    scope = SCOPES["python"] if column == "callee" else SCOPES["js"]
    return F.expr(f"{scope} AND {_any_anchor({a for r in reading for a in r.anchors})}")


def _number(rule: C.Rule) -> int:
    return C.RULE_NUMBER[rule.rule_id]


def all_hits(rules: Iterable[C.Rule] = LINE_RULES, anchored: bool = True) -> Column:
    """Every rule that matches the line: array of rule numbers."""
    cases = [f"CASE WHEN {condition(r, anchored)} THEN {_number(r)} END" for r in rules]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


def kept_hits(rules: Iterable[C.Rule] = LINE_RULES, anchored: bool = True) -> Column:
    """The matches that become findings: array of rule numbers.

    Of the rules that name the same weakness only the first in emission order
    reports a line; of a first-match group only the first match counts at all.
    Both orders are known here, so each weakness is one CASE and no row is
    compared with another.
    """
    group: dict[str, list[tuple[str, str | None]]] = {}
    by_weakness: dict[str, list[str]] = {}
    for rule in rules:
        test = condition(rule, anchored)
        if rule.group:
            before = group.setdefault(rule.group, [])
            # Same weakness: the CASE already prefers the earlier rule.
            others = [other for other, cwe in before if cwe != rule.cwe]
            before.append((test, rule.cwe))
            if others:
                test = f"({test} AND NOT ({' OR '.join(others)}))"
        by_weakness.setdefault(rule.cwe or rule.title, []).append(f"WHEN {test} THEN {_number(rule)}")
    cases = [f"CASE {' '.join(branches)} END" for branches in by_weakness.values()]
    return F.expr(f"array_compact(array({', '.join(cases)}))")


RULES_SCHEMA = (
    "rule_no int, rule_id string, stage int, emit_block int, category string, rule_severity string, "
    "title_text string, cwe string, owasp string, node_text string, method string, "
    "description_text string, recommendation_text string"
)


def rules_table(spark: SparkSession) -> DataFrame:
    """The rules dimension: one row per catalogue row, a few dozen in all."""
    rows = [
        (n, r.rule_id, r.stage, r.stage * 10 + r.block, r.category, r.severity, r.title, r.cwe,
         r.owasp, r.node_type, r.method, r.description, r.recommendation)
        for n, r in enumerate(C.RULES)
    ]
    return spark.createDataFrame(rows, RULES_SCHEMA)
