"""Personal data: four rules, and identifiers found by bootstrapped contexts.

The rules give seed entities. The words in front of an entity are its pattern;
patterns and identifier-like words that follow them anywhere in the corpus are the
two sides of a graph. Whatever has a digit, an @ or a separator, and addresses
written out ("at", "dot"), count as identifier-like behind a pattern of at least
``SUPPORT`` seeds; elsewhere only words of the shape ``WORD_LIKE`` do. Rounds of scoring go back and forth over its edges: a
pattern is worth the mean confidence of what follows it, if enough of it is
trusted; a word is as sure as its patterns together (seeds are sure). Words that
stand behind a trusted pattern and are sure enough become spans of the kind
``learned``.

All of it is DataFrame code. Positions come from cutting a text at a rule's
matches: the lengths of the parts and of the matches add up to where each match
is. The graph has one row per distinct pattern and word, counted before they are
shuffled; no document's text is.

The patterns of the rules are written so that they run in linear time: they start
where a run starts and never give back (possessive). Matches that the rules would
drop anyway because they are too short are not looked at.

Rules for odd rows: a null text is empty and has no spans. Rows that repeat a
doc_id are searched each. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.functions.lists import let
from gritlens.llm.store import Stage, whole_row

KINDS = ("email", "ip", "card", "phone")
LEARNED = "learned"

# What the rules match.
MATCHES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap sign that a text may have a match at all.
SIGNS = {
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]")),
    "card": lambda text: F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
IP_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

WORD_LIKE = r"(?<![A-Za-z0-9@._%+-])[A-Za-z]{0,6}+[-_#]?[0-9]{4}[A-Za-z0-9_-]*+(?![@.%+][A-Za-z0-9])"
_SIGN = r"[@_#%+/.:-]"
_AT, _DOT = r"\x20(?:at|\(at\)|\[at\])\x20", r"(?:\x20(?:dot|\(dot\)|\[dot\])\x20|\.)"
# What may be an identifier behind a pattern of seeds: an address written out, or a
# word with a digit or a separator and the further words with digits of its group.
FOLLOWER = (
    r"(?<![A-Za-z0-9@_#%+/.:-])(?:"
    rf"(?i:[a-z0-9][a-z0-9._%+-]*+{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++)"
    rf"|[#+(]?(?:[A-Za-z0-9]++(?:{_SIGN}++[A-Za-z0-9]++)++|[A-Za-z]*+[0-9][A-Za-z0-9]*+)"
    r"(?:\)?\x20(?=[A-Z]*+[0-9])[A-Z0-9][A-Z0-9-]++)*+)"
)
CONTEXT = 64          # characters in front of a match that may hold its pattern: whole words only
PARTS = 32            # parts of a text in front of a match that are looked at; more than CONTEXT characters
ROUNDS = 3
SUPPORT = 3           # trusted words that a pattern needs
TRUSTED, SURE = 0.75, 0.75

SPAN = "array<struct<kind:string,start:int,end:int,value:string,pattern:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Whether a string of digits has the right check digit."""
    places = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
        )),
        F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.rlike(value, F.lit(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    if kind == "card":
        return F.length(_digits(value)).between(13, 19) & passes_luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def running(numbers: Column, add=lambda a, b: a + b) -> Column:
    """What ``add`` makes of each number and those before it.

    A fold copies what it has put together at each step, so it only goes over
    stretches, as many as numbers in one, and then over these.
    """
    none = F.array().cast("array<int>")

    def last(found):
        return F.try_element_at(found, F.lit(-1))

    def fold(xs, value):
        return F.aggregate(xs, none, lambda done, x: F.concat(done, F.array(
            F.when(F.size(done) > 0, add(last(done), value(x))).otherwise(value(x))
        )))

    def stretched(xs):
        long_ = F.ceil(F.sqrt(F.size(xs))).cast("int")
        starts = F.sequence(F.lit(1), F.size(xs), long_)
        return F.transform(starts, lambda at: fold(F.slice(xs, at, long_), lambda x: x))

    def carried(parts):
        return let(fold(parts, last), lambda ends: F.flatten(F.transform(parts, lambda part, i: F.when(
            i == 0, part
        ).otherwise(F.transform(part, lambda x: add(F.get(ends, i - 1), x))))))

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, let(stretched(xs), carried)).otherwise(none))


def _pattern(parts: Column, i: Column, start: Column) -> Column:
    """The last two words in front of match ``i``, in lower case; only whole ones, and none that a longer word hides.

    ``parts`` has the ends of each gap and match. A match's pattern depends on the
    ``CONTEXT`` characters in front of it alone, whatever else is found in the text.
    """
    earlier = F.slice(parts, F.greatest(i - PARTS, F.lit(0)) + 1, F.least(i, F.lit(PARTS)))
    own = F.get(parts, i)["gap"]
    joined = F.concat(F.array_join(F.transform(earlier, lambda p: F.concat(p["gap"], p["hit"])), ""), own)
    near = F.when(F.length(own) >= CONTEXT, own).otherwise(F.substring(joined, -CONTEXT, CONTEXT))
    words = r"((?:\S+\s+)?\S+)\s*$"
    return F.lower(F.when(start <= CONTEXT, F.regexp_extract(near, r"(?:^|\s)" + words, 1)).otherwise(
        F.regexp_extract(near, r"\s" + words, 1)
    ))


def _spans(text: Column, kind: str, match: str) -> Column:
    """All matches as an array of (kind, start, end, value, pattern); positions in code points."""

    def ends(of):
        return running(F.transform(of, lambda x: F.length(x["gap"]) + F.length(x["hit"])))

    def near(of):
        return F.transform(of, lambda x: F.struct(
            F.substring(x["gap"], -CONTEXT, CONTEXT).alias("gap"), F.substring(x["hit"], -CONTEXT, CONTEXT).alias("hit")
        ))

    def placed(of):
        return let(ends(of), lambda e: let(near(of), lambda parts: F.transform(of, lambda x, i: let(
            F.get(e, i) - F.length(x["hit"]), lambda start: F.struct(
                F.lit(kind).alias("kind"), start.alias("start"), F.get(e, i).alias("end"), x["hit"].alias("value"),
                _pattern(parts, i, start).alias("pattern"),
            )
        ))))

    def cut(hits):
        gaps = F.slice(F.split(text, match, -1), F.lit(1), F.size(hits))
        return F.when(F.size(hits) > 0, let(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), placed))

    return F.coalesce(let(F.regexp_extract_all(text, F.lit(match), F.lit(0)), cut), F.array().cast(SPAN))


def rule_spans(text: Column) -> Column:
    """The spans of the four rules, by kind and then by place."""
    none = F.array().cast(SPAN)

    def of(kind: str) -> Column:
        held = F.filter(_spans(text, kind, MATCHES[kind]), lambda s: _holds(kind, s["value"]))
        return F.when(SIGNS[kind](text), held).otherwise(none)

    return F.concat(*[of(kind) for kind in KINDS])


def _apart(words: Column, spans: Column) -> Column:
    """The words that no span overlaps.

    Of the spans that start in front of a word's end, one overlaps it if the
    farthest end of theirs lies behind the word's start: a search in the sorted starts.
    """

    def farthest(sorted_):
        return let(running(sorted_["end"], F.greatest), lambda ends: let(sorted_["start"], lambda starts: F.filter(
            words, lambda w: ~F.coalesce(F.get(ends, before(starts, w["end"]) - 1) > w["start"], F.lit(False))
        )))

    def before(starts, end):
        """How many starts are smaller."""
        steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(starts) + 1)).cast("int") + 1)
        found = F.aggregate(
            steps, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")),
            lambda s, _: let(F.floor((s["low"] + s["high"]) / 2).cast("int"), lambda middle: F.when(
                F.coalesce(F.get(starts, middle) < end, F.lit(False)) & (middle < s["high"]),
                F.struct((middle + 1).alias("low"), s["high"].alias("high")),
            ).otherwise(F.struct(s["low"].alias("low"), F.least(middle, s["high"]).alias("high")))),
        )
        return found["low"]

    few = F.filter(words, lambda w: ~F.exists(spans, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))
    places = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) <= 16, few).otherwise(let(places, farthest))


def _candidates(text: Column, spans: Column) -> Column:
    """Identifier-like words outside the spans."""
    words = F.filter(_spans(text, LEARNED, WORD_LIKE), lambda w: F.length(w["value"]) >= 6)
    return F.when(F.rlike(text, F.lit("[0-9]{4}")), let(words, lambda w: _apart(w, spans))).otherwise(F.array().cast(SPAN))


def _followers(text: Column, spans: Column) -> Column:
    """What may be an identifier behind a pattern of seeds, outside the spans, with the words in front of it."""
    found = F.filter(_spans(text, LEARNED, FOLLOWER), lambda w: w["pattern"] != "")
    return let(found, lambda w: _apart(w, spans))


def _widest(spans: Column) -> Column:
    """The different spans (start, end) that no other one holds, in order: those that end behind all that start before."""
    longest_first = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus"))))
    return let(longest_first, lambda of: let(running(F.transform(of, lambda s: -s["minus"]), F.greatest), lambda ends: F.transform(
        F.filter(of, lambda s, i: (i == 0) | (F.get(ends, i - 1) < -s["minus"])),
        lambda s: F.struct(s["start"].alias("start"), (-s["minus"]).alias("end")),
    )))


def _scored(edges: DataFrame, stage: Stage, rounds: int, support: int) -> DataFrame:
    """(pattern, value, seed, score, sure) after ``rounds`` of going back and forth."""
    now = edges.withColumn("sure", F.col("seed").cast("double")).withColumn("score", F.lit(0.0))
    kept = None
    for turn in range(rounds):
        worth = now.groupBy("pattern").agg((F.sum("sure") / F.count("*")).alias("mean"), F.sum("sure").alias("trusted"))
        worth = worth.select("pattern", F.when(F.col("trusted") >= support, F.col("mean")).otherwise(0.0).alias("score"))
        with_score = now.drop("score", "sure").join(worth, "pattern")
        sure = with_score.groupBy("value").agg(
            F.max("seed").alias("is_seed"),
            F.sum(F.log(F.lit(1.0) - F.least("score", F.lit(0.999)))).alias("doubt"),
        ).select("value", F.when(F.col("is_seed") == 1, 1.0).otherwise(1.0 - F.exp("doubt")).alias("sure"))
        new = stage.keep(with_score.join(sure, "value").select("pattern", "value", "seed", "score", "sure"), f"scores-{turn}")
        if kept is not None:
            stage.drop(kept)
        now = kept = new
    return now


def _found(docs: DataFrame, stage: Stage) -> DataFrame:
    """(row, doc_id, mark, base, words, followers): what the rules and the look of words give, without the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"), rule_spans(text).alias("base"),
    )
    return stage.keep(
        base.select(
            "row", "doc_id", F.xxhash64("text").alias("mark"), "base",
            _candidates(F.col("text"), F.col("base")).alias("words"), _followers(F.col("text"), F.col("base")).alias("followers"),
        ),
        "found",
    )


def learned_words(found: DataFrame, stage: Stage, rounds: int = ROUNDS, support: int = SUPPORT) -> DataFrame:
    """(row, doc_id, mark, start, end, value): identifiers that trusted patterns discover."""
    seeds = found.select(F.explode("base").alias("s")).select("s.pattern", F.lower("s.value").alias("value"), F.lit(1).alias("seed"))

    def at(words):
        return found.select("row", "doc_id", "mark", F.explode(words).alias("s")).select(
            "row", "doc_id", "mark", "s.start", "s.end", F.lower("s.value").alias("value"), "s.pattern"
        )

    supported = seeds.filter("pattern <> ''").groupBy("pattern").agg(F.count_distinct("value").alias("n")).filter(F.col("n") >= support)
    behind = stage.keep(at("followers").join(supported, "pattern", "left_semi").select(*at("words").columns), "followers")
    places = at("words").union(behind)
    edges = seeds.union(places.select("pattern", "value", F.lit(0))).filter("pattern <> ''")
    edges = stage.keep(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "edges")
    good = _scored(edges, stage, rounds, support).filter(
        (F.col("seed") == 0) & (F.col("score") >= TRUSTED) & (F.col("sure") >= SURE)
    ).select("pattern", "value")
    return places.join(good, ["pattern", "value"], "left_semi").select("row", "doc_id", "mark", "start", "end", "value")


def _named(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each document."""
    stage = Stage(docs.sparkSession, "pii")
    found = _found(docs, stage)
    learned = learned_words(found, stage).groupBy("row").agg(
        F.array_join(F.transform(
            _widest(F.collect_set(F.struct("start", "end"))),
            lambda s: F.concat_ws(":", F.lit(LEARNED), s["start"].cast("string"), s["end"].cast("string")),
        ), ",").alias("learned")
    )
    learned = stage.keep(learned, "learned")
    text = _named(F.col("base"))
    return found.join(learned, "row", "left").select(
        "doc_id",
        *[_count("base", kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(text, 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif(text, F.lit("")), "learned").alias("spans"),
    )


CHUNK = 4096  # characters that a piece of a long text is cut from


def _replaced(text: Column, spans: Column) -> Column:
    """The text with the names of the kinds in place of the spans (start, end, kind), of which the first of overlapping ones counts."""
    many = F.size(spans) > CHUNK // 64

    def put(of, ends, chunks):
        # chunks are only cut for texts with many spans, in which each piece would be looked for from the text's start
        def piece(low, high):
            first = F.floor(low / CHUNK).cast("int")
            some = F.array_join(F.slice(chunks, first + 1, F.floor(high / CHUNK).cast("int") - first + 1), "")
            return F.when(many, F.substring(some, low - first * CHUNK + 1, high - low)).otherwise(
                F.substring(text, low + 1, high - low)
            )

        parts = F.transform(of, lambda s, i: let(
            F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)),
            lambda at: F.when(s["start"] >= at, F.concat(piece(at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")),
        ))
        tail = F.try_element_at(ends, F.lit(-1))
        return F.concat(F.array_join(parts, ""), piece(tail, F.length(text)))

    count = F.ceil(F.length(text) / CHUNK).cast("int")
    chunks = F.when(many, F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.substring(text, c * CHUNK + 1, CHUNK)))
    return let(F.array_sort(spans), lambda of: let(
        running(of["end"], F.greatest), lambda ends: let(chunks, lambda cut: put(of, ends, cut))
    ))


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with ``[EMAIL]`` and the like in place of personal data; null texts stay null."""
    stage = Stage(docs.sparkSession, "redaction")
    found = _found(docs, stage)
    place = "struct<start:int,end:int,kind:string>"
    learned = stage.keep(
        learned_words(found, stage).groupBy("doc_id", "mark").agg(
            F.collect_set(F.struct("start", "end", F.lit(LEARNED).alias("kind"))).cast(f"array<{place}>").alias("learned")
        ),
        "learned",
    )
    text = F.col("row.text")
    keyed = docs.select(whole_row(docs).alias("row")).select(
        "row", F.xxhash64(F.coalesce(text, F.lit(""))).alias("own"), F.col("row.doc_id").cast("bigint").alias("id")
    )
    if learned.isEmpty():
        joined = keyed.withColumn("learned", F.array().cast(f"array<{place}>"))
    else:
        joined = keyed.join(learned, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("mark")), "left")
    base = F.transform(rule_spans(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.concat(base, F.coalesce("learned", F.array().cast(f"array<{place}>")))
    marked = joined.select("row", spans.alias("spans"))
    clean = F.when(F.size("spans") > 0, _replaced(text, F.col("spans"))).otherwise(text)
    return marked.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
