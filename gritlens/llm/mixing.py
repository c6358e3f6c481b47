"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, shuffled by a hash, are one stream of words, cut into blocks
of equal length; a target beyond the source's size goes around a second time. The
schedule has a slot per block: the points of the van der Corput sequence, mapped
through the cumulative slot counts of the sources, say whose turn it is, so each
stretch of the schedule has every source in proportion. A source's slots are
ranked in the order of the schedule and take its blocks in turn; the last slot is
cut where the target is reached, so a source gives exactly its target's words.

The sequence is taken where it is a grid: of the 2^k points, k with at least as
many points as slots, the one at or behind each slot's place in the cumulative
counts is its own. So every slot has a point, in whole numbers, at any size.

All of it is DataFrame code. Sums and ranks along a source run over stretches of
bounded size (``running_totals``), so a source may hold any part of the rows.

Rules for odd rows: a null text has no words. A null source is a source, the last.
Rows that repeat a doc_id are documents of their own; equal rows are exchangeable.
Without words every target is 0. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gritlens.llm.store import Stage, row_hash, whole_row
from gritlens.plans.skew import running_totals

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)   # of the sources in code point order, repeating
TOTAL = 1.5           # of all words
MOST = 2              # times a source, and so a document, is taken at most
BLOCK = 1024          # words of a slot
PART = 4096           # slots that one row gives rise to


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_key(source: str) -> Column:
    """Sorts as the source by code point, null last; never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def source_targets(sized: DataFrame, stage: Stage) -> DataFrame:
    """(source_key, source_size, target, quota, first_slot, n_slots) per source of (source_key, size) rows.

    The share of a source whose target stops at its size is dealt again by weight:
    the level at which the weights' shares and the stopped ones make the total.
    Each round asks for two sums over the sources.
    """
    sums = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("place") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = stage.keep(
        running_totals(sums, [], ["source_key"], {"place": F.lit(1)}).withColumn("weight", weight), "sources"
    )
    words, weights = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = TOTAL * (words or 0)
    level, before = wanted / weights if weights else 0.0, None
    while level != before:
        before = level
        stops = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        full, open_ = ranked.agg(
            F.sum(F.when(stops, MOST * F.col("source_size")).otherwise(0)), F.sum(F.when(~stops, F.col("weight")).otherwise(0.0))
        ).first()
        if open_:
            level = (wanted - full) / open_
    target = F.least(F.col("weight") * F.lit(level), (MOST * F.col("source_size")).cast("double"))
    quota = F.floor(target).cast("bigint")
    slots = F.ceil(F.col("quota") / BLOCK).cast("bigint")
    counted = ranked.withColumn("target", target).withColumn("quota", quota).withColumn("n_slots", slots)
    placed = running_totals(
        counted.select("source_key", "source_size", "target", "quota", "n_slots"), [], ["source_key"], {"slots_to": F.col("n_slots")}
    )
    return stage.keep(placed.withColumn("first_slot", F.col("slots_to") - F.col("n_slots")).drop("slots_to"), "targets")


def schedule(targets: DataFrame) -> DataFrame:
    """(slot, source_key, block): the order of the mix, and the block that each slot takes."""
    total = targets.agg(F.sum("n_slots")).first()[0] or 0
    bits = max(1, (max(total, 1) - 1).bit_length())
    parts = targets.filter("n_slots > 0").select(
        "source_key", "first_slot", "n_slots",
        F.explode(F.sequence(_long(0), F.floor((F.col("n_slots") - 1) / PART).cast("bigint"))).alias("part"),
    )
    own = parts.repartition("source_key", "part").select(
        "source_key",
        F.explode(F.sequence(
            F.col("first_slot") + F.col("part") * PART,
            F.col("first_slot") + F.least((F.col("part") + 1) * PART, F.col("n_slots")) - 1,
        )).alias("g"),
    )
    point = F.expr(f"cast((cast(g as decimal(19,0)) * cast({1 << bits} as decimal(19,0)) + {max(total, 1) - 1}) div {max(total, 1)} as bigint)")
    turned = F.conv(F.reverse(F.lpad(F.bin(point), bits, "0")), 2, 10).cast("bigint")
    ranked = running_totals(own.select("source_key", turned.alias("slot")), ["source_key"], ["slot"], {"rank": F.lit(1)})
    return ranked.select("slot", "source_key", (F.col("rank") - 1).alias("block"))


@dataclass
class Mix:
    """What a mix decides: documents with their place, sources, the schedule, what each slot takes."""

    documents: DataFrame  # row, doc_id, source_key, size, and the columns kept
    targets: DataFrame
    schedule: DataFrame
    taken: DataFrame      # slot, row, doc_id, source_key, size, epoch, from_word, words


def mix(docs: DataFrame, keep: list[str] = ()) -> Mix:
    """Decide the mix of documents (doc_id, text, source); ``keep`` names expressions or columns to carry along."""
    spark = docs.sparkSession
    stage = Stage(spark, "mixing")
    sized = stage.keep(
        docs.select(
            F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
            source_key("source").alias("source_key"), word_count("text").alias("size"), *keep,
        ),
        "documents",
    )
    targets = source_targets(sized, stage)
    slots = stage.keep(schedule(targets), "schedule")
    # where each document ends in its source's stream
    streams = running_totals(
        sized.filter("size > 0").select("source_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("shuffle"), "doc_id", "size", "row"),
        ["source_key"], ["shuffle", "doc_id", "size", "row"], {"end": F.col("size")},
    )
    placed = streams.join(targets.select("source_key", "source_size", "quota"), "source_key").select(
        "row", "doc_id", "source_key", "size", "quota",
        F.explode(F.array(*[_long(e) for e in range(MOST)])).alias("epoch"), "source_size", "end",
    )
    start = F.col("end") - F.col("size") + F.col("epoch") * F.col("source_size")
    inside = placed.withColumn("start", start).withColumn("stop", F.least(F.col("start") + F.col("size"), F.col("quota"))).filter("start < stop")
    pieces = inside.select(
        "row", "doc_id", "source_key", "size", "epoch", "start", "stop",
        F.explode(F.sequence(F.floor(F.col("start") / BLOCK).cast("bigint"), F.floor((F.col("stop") - 1) / BLOCK).cast("bigint"))).alias("block"),
    )
    low = F.greatest("start", F.col("block") * BLOCK)
    taken = pieces.join(slots, ["source_key", "block"]).select(
        "slot", "row", "doc_id", "source_key", "size", "epoch", (low - F.col("start")).alias("from_word"),
        (F.least("stop", (F.col("block") + 1) * BLOCK) - low).alias("words"),
    )
    return Mix(sized, targets, slots, taken)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each document."""
    found = mix(docs)
    rows = found.documents.select("row", "doc_id", "source_key", "size", _long(0).alias("words")).union(
        found.taken.select("row", "doc_id", "source_key", "size", "words")
    )
    per_row = rows.groupBy("row", "doc_id", "source_key", "size").agg(F.sum("words").alias("taken"))
    return per_row.join(found.targets, "source_key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The documents of the mix, once for each time that it takes words of them.

    A document that the end of a target cuts stays whole, so a source's words may
    pass its target by part of one document. Rows equal in every column share the
    decision of the one taken most.
    """
    found = mix(docs, [row_hash(docs).alias("mark")])
    times = found.taken.select("row", "epoch").distinct().groupBy("row").agg(F.count("*").alias("times"))
    decided = found.documents.join(times, "row").groupBy("mark").agg(F.max("times").alias("times"))
    keyed = docs.select(row_hash(docs).alias("mark"), whole_row(docs).alias("row"))
    return (
        keyed.join(decided, "mark").select("row", F.explode(F.sequence(_long(1), F.col("times")))).select("row.*")
    )
