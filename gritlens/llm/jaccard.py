"""Similarity join of documents on word shingles, by vertical partitioning.

Two documents link when the Jaccard similarity of their shingle sets reaches a
threshold. The global order of shingles (rare before frequent, then by hash) is
cut into fragments. Linked sets share a shingle within the first
``n - ceil(t n) + 1`` of each, so only those prefixes are dealt out. Each
fragment counts, for the pairs that meet in it, the part of the overlap that it
sees; the parts are summed per pair, and a pair goes on only if the sum leaves
the threshold within reach. What goes on is compared exactly.

Skew. Equal sets are one class before anything is compared. Frequent shingles
(more than ``LIST`` documents) come last in the order; the few that still reach
a prefix join no pairs, they only tie their documents to one candidate group.
A group is compared in chunks of bounded size; chunks whose documents are known
to be connected are not compared again, so a group of near copies, however large,
doesn't make its pairs. A group whose members share a passage but mostly don't link
does: its chunks meet in tiles, and the cost grows with the square of the group.

Rules for odd rows: a null or empty text, or one without words, has an empty set
and links with nothing. Rows that repeat a doc_id are rows of their own; a
component is named by its smallest doc_id. Null doc_ids take part in links but
are never a component's name unless nothing else is there.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gritlens.llm.graph import components, roots
from gritlens.llm.store import Stage, small_batches, tasks_for, whole_row
from gritlens.llm.textbuf import mix, shingles, small_slices

LIST = 32                   # a shingle of more documents than this is frequent
FREQUENT_MOST = 1 << 22     # frequent shingles that are broadcast (4 bytes each); beyond it LIST doubles
SALTS = 64                  # tasks that the documents of one group are spread over
CHUNK = 256                 # documents compared with each other in one piece
FRAGMENT_BYTES = 12 << 20   # bytes of text whose shingles are counted in one fragment
COUNT_BATCH = 2 << 20       # shingles a task counts at once


def _sets(texts, width: int):
    """(text number, hash) sorted, first place of each text, set sizes, classes."""
    text, value = shingles(texts.lower().words(), width)
    size = np.bincount(text, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(size)])
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        class_id = mix(sums[first[1:]] - sums[first[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text, value, first, size, class_id.view(np.int64)


# --- counting -------------------------------------------------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Sorted 32-bit numbers as byte planes of their differences; these compress well."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint32)


def _describe(width: int, fragments: int):
    """Rows of documents (fragment null) and of shingle counts (doc_id null)."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held))
        cut = np.searchsorted(values, (np.arange(1, fragments, dtype=np.uint64) << np.uint64(32)) // np.uint64(fragments))
        parts = [(i, p) for i, p in enumerate(np.split(values, cut)) if len(p)]
        k = len(parts)
        return pa.record_batch({
            "doc_id": pa.nulls(k, pa.int64()), "mark": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "class": pa.nulls(k, pa.int64()),
            "fragment": pa.array([i for i, _ in parts], pa.int32()),
            "counts": pa.array([_packed(p) for _, p in parts], pa.binary()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many, seen = [], 0, set()
        for batch in batches:
            for rows, texts in small_slices(batch, 1):
                text, value, first, size, class_id = _sets(texts, width)
                k = len(texts)
                yield pa.record_batch({
                    "doc_id": rows.column(0), "mark": rows.column(2), "n": pa.array(size, pa.int64()), "class": pa.array(class_id),
                    "fragment": pa.nulls(k, pa.int32()), "counts": pa.nulls(k, pa.binary()),
                })
                new = _unseen(class_id, size, seen)
                held.append((value[new[text]] >> np.uint64(32)).astype(np.uint32))
                many += len(held[-1])
                if many >= COUNT_BATCH:
                    yield counted(held)
                    held, many = [], 0
        if many:
            yield counted(held)

    return run


def _unseen(class_id: np.ndarray, size: np.ndarray, seen: set, most: int = 1 << 18) -> np.ndarray:
    """Which texts have a set that this task has not met yet (it forgets after ``most``)."""
    if len(seen) > most:
        seen.clear()
    new = np.zeros(len(class_id), bool)
    for i, (c, n) in enumerate(zip(class_id.tolist(), size.tolist())):
        if n and c not in seen:
            seen.add(c)
            new[i] = True
    return new


def _frequent(least: int):
    def run(table):
        values = np.sort(np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()]))
        edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        count = np.diff(np.append(edge, len(values)))
        many = count > least
        return pa.table({"top": values[edge[many]].astype(np.int64), "many": count[many].astype(np.int64)})

    return run


def _numbers(rows: DataFrame, kinds: list[str]) -> list[np.ndarray]:
    """Columns of numbers on the driver, in these numpy types, their rows in any order.

    They come as one value of bytes for each Arrow batch: a row each would take
    hundreds of bytes of the driver, in its Python and in its JVM.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({
                str(i): pa.array([batch.column(i).to_numpy().astype(kind).tobytes()], pa.binary()) for i, kind in enumerate(kinds)
            })

    parts = rows.mapInArrow(packed, ", ".join(f"`{i}` binary" for i in range(len(kinds)))).collect()
    return [np.frombuffer(b"".join(p[i] for p in parts), kind) for i, kind in enumerate(kinds)]


def _frequent_set(described: DataFrame, stage: Stage) -> np.ndarray:
    """The top 32 bits of frequent shingles, sorted; at most ``FREQUENT_MOST``.

    Shingles that share their top bits count together, so none is overlooked.
    """
    counts = described.filter("fragment is not null").select("fragment", "counts")
    found = stage.keep(counts.groupBy("fragment").applyInArrow(_frequent(LIST), "top bigint, many bigint"), "frequent")
    least, total = LIST, found.count()
    while total > FREQUENT_MOST:
        least *= 2
        total = found.filter(F.col("many") > least).count()
    tops = _numbers(found.filter(F.col("many") > least).select("top"), ["<u4"])[0]
    stage.drop(found)
    return np.sort(tops)


# --- prefixes and partial overlaps ----------------------------------------------------------------


def _prefixes(width: int, threshold: Fraction, frequent):
    """(token, class, n, often): the prefix of each set that a task has not met yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_tops, seen = frequent.value, set()
        for batch in batches:
            for _, texts in small_slices(batch, 0):
                text, value, first, size, class_id = _sets(texts, width)
                new = _unseen(class_id, size, seen)[text]
                text, value = text[new], value[new]
                top = (value >> np.uint64(32)).astype(np.uint32)
                place = np.searchsorted(often_tops, top)
                often = np.zeros(len(top), bool)
                if len(often_tops):
                    often = often_tops[np.minimum(place, len(often_tops) - 1)] == top
                # hash order within a text, frequent ones behind: ranks by two running counts
                start = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])) if len(text) else text
                n = size[text]
                rare_before = np.cumsum(~often) - ~often
                often_before = np.arange(len(text)) - rare_before
                runs = np.diff(np.append(start, len(text)))
                rare_in = np.add.reduceat(~often, start) if len(start) else start
                rank = np.where(
                    often,
                    np.repeat(rare_in, runs) + often_before - np.repeat(often_before[start], runs),
                    rare_before - np.repeat(rare_before[start], runs),
                )
                need = -(-(n * threshold.numerator) // threshold.denominator)
                take = rank <= n - need
                yield pa.record_batch({
                    "token": value[take].view(np.int64), "class": class_id[text[take]],
                    "n": n[take].astype(np.int32), "often": often[take],
                })

    return run


def _pairs_in(token, class_id, n, threshold: Fraction):
    """Pairs of classes that share a token, and how many they share, as (a, b, n_a, n_b, shared)."""
    order = np.lexsort((class_id, n, token))
    token, class_id, n = token[order], class_id[order], n[order]
    same = np.concatenate([[False], (token[1:] == token[:-1]) & (class_id[1:] == class_id[:-1])])
    token, class_id, n = token[~same], class_id[~same], n[~same]
    a, b = [], []
    k = 1
    left = np.arange(len(token))
    while True:  # the k-th follower in the same list, while its size is near enough
        left = left[left + k < len(token)]
        right = left + k
        near = (token[left] == token[right]) & (
            n[left].astype(np.int64) * threshold.denominator >= n[right].astype(np.int64) * threshold.numerator
        )
        left = left[near]
        if not len(left):
            break
        a.append(left)
        b.append(left + k)
        k += 1
    if not a:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    a, b = np.concatenate(a), np.concatenate(b)
    swap = class_id[a] > class_id[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    order = np.lexsort((class_id[b], class_id[a]))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate(
        [[True], (class_id[a[1:]] != class_id[a[:-1]]) | (class_id[b[1:]] != class_id[b[:-1]])]
    ))
    return class_id[a[new]], class_id[b[new]], n[a[new]], n[b[new]], np.diff(np.append(new, len(a)))


def _partial_overlaps(threshold: Fraction):
    """Over rows sorted by token: partial overlaps, some whole lists at a time."""

    def emit(parts):
        token, class_id, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        a, b, n_a, n_b, shared = _pairs_in(token, class_id, n, threshold)
        return pa.record_batch({
            "a": a, "b": b, "n_a": n_a.astype(np.int32), "n_b": n_b.astype(np.int32), "shared": shared.astype(np.int64),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            token, class_id, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(token):
                continue
            held.append((token, class_id, n))
            many += len(token)
            if many >= 1 << 19:
                token, class_id, n = (np.concatenate([p[i] for p in held]) for i in range(3))
                cut = int(np.searchsorted(token, token[-1], "left"))
                if cut:
                    yield emit([(token[:cut], class_id[:cut], n[:cut])])
                held = [(token[cut:], class_id[cut:], n[cut:])]
                many = len(token) - cut
        if many:
            yield emit(held)

    return run


# --- exact comparison -----------------------------------------------------------------------------


def overlaps(values: list[np.ndarray], block: int = 1 << 14) -> np.ndarray:
    """The sizes of all intersections of some sets."""
    m = len(values)
    size = np.array([len(v) for v in values])
    owner = np.repeat(np.arange(m), size)
    token = np.concatenate(values)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    edge = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    number = np.cumsum(edge) - 1
    count = np.bincount(number) if len(number) else number
    keep = count[number] > 1 if len(number) else edge
    number, owner = number[keep], owner[keep]
    result = np.zeros((m, m))
    if len(number):
        number = np.cumsum(np.concatenate([[True], number[1:] != number[:-1]])) - 1
        block = min(block, int(number[-1]) + 1)
        for low in range(0, int(number[-1]) + 1, block):
            i, j = np.searchsorted(number, [low, low + block])
            marks = np.zeros((m, block), np.float32)
            marks[owner[i:j], number[i:j] - low] = 1
            result += marks @ marks.T
    result[np.arange(m), np.arange(m)] = size
    return result


def linked(values: list[np.ndarray], threshold: Fraction) -> np.ndarray:
    shared = overlaps(values)
    size = np.array([len(v) for v in values])
    union = size[:, None] + size[None, :] - shared
    return shared * threshold.denominator >= union * threshold.numerator


def _runs_of(batches: Iterator[pa.RecordBatch], keys: int):
    """Consecutive rows with equal values in the first ``keys`` columns, as lists of rows' columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        edge = np.zeros(batch.num_rows, bool)
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        if last is not None and first != last:
            yield last, pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(edge), batch.num_rows]
        for i, j in zip(starts[:-1], starts[1:]):
            if i and held:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(c[i] for c in columns)
    if held:
        yield last, pa.Table.from_batches(held)


def _values(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _compare_chunks(threshold: Fraction):
    """(group, chunk, class, label, side, shingles) sorted: links as stars, within each chunk.

    Documents with equal labels are known to be connected. With two sides, only
    pairs across them are new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, many = [], [], 0
        for _, rows in _runs_of(batches, 2):
            class_id, place = np.unique(rows.column("class").to_numpy(), return_index=True)
            if len(class_id) < 2:
                continue
            label = rows.column("label").to_numpy()[place]
            values = _values(rows.column("shingles").take(pa.array(place)))
            a, b = np.nonzero(np.triu(linked(values, threshold), 1) & (label[:, None] != label[None, :]))
            if not len(a):
                continue
            root = roots(a, b, len(class_id))
            other = np.flatnonzero(root != np.arange(len(root)))
            out_a.append(class_id[other])
            out_b.append(class_id[root[other]])
            many += len(other)
            if many > 10_000:
                yield pa.record_batch({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})
                out_a, out_b, many = [], [], 0
        if many:
            yield pa.record_batch({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})

    return run


def _sets_of(width: int, wanted):
    """(class, shingles) of the documents whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(in_filter(bits, ids)))
            for _, texts in small_slices(batch, 1):
                text, value, first, size, class_id = _sets(texts, width)
                some = np.flatnonzero(size)
                blobs = [value[first[i] : first[i + 1]].tobytes() for i in some]
                yield pa.record_batch({"class": class_id[some], "shingles": pa.array(blobs, pa.binary())})

    return run


FILTER_BITS = 1 << 27  # 16 MB at most; more wanted ids than that only let more documents through


def _filter_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix(ids.astype(np.int64).view(np.uint64))
    y = mix(x ^ np.uint64(0x94D049BB133111EB))
    return [(x % np.uint64(bits)).astype(np.int64), (y % np.uint64(bits)).astype(np.int64)]


def in_filter(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), bool)
    for place in _filter_places(ids, len(words) * 64):
        found &= (words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def _filter_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in _filter_places(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), bits):
                yield pa.record_batch({"word": place >> 6, "mask": np.int64(1) << (place & 63)})

    return run


def membership_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of ids: of bounded size, and never wrong about a member."""
    many = ids.count()
    bits = 1 << 16
    while bits < FILTER_BITS and bits < many * 16:
        bits *= 2
    words = np.zeros(bits // 64, np.uint64)
    found = ids.mapInArrow(_filter_words(bits), "word bigint, mask bigint").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    place, mask = _numbers(found, ["<u4", "<u8"])  # at most FILTER_BITS / 64 rows
    words[place] = mask
    return words


def _with_group(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (class, group, ...) with their group's row of ``facts``; a large group is spread by class."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.lit(SALTS)).cast("int"))
    return salted.join(facts.withColumn("salt", salts), ["group", "salt"]).drop("salt")


def _compare(members: DataFrame, docs: DataFrame, described: DataFrame, width: int, threshold: Fraction, stage: Stage):
    """Links among the classes of each candidate group, as enough edges to connect what is connected."""
    spark = docs.sparkSession
    one = described.join(members.select("class"), "class", "left_semi")
    ids = stage.keep(one.groupBy("class").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "ids")  # read twice
    wanted = spark.sparkContext.broadcast(membership_filter(ids))
    stage.drop(ids)
    sets = docs.mapInArrow(_sets_of(width, wanted), "class bigint, shingles binary")
    rows = sets.join(members, "class").groupBy("class", "group", "size").agg(F.first("shingles").alias("shingles"))
    # a class in many documents has one set; the first of equal ones is any of them
    rows = stage.keep(rows, "sets")

    def chunked(rows: DataFrame, label) -> DataFrame:
        pieces = F.ceil(F.col("size") / F.lit(CHUNK / 2)).cast("bigint")
        chunk = F.when(F.col("size") <= CHUNK, F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64("class"), pieces))
        return rows.select("group", chunk.alias("chunk"), "class", label.alias("label"), "shingles")

    def compared(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition(tasks_for(docs), "group", "chunk").sortWithinPartitions("group", "chunk")
        return dealt.mapInArrow(_compare_chunks(threshold), "a bigint, b bigint")

    links = stage.keep(compared(chunked(rows, F.col("class"))), "links")
    large = rows.filter(F.col("size") > CHUNK)
    left = large.groupBy("group").agg(F.count("*").alias("size"))
    if left.isEmpty():
        stage.drop(rows)
        return links
    # Groups of many chunks: one document for each part found so far, until these fit a chunk or no longer join.
    before = None
    while True:
        named = components(links, stage)
        labelled = large.join(named, large["class"] == named["node"], "left").select(
            "group", "size", "class", F.coalesce("component", "class").alias("label"), "shingles"
        )
        parts = labelled.filter(F.col("class") == F.col("label")).drop("size")
        sizes = parts.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
        total = sizes.agg(F.sum("size"), F.max("size")).first()
        if not total[0] or total[0] == before:
            break
        before = total[0]
        more = stage.keep(compared(chunked(_with_group(parts, sizes), F.col("label"))), "part-links")
        links = stage.keep(links.union(more), "links")
        if total[1] <= CHUNK:
            break
    # What is still apart from the largest part of its group is compared with the whole group.
    named = components(links, stage)
    labelled = large.join(named, large["class"] == named["node"], "left").select(
        "group", "size", "class", F.coalesce("component", "class").alias("label"), "shingles"
    )
    part_sizes = labelled.groupBy("group", "label").agg(F.count("*").alias("many"))
    largest = part_sizes.groupBy("group").agg(F.max_by("label", F.struct("many", "label")).alias("main"), F.count("*").alias("parts"))
    state = _with_group(labelled, largest.filter("parts > 1"))
    rest = state.filter("label <> main")
    rest_sizes = rest.groupBy("group").agg(F.count("*").alias("rest"))
    half = CHUNK // 2
    dealt = _with_group(state, rest_sizes).select(
        "group", "class", "label", "shingles", (F.col("label") != F.col("main")).alias("apart"),
        F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / half).cast("bigint")).alias("row"),
        F.pmod(F.xxhash64("class"), F.ceil(F.col("rest") / half).cast("bigint")).alias("col"),
        F.ceil(F.col("size") / half).cast("bigint").alias("rows"), F.ceil(F.col("rest") / half).cast("bigint").alias("cols"),
    )
    across = dealt.select("group", "class", "label", "shingles", "rows", "row", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("cols") - 1)).alias("col"))
    down = dealt.filter("apart").select("group", "class", "label", "shingles", "rows", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)).alias("row"), "col")
    tiles = across.select("group", (F.col("col") * F.col("rows") + F.col("row")).alias("chunk"), "class", "label", "shingles").union(
        down.select("group", (F.col("col") * F.col("rows") + F.col("row")).alias("chunk"), "class", "label", "shingles")
    )
    links = links.union(stage.keep(compared(tiles), "rest-links"))
    stage.drop(rows)
    return links


DESCRIBED = "doc_id bigint, mark bigint, n bigint, class bigint, fragment int, counts binary"


def _mark() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _labelled(docs: DataFrame, width: int, threshold: str) -> DataFrame:
    """(doc_id, mark, n_shingles, label) for each row: equal labels for what is connected."""
    share = Fraction(threshold)
    spark = docs.sparkSession
    stage = Stage(spark, "jaccard")
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    fragments = max(8, -(-size // FRAGMENT_BYTES))
    described = stage.keep(
        docs.select("doc_id", "text", _mark()).mapInArrow(_describe(width, fragments), DESCRIBED), "described"
    )
    frequent = spark.sparkContext.broadcast(_frequent_set(described, stage))
    counted = described  # most of it is counts, which nothing reads any more
    described = stage.keep(counted.filter("fragment is null").select("doc_id", "mark", "n", "class"), "rows")
    stage.drop(counted)
    prefixes = docs.select("text").mapInArrow(
        _prefixes(width, share, frequent), "token bigint, class bigint, n int, often boolean"
    )
    # one reading gives both kinds of rows; frequent ones are few and tie a document to a group
    tasks = max(tasks_for(docs), fragments // 4)
    dealt = prefixes.repartition(tasks, F.when(F.col("often"), F.xxhash64("token", "class")).otherwise(F.col("token")))
    parts = dealt.sortWithinPartitions("often", "token").mapInArrow(
        _split_often(_partial_overlaps(share)), "a bigint, b bigint, n_a int, n_b int, shared bigint"
    )
    pairs = parts.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))
    beyond = F.greatest(*[F.ceil(F.col(n) * share.numerator / share.denominator) - 1 for n in ("n_a", "n_b")])
    reach = (F.col("shared") + beyond) * (share.numerator + share.denominator) >= share.numerator * (F.col("n_a") + F.col("n_b"))
    candidates = stage.keep(pairs.filter(F.col("n_a").isNull() | reach).select("a", "b"), "candidates")
    named = components(candidates, stage)
    classes = described.filter("n > 0").select("class")
    grouped = classes.join(named, classes["class"] == named["node"]).select("class", F.col("component").alias("group"))
    grouped = stage.keep(grouped.distinct(), "grouped")
    stage.drop(candidates)
    several = grouped.groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    members = stage.keep(_with_group(grouped, several), "members")
    links = _compare(members, docs, described, width, share, stage)
    found = components(links, stage)
    return described.join(found, described["class"] == found["node"], "left").select(
        "doc_id", "mark", F.col("n").alias("n_shingles"), F.coalesce("component", "class").alias("label")
    )


def similarity_groups(docs: DataFrame, width: int = 5, threshold: str = "0.75") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text)."""
    labelled = _labelled(docs, width, threshold)
    names = labelled.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("name"))
    return labelled.join(names, "label", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each_group(docs: DataFrame, width: int = 5, threshold: str = "0.75") -> DataFrame:
    """The document with the smallest doc_id of each group, and every one without words."""
    labelled = _labelled(docs, width, threshold)
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    kept = labelled.filter("n_shingles > 0").groupBy("label").agg(first).select("first.*", F.lit(True).alias("words")).union(
        labelled.filter("n_shingles = 0").select("doc_id", "mark", F.lit(False)).distinct()
    )
    def named(doc_id: Column, mark: Column) -> list[Column]:
        # no null is left, so the join and the window below are dealt alike and documents are shuffled once
        return [F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("id"), doc_id.isNull().alias("nameless"), mark.alias("own")]

    key = ["id", "nameless", "own"]
    keyed = docs.select(*named(F.col("doc_id").cast("bigint"), _mark()), whole_row(docs).alias("row"))
    kept = kept.select(*named(F.col("doc_id"), F.col("mark")), "words")
    # equal rows of one document stay once
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("own"))
    found = keyed.join(kept, key).withColumn("turn", F.when(F.col("words"), turn).otherwise(1)).filter("turn = 1")
    return found.select("row.*")


def _split_often(partial):
    """Rare rows (first) go to ``partial``; a frequent shingle becomes a node that its classes tie to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ties: list[pa.RecordBatch] = []

        def rare():
            for batch in batches:
                often = batch.column("often").to_numpy(zero_copy_only=False)
                if often.any():
                    ties.append(batch.filter(batch.column("often")))
                    batch = batch.filter(pa.array(~often))
                yield batch.select(["token", "class", "n"])

        for found in partial(rare()):
            yield found
            while ties:
                yield tie(ties.pop())
        while ties:
            yield tie(ties.pop())

    def tie(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.num_rows
        # the node of a shingle: its hash, mixed so that it is no class; sizes are null
        node = mix(batch.column("token").to_numpy().view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        return pa.record_batch({
            "a": batch.column("class"), "b": pa.array(node), "n_a": pa.nulls(k, pa.int32()),
            "n_b": pa.nulls(k, pa.int32()), "shared": pa.array(np.zeros(k, np.int64)),
        })

    return run
