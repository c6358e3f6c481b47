"""Best-fit packing of tokenized documents into sequences, with certified partitions.

Documents become token ids plus an end id and are cut into pieces no longer than a
sequence. Pieces are dealt to partitions of bounded size; each is packed by
best-fit decreasing and gets a lower bound on its number of sequences from
dual-feasible functions. A partition at its bound is certified: no packing of its
pieces is better. Partitions with a gap, and the loosest sequence of every other,
give the documents of their loosest sequences into the next round, where they are
dealt anew and packed again, until they fit one partition or the sum of all gaps no
longer falls. Each piece tells the number of sequences that its partition was
packed into and the partition's bound: where they are equal, it is certified.

Only lengths and names travel; ids stay where they are made.

Rules for odd rows: a null or empty text is the end id alone. Rows that repeat a
doc_id are packed separately, each with its own pieces. An empty table gives no
rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.store import Stage, small_batches
from gritlens.llm.textbuf import IS_WHITE, WHITE, Texts, per_process, run_hashes, small_slices

GROUP = 40_000          # pieces packed in one task
CACHE = 400_000         # words whose ids a worker remembers
JOINED = 2_000          # new words that are encoded at once
SLICE_BYTES = 1 << 20


# The pattern that cuts text into words before byte-level merges.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds:
    """Token ids of stretches of text, remembered by hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = sorted({t.content for t in added.values() if t.content})  # their strings in a text are one id
        special = {i for i, t in added.items() if t.special}
        byte_of = {c: b for b, c in _byte_characters().items()}
        tokens = {
            bytes(byte_of[c] for c in self.tokenizer.id_to_token(i)): i for i in range(n) if i not in special
        }
        self.token_bytes = np.zeros(n, np.int64)
        for token, i in tokens.items():
            self.token_bytes[i] = len(token)
        # The same vocabulary as merge ranks: seven times faster on words not met before.
        self.merges = tiktoken.Encoding("words", pat_str=WORD_PATTERN, mergeable_ranks=tokens, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted; a fifth of what a dict of them takes
        self.place = np.zeros(0, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.first = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = self.many = 0

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        """Which of some hashes are not remembered."""
        if not len(self.known):
            return np.ones(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def remember(self, hashes: np.ndarray) -> None:
        """``hashes`` are those of the last stretches kept, in order."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.place = np.insert(self.known, at, hashes[order]), np.insert(self.place, at, len(self.place) + order)

    def add(self, texts: list[bytes]) -> None:
        """Encode new stretches, many in one text: each begins a token, so ids divide at their bytes."""
        for at in range(0, len(texts), JOINED):
            some = texts[at : at + JOINED]
            ids = np.array(self.merges.encode_ordinary(b"".join(some).decode()), np.uint32)
            ends = np.cumsum(self.token_bytes[ids])
            cut = np.searchsorted(ends, np.cumsum([len(x) for x in some]), "left") + 1
            self.keep(ids, np.diff(cut, prepend=0))

    def keep(self, flat: np.ndarray, length: np.ndarray) -> None:
        n, m = self.many, len(length)
        while n + m > len(self.length):
            self.length, self.first = np.resize(self.length, 2 * len(self.length)), np.resize(self.first, 2 * len(self.first))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.length[n : n + m] = length
        self.first[n : n + m] = self.used + np.cumsum(length) - length
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.many += m

    def of(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        data = texts.data
        white = IS_WHITE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = white[1:] & ~white[:-1]  # no token reaches over the start of white space
        cut[texts.offsets] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        hashes, first, inverse = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
        if self.many > CACHE:
            self.clear()
        new = np.flatnonzero(self.missing(hashes))
        if len(new):
            raw = data.tobytes()
            found = [raw[a:b] for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())]
            # the start of a text has no white space before it, its end may have some behind
            whole = np.array([x[0] in WHITE and x[-1] not in WHITE for x in found])
            self.add([x for x, w in zip(found, whole) if w])
            for x, w in zip(found, whole):
                if not w:
                    ids = self.encode(x.decode())
                    self.keep(ids, np.array([len(ids)]))
            self.remember(np.concatenate([hashes[new[whole]], hashes[new[~whole]]]))
        place = self.place[np.searchsorted(self.known, hashes)][inverse]
        length = self.length[place]
        total = np.cumsum(length)
        inside = np.arange(int(total[-1])) - np.repeat(total - length, length)
        ids = self.flat[np.repeat(self.first[place], length) + inside]
        per_text = np.concatenate([[0], total])[np.searchsorted(start, texts.offsets)]
        return ids, np.diff(per_text)


#: White space beyond ASCII, and the four separators that engines class apart: such texts are encoded whole.
_RARE_SPACE = pa.scalar("[\x1c-\x1f\u0085   -     　]")


def _ids_of_texts(words: WordIds, column: pa.Array, texts: Texts) -> Iterator[np.ndarray]:
    import pyarrow.compute as pc

    ids, many = words.of(texts)
    at = np.concatenate([[0], np.cumsum(many)])
    whole = pc.match_substring_regex(column.fill_null(""), _RARE_SPACE.as_py()).to_numpy(zero_copy_only=False)
    for token in words.added:
        whole = whole | pc.match_substring(column.fill_null(""), token).to_numpy(zero_copy_only=False)
    for i in range(len(texts)):
        if whole[i]:
            yield words.encode(column[i].as_py())
        else:
            yield ids[at[i] : at[i + 1]]


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(f"words:{path}", lambda: WordIds(path))
        closing = np.array([end_id], np.uint32)
        for batch in batches:
            for rows, texts in small_slices(batch, 1, SLICE_BYTES):
                row, piece, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(_ids_of_texts(words, rows.column(1), texts)):
                    ids = np.concatenate([ids, closing]).astype("<u4")
                    head = len(ids) % capacity or capacity
                    places = [0, *range(head, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(places[:-1], places[1:])):
                        row.append(i), piece.append(k), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[a:b].tobytes()))
                yield pa.record_batch({
                    "doc_id": rows.column(0).take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                })

    return run


def public_vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's pieces; only the first of a long document may be short."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_pieces(tokenizer, capacity, end_id), PIECE)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The largest bound of two families of dual-feasible functions."""
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass = np.concatenate([[0], np.cumsum(count * x)])
    many = np.concatenate([[0], np.cumsum(count)])
    least = np.arange(capacity // 2 + 1)
    # sizes under the least count nothing, those that leave less room than it count a whole sequence
    middle = mass[capacity - least + 1] - mass[least]
    large = many[-1] - many[capacity - least + 1]
    best = int(np.max(large - (-middle // capacity)))
    for k in range(1, 21):  # sizes rounded to k-ths, whole multiples of a (k + 1)-th kept
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: (sequence, offset) of each size, and the number of sequences."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0  # bit r of rooms: some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = open_by_room[room]
            s = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, s = capacity, used
            used += 1
        sequence[i], offset[i] = s, capacity - room
        left = room - size
        if left:
            if not open_by_room[left]:
                rooms |= 1 << left
            open_by_room[left].append(s)
    return sequence, offset, used


def _pack(capacity: int):
    def run(table):
        sizes = table.column("length").to_numpy()
        sequence, offset, used = best_fit(sizes, capacity)
        gap = used - lower_bound(sizes, capacity)
        fill = np.bincount(sequence, weights=sizes, minlength=used)
        given = np.zeros(used, bool)
        # the loosest sequences: one at the bound, more with a gap
        loose = np.argsort(fill, kind="stable")[: 1 + 4 * gap]
        given[loose[fill[loose] < capacity]] = True
        return (
            table.append_column("number", pa.array(sequence))
            .append_column("offset", pa.array(offset))
            .append_column("open", pa.array(given[sequence]))
            .append_column("gap", pa.array(np.full(len(sizes), gap), pa.int64()))
            .append_column("used", pa.array(np.full(len(sizes), used), pa.int64()))
        )

    return run


def packed(all_pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id``, ``offset``, ``partition_sequences`` and ``partition_bound`` to pieces.

    The last two are those of the partition and round in which the piece was
    packed for good; a piece as long as a sequence is a partition of its own.
    """
    spark = all_pieces.sparkSession
    stage = Stage(spark, "packing")
    rows = stage.keep(all_pieces, "pieces")
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    one = F.lit(1).cast("bigint")
    full = rows.filter(F.col("length") >= capacity).select(
        *all_pieces.columns, (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"),
        one.alias("partition_sequences"), one.alias("partition_bound"),
    )
    schema = f"{PIECE}, _row bigint, group bigint, number bigint, offset bigint, open boolean, gap bigint, used bigint"
    left = rows.filter(F.col("length") < capacity)
    done, turn, gaps = full, 0, None
    while True:
        many = left.count()
        if not many:
            break
        groups = -(-many // group)
        dealt = left.withColumn("group", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(groups)))
        now = stage.keep(dealt.groupBy("group").applyInArrow(_pack(capacity), schema), f"round-{turn}")
        before, gaps = gaps, now.groupBy("group").agg(F.first("gap").alias("gap")).agg(F.sum("gap")).first()[0]
        named = now.withColumn(
            "sequence_id", F.lit((turn + 1) << 48) + F.shiftleft("group", 20) + F.col("number")
        )
        again = groups > 1 and (before is None or gaps < before)
        closed = named.filter(~F.col("open")) if again else named
        done = done.unionByName(closed.select(
            *all_pieces.columns, "sequence_id", "offset",
            F.col("used").alias("partition_sequences"), (F.col("used") - F.col("gap")).alias("partition_bound"),
        ))
        if not again:
            break
        left = now.filter("open").select(*all_pieces.columns, "_row")
        turn += 1
    return done


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return packed(pieces(docs, tokenizer, capacity, end_id), capacity)
