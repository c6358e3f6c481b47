"""Words of a batch of texts, worked out over one byte buffer with numpy.

A batch of UTF-8 texts is one buffer and its offsets, as Arrow keeps it. Words
are runs of bytes outside space and 0x09-0x0D; no code point but those six has
such a byte, so byte runs are exactly the runs of characters. Hashes are 64 bit:
the polynomial of a random value per byte, mixed at the end.
"""

from __future__ import annotations

import sys
import types
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x2545F4914F6CDD1D
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> np.ndarray:
    """``_STEP`` to the powers 0 to n - 1, kept between calls."""
    global _POWERS
    while len(_POWERS) < n:
        with np.errstate(over="ignore"):
            last = np.uint64(pow(_STEP, len(_POWERS), 1 << 64))
            _POWERS = np.concatenate([_POWERS, _POWERS * last])
    return _POWERS


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """A 64-bit hash of each run data[start:end]; runs are disjoint and in order.

    Worked out for about ``block`` bytes at a time (or one longer run), so memory
    does not grow with the batch.
    """
    found = np.zeros(len(start), np.uint64)
    total = np.concatenate([[0], np.cumsum(end - start)])
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + block, "right")) - 1)
        found[at:stop] = _run_hashes(data, start[at:stop], end[at:stop])
        at = stop
    return found


def _run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - start
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    inside = np.arange(int(length.sum())) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        values = _BYTE_VALUES[data[inside + np.repeat(start, length)]]
        values *= _powers(int(length.max()))[inside]
        return mix(np.add.reduceat(values, first) + length.astype(np.uint64) * _ROOT)


@dataclass
class Texts:
    """A batch: bytes, and where each text starts and ends. Null is empty."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> "Texts":
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        if not n:
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, places, data = column.buffers()
        offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        found = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
        return cls(found, offsets - low)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> "Texts":
        """A-Z in lower case."""
        return Texts(LOWER[self.data], self.offsets)

    def mapped(self, table: np.ndarray, keep: np.ndarray) -> "Texts":
        """Each byte by ``table``, without the bytes that ``keep`` (by byte) leaves out."""
        kept = keep[self.data]
        places = np.concatenate([[0], np.cumsum(kept)])
        return Texts(table[self.data[kept]], places[self.offsets])

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text have their flag (by byte value) set."""
        return self.sums(flags[self.data])

    def sums(self, per_byte: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def characters(self) -> np.ndarray:
        """Code points of each text."""
        return self.sums((self.data & 0xC0) != 0x80)

    def words(self) -> "Words":
        inside = ~IS_WHITE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)  # a run ends where a text ends
        edge[self.offsets] = True
        before = np.concatenate([[False], inside])
        after = np.concatenate([inside, [False]])
        start = np.flatnonzero(after & (~before | edge))
        end = np.flatnonzero(before & (~after | edge))
        text = np.searchsorted(self.offsets, start, "right") - 1
        return Words(self, start, end, text)


@dataclass
class Words:
    """Words in order: their byte ranges and the number of their text."""

    texts: Texts
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray

    def hashes(self) -> np.ndarray:
        return run_hashes(self.texts.data, self.start, self.end)

    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=len(self.texts))


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct word sequences of each text, sorted.

    A text with fewer words than ``width`` has its whole sequence as one.
    """
    hashes, count = words.hashes(), words.per_text()
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    short = np.flatnonzero((count > 0) & (count < width))
    with np.errstate(over="ignore"):
        factors = [np.uint64(pow(_STEP, 3 + k, 1 << 64)) for k in range(width)]
        whole = max(0, len(hashes) - width + 1)
        total = np.full(whole, np.uint64(width) * _ROOT)
        for k in range(width):
            total += hashes[k : k + whole] * factors[k]
        inside = words.text[:whole] == words.text[width - 1 :]
        texts = [words.text[:whole][inside]]
        found = [mix(total[inside])]
        if len(short):
            size = count[short]
            total = size.astype(np.uint64) * _ROOT
            for k in range(width - 1):
                has = size > k
                total[has] += hashes[first[short[has]] + k] * factors[k]
            texts.append(short)
            found.append(mix(total))
    text, value = np.concatenate(texts), np.concatenate(found)
    # one key of the text's number and the hash's top bits sorts faster than two keys
    order = np.argsort((text.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    text, value = text[order], value[order]
    if len(text):
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])])
        text, value = text[new], value[new]
    return text, value


def small_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 18):
    """The batch in slices of about ``most`` bytes of text each (or one longer text)."""
    texts = Texts.of(batch.column(column))
    at, n = 0, len(texts)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(texts.offsets, texts.offsets[at] + most, "right")) - 1)
        stop = min(stop, n)
        low = texts.offsets[at]
        yield batch.slice(at, stop - at), Texts(
            texts.data[low : texts.offsets[stop]], texts.offsets[at : stop + 1] - low
        )
        at = stop


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as ``Words.hashes`` gives them."""
    texts = Texts.of(pa.array(words, pa.string()))
    return run_hashes(texts.data, texts.offsets[:-1], texts.offsets[1:])


def per_process(name: str, make):
    """A value kept by a Python worker between its tasks."""
    kept = sys.modules.setdefault("gritlens_worker", types.ModuleType("gritlens_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
