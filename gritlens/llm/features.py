"""Dense numbers about texts, and the labelled rows that classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.textbuf import LOWER, Texts, Words

FIT_ROWS = 20_000  # labelled rows a classifier is fitted on, about

_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
PUNCTUATION = (_BYTES > 32) & (_BYTES < 127) & ~LETTER & ~DIGIT
ODD = PUNCTUATION & ~np.isin(_BYTES, [ord(c) for c in ".,;:!?'\"()-"])
ENDS = np.isin(_BYTES, [ord(c) for c in ".!?"])


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeats(texts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """How many of each text's values equal another one of it that came up before."""
    order = np.argsort((texts.astype(np.uint64) << np.uint64(44)) | (values >> np.uint64(20)))
    t, v = texts[order], values[order]
    again = np.concatenate([[False], (t[1:] == t[:-1]) & (v[1:] == v[:-1])]) if len(t) else np.zeros(0, bool)
    return np.bincount(t[again], minlength=n)


SHAPE = [
    "log_chars", "log_words", "word_length", "capitals", "digits", "punctuation", "odd_symbols", "exclamations",
    "bars", "lines", "beyond_ascii", "sentence_words", "repeated_words", "stuttered_words", "repeated_triples",
    "odd_word_ends", "capital_words", "long_words", "odd_words",
]


def shape(texts: Texts, words: Words, hashes: np.ndarray) -> np.ndarray:
    """The columns of ``SHAPE``, one row per text; all zero for an empty one."""
    n, data = len(texts), texts.data
    size = np.diff(texts.offsets)
    count = words.per_text()
    letters = texts.counts(LETTER)
    punctuation = texts.counts(PUNCTUATION)
    per_word = lambda flags: np.bincount(words.text[flags], minlength=n)
    stutter = np.zeros(len(hashes), bool)
    stutter[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    triples, inside = np.zeros(0, np.uint64), np.zeros(0, bool)
    if len(hashes) > 2:
        with np.errstate(over="ignore"):
            triples = hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(7)
        inside = words.text[:-2] == words.text[2:]
    length = words.end - words.start
    first, last = data[words.start], data[words.end - 1]
    odd = np.concatenate([[0], np.cumsum(ODD[data])])
    has_odd = odd[words.end] > odd[words.start]
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    lower = np.concatenate([[0], np.cumsum(LETTER[data] & ~UPPER[data])])
    shouted = (upper[words.end] - upper[words.start] > 1) & (
        (lower[words.end] - lower[words.start]) * 2 < upper[words.end] - upper[words.start]
    )
    columns = [
        np.log1p(texts.characters()), np.log1p(count), share(size, count), share(texts.counts(UPPER), letters),
        share(texts.counts(DIGIT), size), share(punctuation, size), share(texts.counts(ODD), size),
        share(texts.counts(_BYTES == 33), count), share(texts.counts(_BYTES == 124), count),
        share(texts.counts(_BYTES == 10), count), share(texts.counts(_BYTES >= 128), size),
        share(count, texts.counts(ENDS) + 1), share(repeats(words.text, hashes, n), count),
        share(per_word(stutter), count),
        share(repeats(words.text[:-2][inside], triples[inside], n) if len(inside) else np.zeros(n), count),
        share(per_word(ODD[last]), count), share(per_word(shouted), count), share(per_word(length > 20), count),
        share(per_word(has_odd & ~ODD[last] & ~ODD[first]), count),
    ]
    return np.column_stack(columns).astype(np.float64)


def lowered(texts: Texts) -> Texts:
    return Texts(LOWER[texts.data], texts.offsets)


def training_rows(labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> DataFrame:
    """About ``fit_rows`` ids with a label that may be learned from: (doc_id, label, part).

    Chosen by hash, so that the same rows come up in any order and number of
    partitions. Rows whose crc32 of the id leaves 1 modulo 3 are kept out; part
    is that remainder. Null labels and ids are none; of several labels of an id
    the larger counts.
    """
    allowed = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label")
    ).withColumn("part", remainder("doc_id")).filter("part <> 1")
    many = allowed.count()
    if many > fit_rows:
        allowed = allowed.filter(F.pmod(F.xxhash64("doc_id"), F.lit(many)) < fit_rows)
    return allowed.groupBy("doc_id", "part").agg(F.max("label").alias("label"))


def remainder(key: str):
    return F.pmod(F.crc32(F.col(key).cast("bigint").cast("string").cast("binary")), F.lit(3)).cast("int")


def with_labels(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of ``training_rows``; its ids are few by their parameter, so they are broadcast."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(rows), "doc_id")
