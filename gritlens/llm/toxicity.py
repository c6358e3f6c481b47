"""Toxicity: boosted trees over dense features, calibrated by isotonic regression.

The features: densities of a lexicon, nearness of its words to a word for "you",
capitals, punctuation, and rates of disguised spellings. The lexicon (words and
word beginnings) is learned with the trees from a bounded sample of labelled rows;
the isotonic curve from a part of it that the trees haven't seen. Spark's own
trees and isotonic regression do both. Every text is then scored whole.

Rules for odd rows: a null or empty text gets the score of all-zero features. Rows
that repeat a doc_id are scored each. Without labels of both kinds nothing can be
learned and every score is the mean label, or 0. A null doc_id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritlens.llm.features import DIGIT, FIT_ROWS, LETTER, SHAPE, remainder, shape, share, training_rows, with_labels
from gritlens.llm.store import Stage, small_batches
from gritlens.llm.textbuf import IS_WHITE, LOWER, Texts, Words, mix, run_hashes, small_slices, word_hashes

LEXICON = 512        # entries at most
BEGINNINGS = (4, 6)  # bytes of word beginnings that may be entries
TREES, DEPTH = 24, 4

# Words for the person spoken to.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi",
    "ton", "vous", "votre", "vos", "ti", "tus", "usted", "ustedes", "vosotros",
]
# Digits and signs that stand for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a"}

_PLAIN = LOWER.copy()
for _sign, _letter in STANDS_FOR.items():
    _PLAIN[ord(_sign)] = ord(_letter)
_KEPT = LETTER | IS_WHITE | np.isin(np.arange(256), [ord(c) for c in STANDS_FOR])


def plain_words(texts: Texts) -> Words:
    """Words as a reader takes them: lower case, no punctuation, disguises undone."""
    return texts.mapped(_PLAIN, _KEPT).words()


def _entries(words: Words) -> list[np.ndarray]:
    """For each word the hashes it may have in the lexicon: itself and its beginnings (0: none)."""
    found = [words.hashes()]
    for length in BEGINNINGS:
        long_ = words.end - words.start >= length
        value = np.zeros(len(long_), np.uint64)
        starts = words.start[long_]
        value[long_] = mix(run_hashes(words.texts.data, starts, starts + length) ^ np.uint64(length))
        found.append(value)
    return found


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, label) once for each labelled text that has it."""
    for batch in batches:
        for rows, texts in small_slices(batch, 1):
            words = plain_words(texts)
            label = rows.column(2).to_numpy(zero_copy_only=False)
            for value in _entries(words):
                text, value = words.text[value != 0], value[value != 0]
                order = np.lexsort((value, text))
                text, value = text[order], value[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
                yield pa.record_batch({"entry": value[new].view(np.int64), "label": label[text[new]]})


def learn_lexicon(labelled: DataFrame, most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """(entries sorted, weights): what marks the labelled texts by its log odds."""
    total = labelled.agg(F.sum("label"), F.count("*")).first()
    bad, all_ = total[0] or 0.0, total[1] or 0
    counts = labelled.select("doc_id", "text", "label").mapInArrow(_lexicon_counts, "entry bigint, label double")
    seen = counts.groupBy("entry").agg(F.sum("label").alias("bad"), F.count("*").alias("n")).filter("bad >= 4")
    odds = F.log((F.col("bad") + 0.1) / (bad + 0.2)) - F.log((F.col("n") - F.col("bad") + 0.1) / (all_ - bad + 0.2))
    top = (
        seen.withColumn("weight", odds).filter("weight > 2")
        .orderBy(F.desc(F.col("weight") * F.sqrt("bad")), "entry").limit(most).collect()
    )
    entries = np.array([r["entry"] for r in top], np.int64).view(np.uint64)
    weights = np.array([r["weight"] for r in top], np.float64)
    order = np.argsort(entries)
    return entries[order], weights[order]


def _weights(values: list[np.ndarray], entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The largest weight among the entries of each word; 0 without one."""
    best = np.zeros(len(values[0]))
    if len(entries):
        for value in values:
            place = np.minimum(np.searchsorted(entries, value), len(entries) - 1)
            best = np.maximum(best, np.where((entries[place] == value) & (value != 0), weights[place], 0))
    return best


NAMES = ["hits", "hit_share", "weight_share", "strongest", "near_you", "you_share", "disguised", "capitals",
         "punctuation", "odd_symbols", "exclamations", "capital_words", "odd_words", "log_words", "repeated_words",
         "digits"]


def features(texts: Texts, entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The columns of ``NAMES``, one row per text."""
    n = len(texts)
    words = plain_words(texts)
    values = _entries(words)
    count = words.per_text()
    weight = _weights(values, entries, weights)
    hit = weight > 0
    strongest = np.zeros(n)
    np.maximum.at(strongest, words.text[hit], weight[hit])
    spoken = np.isin(values[0], word_hashes(SECOND_PERSON))
    # the distance in words from each hit to the nearest such word of the same text
    at, to = np.flatnonzero(hit), np.flatnonzero(spoken)
    near = np.zeros(len(at))
    if len(to):
        place = np.searchsorted(to, at)
        for other in (to[np.minimum(place, len(to) - 1)], to[np.maximum(place - 1, 0)]):
            same = words.text[other] == words.text[at]
            near = np.maximum(near, np.where(same, 1 / (1 + np.abs(other - at)), 0))
    nearest = np.zeros(n)
    np.maximum.at(nearest, words.text[at], near)
    raw = texts.words()
    raw_shape = shape(texts, raw, raw.hashes())
    # disguised: a digit or sign that stands for a letter, with letters on both sides
    data = texts.data
    stands = DIGIT[data] | (data == 64)
    inner = np.zeros(len(data), bool)
    if len(data) > 2:
        inner[1:-1] = stands[1:-1] & LETTER[data[:-2]] & LETTER[data[2:]]
    column = dict(zip(SHAPE, raw_shape.T))
    return np.column_stack([
        np.bincount(words.text[hit], minlength=n), share(np.bincount(words.text[hit], minlength=n), count),
        share(np.bincount(words.text, weights=weight, minlength=n), count), strongest, nearest,
        share(np.bincount(words.text[spoken], minlength=n), count), share(texts.sums(inner), count),
        column["capitals"], column["punctuation"], column["odd_symbols"], column["exclamations"],
        column["capital_words"], column["odd_words"], column["log_words"], column["repeated_words"], column["digits"],
    ]).astype(np.float64)




def _with_features(entries: np.ndarray, weights: np.ndarray, others: int, text: bool = False):
    """Puts features behind columns 0 and 1 (the text), or in the text's place, and keeps the ``others`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in small_slices(batch, 1):
                flat = features(texts, entries, weights)
                found = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, flat.size + 1, flat.shape[1]), pa.int32()), pa.array(flat.ravel())
                )
                first = 2 if text else 1
                yield pa.record_batch(
                    [*rows.columns[:first], found, *rows.columns[2 : 2 + others]],
                    names=[*rows.schema.names[:first], "features", *rows.schema.names[2 : 2 + others]],
                )

    return run


class Model:
    """A lexicon, trees and a curve; ``score`` adds the column ``score``."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS):
        stage = Stage(docs.sparkSession, "toxicity")
        small_batches(docs.sparkSession)
        rows = training_rows(labels, label, fit_rows)
        labelled = stage.keep(with_labels(docs, rows), "labelled")
        self.entries, self.weights = learn_lexicon(labelled.filter("part = 0"))
        seen = stage.keep(
            labelled.select("doc_id", "text", "label", "part").mapInArrow(
                _with_features(self.entries, self.weights, 2),
                "doc_id bigint, features array<double>, label double, part int",
            ).withColumn("features", array_to_vector("features")).repartition(4, "doc_id").sortWithinPartitions("doc_id"),
            "features",
        )
        fit, check = seen.filter("part = 0"), seen.filter("part = 2")
        kinds = fit.agg(F.countDistinct("label"), F.avg("label")).first()
        self.trees = self.curve = None
        self.mean = kinds[1] or 0.0
        if kinds[0] == 2:
            self.trees = GBTClassifier(
                maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=1, maxBins=64,
            ).fit(fit)
            raw = self._raw(check).groupBy("raw").agg(F.avg("label").alias("label"), F.count("*").cast("double").alias("weight"))
            if raw.head(1):
                self.curve = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)

    def _raw(self, rows: DataFrame) -> DataFrame:
        """Adds the trees' probability in steps of 1/1000, so that the curve has few points."""
        found = self.trees.transform(rows)
        return found.withColumn("raw", F.round(vector_to_array("probability")[1], 3)).drop(
            "rawPrediction", "probability", "prediction"
        )

    def score(self, docs: DataFrame, text: bool = False) -> DataFrame:
        """(doc_id, score, and the other columns, the text only if asked for) for each row."""
        others = [c for c in docs.columns if c not in ("doc_id", "text")]
        rows = docs.select("doc_id", "text", *others)
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        if self.trees is None:
            return (rows if text else rows.drop("text")).withColumn("score", F.lit(float(self.mean)))
        kept = ["doc_id", "text"] if text else ["doc_id"]
        schema = ", ".join(
            [*[f"`{c}` {kinds[c]}" for c in kept], "features array<double>", *[f"`{c}` {kinds[c]}" for c in others]]
        )
        found = rows.mapInArrow(_with_features(self.entries, self.weights, len(others), text), schema)
        found = self._raw(found.withColumn("features", array_to_vector("features")))
        if self.curve is not None:
            found = self.curve.transform(found).withColumn("score", F.col("prediction")).drop("prediction")
        else:
            found = found.withColumn("score", F.col("raw"))
        return found.select(*kept, *others, F.least(F.greatest("score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each document."""
    model = Model(docs, labels, fit_rows=fit_rows)
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return model.score(keyed).select(
        "doc_id", F.coalesce(remainder("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents whose score is under the threshold, with all their columns."""
    model = Model(docs, labels, fit_rows=fit_rows)
    # a text goes to Python and back once: the row beside it is without it
    columns = [F.col(f"`{c}`") if c != "text" else F.lit(0).alias("text") for c in docs.columns]
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.struct(*columns).alias("_row"))
    kept = model.score(keyed, text=True).filter(F.col("score") < threshold)
    return kept.select(F.col("_row").withField("text", F.col("text")).alias("_row")).select("_row.*")
