"""Held-out accuracy of both classifiers, and what they do with odd rows."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gritlens.llm import features, quality, toxicity
from gritlens.llm.textbuf import Texts


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def accuracy(found, labels, name):
    truth = {r["doc_id"]: r[name] for r in labels.collect()}
    rows = [(r, truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(rows) > 80
    return np.mean([r["predicted"] == y for r, y in rows]), [r["score"] for r, y in rows if y], [r["score"] for r, y in rows if not y]


def test_quality(more_documents, labels):
    found = quality.quality_scores(more_documents, labels).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    share, good, bad = accuracy(found, labels, "quality")
    assert share > 0.95 and np.mean(good) > np.mean(bad) + 0.5


@pytest.fixture(scope="module")
def more_toxic(spark):
    """Documents of many words, some with slurs, for enough labels to learn from."""
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "ba co di fu ge".split() for b in "ra to mi lu sen".split()]
    rows = []
    for i in range(1500):
        text = list(rng.choice(words, rng.integers(5, 120)))
        bad = i % 5 == 0
        if bad:
            for _ in range(rng.integers(1, 5)):
                text.insert(rng.integers(0, len(text)), str(rng.choice(["idiot", "moron,", "Scum", "m0ron", "vequ" + rng.choice(words)])))
        rows.append((i, " ".join(text), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return frame.select("doc_id", "text"), frame.select("doc_id", "toxic")


def test_toxicity(more_toxic):
    docs, labels = more_toxic
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    share, bad, good = accuracy(found, labels, "toxic")
    assert share > 0.97 and np.mean(bad) > np.mean(good) + 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in found)
    left = toxicity.without_toxic(docs.withColumn("score", F.lit("x")), labels)
    assert left.columns == ["doc_id", "text", "score"]
    assert left.count() == sum(not r["predicted"] for r in found)


def test_odd_rows(odd_docs, no_docs, labels):
    ids = sorted(repr(r["doc_id"]) for r in odd_docs.collect())
    odd = labels.limit(0)
    for scores in (toxicity.toxicity_scores, quality.quality_scores):
        for given in (labels, odd):
            found = scores(odd_docs, given).collect()
            assert sorted(repr(r["doc_id"]) for r in found) == ids
            assert all(0 <= r["score"] <= 1 for r in found)
        assert scores(no_docs, labels).count() == 0
    assert toxicity.without_toxic(odd_docs, odd).columns == odd_docs.columns


def test_labels_kept_out(spark, labels):
    rows = features.training_rows(labels, "quality").collect()
    assert rows and not any(held_out(r["doc_id"]) for r in rows)
    some = features.training_rows(labels, "quality", fit_rows=50).count()
    assert 20 < some < 90
    odd = spark.createDataFrame([(0, None, 1), (None, 1, 0), (2, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert [(r["doc_id"], r["label"]) for r in features.training_rows(odd, "quality").collect()] in ([(2, 1.0)], [])


def test_additive_model():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (np.abs(x[:, 2]) > 0.9)).astype(float)
    model = quality.fit(x, y, np.arange(len(y)) % 4 == 0)
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    assert np.allclose(quality.fit(x[:0], y[:0], np.zeros(0, bool)).score(x), 1e-3, atol=1e-3)


def test_quality_scores_by_hand(more_documents, labels):
    """Each score is the base and one number of each table, looked up with plain loops."""
    model = quality.learn(more_documents, labels)
    assert len(model.tables) == len(features.SHAPE) and model.pairs
    texts = {r["doc_id"]: r["text"] for r in more_documents.collect()}
    found = quality.quality_scores(more_documents, labels).collect()
    for r in found[::7]:
        x = quality.text_features(Texts.of(pa.array([texts[r["doc_id"]]], pa.string())))[0]
        bin_ = lambda edges, value: sum(1 for e in edges if e <= value)
        z = model.base + sum(table[bin_(edges, v)] for table, edges, v in zip(model.tables, model.edges, x))
        z += sum(table[bin_(model.coarse[i], x[i]), bin_(model.coarse[j], x[j])] for (i, j), table in model.pairs.items())
        assert abs(r["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def tree_value(lines, x):
    """What a tree in its printed form says about a row of features."""
    at, depth = 0, 0
    while True:
        line = lines[at]
        if "Predict:" in line:
            return float(line.split("Predict:")[1])
        feature, sign, value = re.search(r"If \(feature (\d+) (<=|>) ([-0-9.E]+)\)", line).groups()
        holds = x[int(feature)] <= float(value) if sign == "<=" else x[int(feature)] > float(value)
        if holds:
            at += 1
        else:
            indent = len(line) - len(line.lstrip())
            at = next(i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith("Else") and len(lines[i]) - len(lines[i].lstrip()) == indent) + 1


def test_toxicity_scores_by_hand(more_toxic):
    """Each score is the curve at the sum of the printed trees, walked one by one."""
    docs, labels = more_toxic
    model = toxicity.Model(docs, labels)
    trees = [(w, t.toDebugString.rstrip().split("\n")[1:]) for w, t in zip(model.trees.treeWeights, model.trees.trees)]
    bounds, values = model.curve.boundaries, model.curve.predictions
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in model.score(docs).collect()[::40]:
        x = toxicity.features(Texts.of(pa.array([texts[r["doc_id"]]], pa.string())), model.entries, model.weights)[0]
        margin = sum(w * tree_value(t, x) for w, t in trees)
        raw = round(1 / (1 + math.exp(-2 * margin)), 3)
        assert abs(r["score"] - float(np.interp(raw, bounds, values))) < 2e-3 * max(1, np.abs(np.diff(values)).max() / max(np.diff(bounds).min(), 1e-3))
