"""The similarity join against all pairs."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritlens.llm import jaccard
from gritlens.llm.store import SHUFFLE_CLEANUP, Stage
from llm_brute import groups


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = groups(rows)
    found = sorted(
        ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similarity_groups(docs).collect()), key=repr
    )
    assert found == sorted(expected, key=repr)
    return expected


def test_documents(documents):
    assert len({c for _, _, c in check(documents)}) < documents.count()


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert jaccard.similarity_groups(no_docs).count() == 0


def near_copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    copies = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        copies.append(" ".join(copy))
    return copies


@pytest.mark.parametrize("chunk", [256, 8])
def test_large_groups(spark, monkeypatch, chunk):
    """A group of near copies, one of exact copies and a passage that many share; also in small chunks."""
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(90, 120, 4, 1) + ["same words in each of these copies"] * 50
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 15, 40]))) for _ in range(60)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5))


def test_exactly_at_the_threshold(spark):
    words = [f"w{i}" for i in range(40)]
    # 7 shared of 9 and 10 in all: sets of sequences of 5
    rows = [(1, " ".join(words[:11])), (2, " ".join(words[:13])), (3, " ".join(words[:14])), (4, " ".join(words[:16]))]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))


def test_one_of_each_group(odd_docs):
    found = jaccard.one_of_each_group(odd_docs)
    assert found.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    answer = groups(rows)
    expected = [(i, t) for (i, t), (_, n, _) in zip(rows, answer) if not n]
    for key in {c for _, n, c in answer if n}:
        members = [(i, t) for (i, t), (_, n, c) in zip(rows, answer) if n and c == key]
        # groups that share their name by a repeated doc_id stay apart by their texts
        expected += [min(members, key=lambda m: (m[0] is not None, m[0] or 0))] if key != 9 else members
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted(expected, key=repr)


def left_behind(spark, before=frozenset()):
    """Shuffle files of the session that were not there before; they are removed in the background."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    for _ in range(50):
        files = {p.name for d in blocks.localDirsString() for p in Path(d).rglob("shuffle_*")} - before
        if not files:
            break
        time.sleep(0.2)
    return files


def test_kept_tables_leave_no_shuffle_files(spark):
    before = frozenset(left_behind(spark))
    kept = Stage(spark, "test").keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not left_behind(spark, before)
    assert spark.conf.get(SHUFFLE_CLEANUP, None) is None
    assert sorted(r["count"] for r in kept.collect()) == [142] + [143] * 6


def test_large_tables_go_when_read(spark):
    """The counts of shingles, the candidates and the sets are no longer there when the links are known."""
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    texts = near_copies(40, 60, 2, 3)
    before = set(folder.iterdir())
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert "jaccard-rows" in left
    assert not left & {"jaccard-described", "jaccard-frequent", "jaccard-candidates", "jaccard-sets"}


def test_documents_are_shuffled_once(spark):
    """From its scan to the result, a document passes one exchange: the join and the window are dealt alike."""
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, "one two"), (None, "three")], "doc_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.one_of_each_group(docs)
        plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sorted(map(tuple, kept.collect()), key=repr) == [(1, "one two"), (None, "three")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    depth = [re.search("[A-Za-z]", x).start() for x in plan if x.strip()]
    at = next(i for i, x in enumerate(plan) if " AS row#" in x)
    above, exchanges = depth[at], 0
    for i in range(at - 1, -1, -1):
        if depth[i] < above:
            above, exchanges = depth[i], exchanges + (" Exchange " in plan[i])
    assert exchanges == 1


def test_numbers_come_to_the_driver_packed(spark, monkeypatch):
    """Frequent shingles and words of the Bloom filter: a row for each batch, not one for each number."""
    frame, rows = type(spark.range(1)), []
    collect = frame.collect

    def counted(self):
        found = collect(self)
        rows.append(len(found))
        return found

    monkeypatch.setattr(frame, "collect", counted)
    words = jaccard.membership_filter(spark.range(20_000))
    assert len(words) > 4000 and jaccard.in_filter(words, np.arange(20_000)).all()
    assert not jaccard.in_filter(words, np.arange(10**6, 10**6 + 1000)).all()
    monkeypatch.setattr(jaccard, "LIST", 1)
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "y " + text)], "doc_id bigint, text string")
    assert {r["component_id"] for r in jaccard.similarity_groups(docs).collect()} == {1}
    assert max(rows) <= 100
