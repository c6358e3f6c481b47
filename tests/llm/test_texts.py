"""Word buffers against regular expressions; components against a sequential search."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gritlens.llm import graph, packing, textbuf, toxicity
from gritlens.llm.graph import components, roots
from gritlens.llm.store import Stage

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB \n\té\x0b\x1c ", max_size=40)), max_size=12)


@settings(deadline=None, max_examples=60)
@given(texts)
def test_words_and_shingles(values):
    batch = textbuf.Texts.of(pa.array(values, pa.string()))
    words = batch.words()
    found = [[] for _ in values]
    for t, a, b in zip(words.text, words.start, words.end):
        found[t].append(bytes(batch.data[a:b]).decode())
    assert found == [WORD.findall(v or "") for v in values]
    assert batch.characters().tolist() == [len(v or "") for v in values]
    text, value = textbuf.shingles(batch.lower().words())
    sets = [set(value[text == i].tolist()) for i in range(len(values))]
    expected = [shingle_set(v) for v in values]
    assert [len(s) for s in sets] == [len(s) for s in expected]
    for i in range(len(values)):
        for j in range(i):
            assert len(sets[i] & sets[j]) == len(expected[i] & expected[j])


def test_hashes_do_not_depend_on_blocks():
    batch = textbuf.Texts.of(pa.array(["abc de " * 50, "x" * 5000]))
    words = batch.words()
    whole = words.hashes()
    assert np.array_equal(whole, textbuf.run_hashes(batch.data, words.start, words.end, block=8))
    assert textbuf.word_hashes(["abc", "de"]).tolist() == whole[:2].tolist()


def test_slices_cover_everything():
    batch = pa.record_batch({"i": pa.array(range(5)), "t": pa.array(["a" * 10, None, "b" * 100, "", "c"])})
    parts = list(textbuf.small_slices(batch, 1, 12))
    assert [i for rows, _ in parts for i in rows.column(0).to_pylist()] == list(range(5))
    assert all(len(texts) == rows.num_rows for rows, texts in parts)


def smallest(edges):
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_roots():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60):
        a, b = rng.integers(0, n, 40), rng.integers(0, n, 40)
        found, expected = roots(a, b, n), smallest(list(zip(a.tolist(), b.tolist())))
        assert all(found[x] == expected.get(x, x) for x in range(n))


@pytest.mark.parametrize("few", [0, 1 << 18])
def test_components(spark, monkeypatch, few):
    """By rounds of stars, and with the end in one task."""
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(-200, 200, (150, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    frame = spark.createDataFrame(edges, "x bigint, y bigint").repartition(7)
    found = components(frame, Stage(spark, "test")).collect()
    assert {r["node"]: r["component"] for r in found} == smallest([e for e in edges if e[0] != e[1]])
    assert len(found) == len({r["node"] for r in found})
    assert components(frame.limit(0), Stage(spark, "test")).count() == 0


def test_few_components_shuffle_nothing(spark):
    """Their nodes are bounded: no aggregate at each use, and joins with them broadcast."""
    frame = spark.createDataFrame([(i, i + 1) for i in range(0, 3000, 3)], "a bigint, b bigint")
    named = components(frame, Stage(spark, "test"))
    rows = spark.range(100_000).repartition(4)
    plan = rows.join(named, rows["id"] == named["node"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(map(tuple, named.collect())) == sorted((i + k, i) for i in range(0, 3000, 3) for k in (0, 1))


def test_workers_get_small_batches(spark, labels):
    """Rows of long texts reach Python in batches of a bounded size, and the text of a row once."""
    docs = spark.range(0, 400, 1, 1).selectExpr("id as doc_id", "concat(id, repeat(' some words', 8000)) as text", "'a' as source")

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch({"bytes": [batch.nbytes]})

    kept = toxicity.without_toxic(docs, labels)
    assert max(r["bytes"] for r in docs.mapInArrow(sizes, "bytes bigint").collect()) < 6 << 20
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert "struct(doc_id" in plan and not re.search(r"struct\([^)]*text, text#", plan)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert found and all(t == str(i) + " some words" * 8000 for i, t in found.items())


def test_word_memory(monkeypatch):
    """Ids are the same with every word remembered, some, and after forgetting."""
    words = packing.WordIds(packing.public_vocabulary("byte_bpe_50k.json"))
    monkeypatch.setattr(packing, "CACHE", 40)
    texts = ["one two three", " two  one four\n", "", "five sixth one", "three " * 30 + "last"] + [f"w{i} one x{i}y" for i in range(60)]
    for some in (texts, texts[::-1], texts[3:], texts):
        ids, many = words.of(textbuf.Texts.of(pa.array(some)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(many)[:-1])] == [words.encode(t).tolist() for t in some]
        assert (np.diff(words.known.astype(object)) > 0).all() and len(words.known) == len(words.place) == words.many
