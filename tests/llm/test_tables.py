"""Packing, archives, mixing and the pipeline: whole, valid and in proportion."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gritlens.llm import mixing, packing, toxicity, warc
from gritlens.llm.queries import MIXING_SQL
from gritlens.llm.store import Stage
from llm_brute import groups
from test_scans import personal_spans
from test_texts import WORD

VOCABULARY = packing.public_vocabulary("byte_bpe_50k.json")


def encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    return [np.array(e.ids + [0], "<u4") for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, found, capacity=2048):
    expected = []
    for (key, _), ids in zip(rows, encoded([t or "" for _, t in rows])):
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        expected += [(key, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(expected, key=repr)
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(e[3] for e in expected)


TOKEN_TEXTS = ["a  b\n\n c ", " lead", "tab\tx \n", "no break x", "it's  don't I'LL", "12 3,4!! ##", "　x y", "a\x1cb\x85c",
               "end <|endoftext|> of", "<|endoftext|>", "x<|endoftext|><|endoftext|>y é", "<|endoftext", " line thin", "x" * 5000, "éà 你好 \U0001f600\U0001f600", "\r\n\r\n  \t"]


def test_packing(spark, documents, odd_docs, no_docs):
    docs = documents.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(
        spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TOKEN_TEXTS)], "doc_id bigint, text string")
    )
    rows = [tuple(r) for r in docs.collect()]
    used, tokens = check_packing(rows, packing.pack_documents(docs, VOCABULARY).collect())
    assert used <= -(-tokens // 2048) * 1.02 + 1
    assert packing.pack_documents(no_docs, VOCABULARY).count() == 0


def test_partitions_exchange(spark, documents):
    whole = packing.pieces(documents, VOCABULARY)
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    found = packing.packed(whole, group=25).collect()
    used, tokens = check_packing(rows, found)
    assert used <= -(-tokens // 2048) * 1.03 + 2
    assert all(1 <= r["partition_bound"] <= r["partition_sequences"] for r in found)
    assert sum(r["partition_bound"] == r["partition_sequences"] for r in found) > 0.9 * len(found)


def test_best_fit_and_bound():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([10, 30, 100])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(0, 60))], np.int64)
        sequence, offset, used = packing.best_fit(sizes, capacity)
        fill = np.bincount(sequence, weights=sizes, minlength=used) if len(sizes) else np.zeros(0)
        assert len(fill) == used and (fill <= capacity).all()
        assert -(-sizes.sum() // capacity) <= packing.lower_bound(sizes, capacity) <= used
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # more than by their sum


PAGES = [(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, "<p>a</p>"), (3, "v", "<p>a</p>"), (4, "x\r\ny é", None), (5, "e", ""),
         (None, "n", "<p>a</p>"), (6, "w", "\r\n\r\nWARC/1.1\r\n" * 3), (7, "big", "é" * 70_000), (8, "big", "é" * 70_000), (None, None, None)]


@pytest.mark.parametrize("smallest", [0, 5])
@pytest.mark.parametrize("chunk", [256 << 10, 1000])
def test_archive(spark, smallest, chunk):
    pages = spark.createDataFrame([(i, u, h, 1, "x") for i, u, h in PAGES], "page_id bigint, url string, html string, record int, digest string")
    expected, largest = [], {}
    for i, _, h in PAGES:
        data = (h or "").encode()
        if i is not None:
            largest[data] = max(i, largest.get(data, i))
    for i, _, h in PAGES:
        data = (h or "").encode()
        keeper = largest.get(data)
        revisit = len(data) >= smallest and i != keeper
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((i, len(data), digest, "revisit" if revisit else "response", keeper if revisit else None))
    found = [tuple(r) for r in warc.round_trip(pages, smallest, chunk).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_bytes(spark):
    """The chunks in order are records that a plain parser reads."""
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    rows = warc.write_archive(pages, Stage(spark, "test"), chunk=1000).orderBy("archive", "record", "chunk").collect()
    assert max(len(r["data"]) for r in rows) < 2000
    data, seen = b"".join(r["data"] for r in rows), 0
    while data:
        assert data.startswith(b"WARC/1.1\r\n")
        head, _, rest = data.partition(b"\r\n\r\n")
        length = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        assert rest[length : length + 4] == b"\r\n\r\n"
        data, seen = rest[length + 4 :], seen + 1
    assert seen == len(PAGES)


def test_damaged_archive(spark):
    pages = spark.createDataFrame(PAGES[:2], "page_id bigint, url string, html string")
    archive = warc.write_archive(pages, Stage(spark, "test")).collect()
    broken = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4], bytes(r[5]).replace(b"<p>a", b"<p>b")) for r in archive], warc.ARCHIVE)
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(broken).collect()


def mixed(rows):
    """(doc_id, size, source_size, target, taken) in the plain way."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = Counter()
    for (_, _, s), n in zip(rows, sizes):
        by[s] += n
    order = sorted(by, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, target = 1.5 * sum(sizes), {}
    open_ = list(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        stopped = [s for s in open_ if weight[s] * level > 2 * by[s]]
        if not stopped:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in stopped:
            target[s] = 2.0 * by[s]
            left -= 2 * by[s]
            open_.remove(s)
    return sizes, by, target


def test_mixing(documents, odd_docs, no_docs):
    for docs in (documents, odd_docs):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        sizes, by, target = mixed(rows)
        found = mixing.mixed_documents(docs).collect()
        assert sorted(((r["doc_id"], r["size"]) for r in found), key=repr) == sorted(((i, n) for (i, _, _), n in zip(rows, sizes)), key=repr)
        assert Counter((r["source_size"], round(r["target"], 6)) for r in found) == Counter((by[s], round(target[s], 6)) for _, _, s in rows)
        taken = defaultdict(int)
        for r in found:
            assert 0 <= r["taken"] <= 2 * r["size"]
            taken[round(r["target"], 6)] += r["taken"]
        wanted = defaultdict(float)
        for s, t in target.items():
            wanted[round(t, 6)] += t
        assert all(abs(taken[k] - t) <= len(by) for k, t in wanted.items())
    assert mixing.mixed_documents(no_docs).count() == 0
    again = mixing.mixed_documents(documents.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, mixing.mixed_documents(documents).collect()))


def test_schedule_is_even(documents, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 64)
    found = mixing.mix(documents)
    share = {r["source_key"]: r["n_slots"] for r in found.targets.collect()}
    total = sum(share.values())
    slots = [r["source_key"] for r in found.schedule.orderBy("slot").collect()]
    assert Counter(slots) == Counter({k: n for k, n in share.items() if n})
    seen = Counter()
    for i, s in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[k] - n * i / total) < 3 + np.log2(total) for k, n in share.items())
    words = {r["slot"]: r["w"] for r in found.taken.groupBy("slot").agg({"words": "sum"}).withColumnRenamed("sum(words)", "w").collect()}
    assert len(words) == len(slots) and sum(w < 64 for w in words.values()) <= len(share)


def test_mixing_sql(spark):
    from check_queries import compare, oracle_connection

    folder = "/root/testdata/sf0.001"
    assert MIXING_SQL
    ok, message = compare(spark, oracle_connection(folder), "op10_source_mixing", folder)
    assert ok, message


def test_mixed_texts(documents, odd_docs):
    for docs in (documents, odd_docs):
        found = mixing.mixed_texts(docs)
        assert found.columns == docs.columns
        times = Counter(r["text"] for r in found.collect() if r["text"])
        assert max(times.values(), default=0) <= 2 * max(Counter(r["text"] for r in docs.collect()).values())


def test_pipeline_stages(spark, documents, labels):
    """Each stage on what its predecessor kept, against plain answers."""
    folder = "/root/testdata/sf0.001"
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "personal_data", "mixing", "packing"]
    stage, docs, kept = Stage(spark, "test"), documents, {}
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, stage.keep(function(spark, docs, folder), name)
        kept[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == documents.columns
        if name == "toxicity":
            scores = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(before, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
            assert {r["doc_id"] for r in kept[name]} == {i for i, p in scores.items() if not p}
        if name == "ngram_jaccard":
            rows = [(r["doc_id"], r["text"]) for r in kept["toxicity"]]
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(i for i, n, c in groups(rows) if i == c or not n)
        if name == "personal_data":
            assert sorted(r["doc_id"] for r in kept[name]) == sorted(r["doc_id"] for r in kept["ngram_jaccard"])
            assert not any(personal_spans(r["text"]) for r in kept[name])
            clean = {r["doc_id"]: r["text"] for r in kept["ngram_jaccard"] if not personal_spans(r["text"])}
            assert sum(r["text"] != clean[r["doc_id"]] for r in kept[name] if r["doc_id"] in clean) == 0
        if name == "mixing":
            taken = {r["doc_id"]: (r["taken"], r["size"]) for r in mixing.mixed_documents(before).collect()}
            times = Counter(r["doc_id"] for r in kept[name])
            for key, (words, size) in taken.items():
                assert times[key] == (-(-words // size) if size else 0) or 0 < words and times[key] == 2
        if name == "packing":
            check_packing([(r["doc_id"], r["text"]) for r in kept["mixing"]], docs.collect())


def test_pipeline_on_odd_rows(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.001"
    for docs in (odd_docs, no_docs):
        for name, function in corpus_pipeline.STAGES:
            before, docs = docs, function(spark, docs, folder)
            if name != "packing":
                assert docs.columns == before.columns
                # what a stage keeps has its values, but for redacted texts
                others = [f"`{c}`" for c in docs.columns if c not in ("text", "m")]
                assert set(map(repr, docs.select(*others).collect())) <= set(map(repr, before.select(*others).collect()))
                assert all(r[0] == {"k": 1} for r in docs.select("m").collect())
        docs.collect()
