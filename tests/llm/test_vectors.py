"""Vantage-point trees and lattice hashing against all pairs."""

import numpy as np
import pytest

from gritlens.llm import lattice, vptree

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, class string"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0.1, "c") for i, v, l in rows], SCHEMA)


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dims))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dims)) * rng.choice([0.02, 0.1, 0.3], (n, 1))
    x[5:60] = x[5]  # equal vectors
    return [(int(i), [float(c) for c in v], int(rng.integers(0, 2))) for i, v in zip(rng.permutation(n * 3)[:n], x.astype(np.float32))]


ODD = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, NAN], 1), (6, [INF, 1.0], 1),
       (7, [1.0, 0.0], 1), (7, [1.0, 0.0], 1), (8, [2.0, 0.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1),
       (None, [1.0, 0.01], 1), (50, [1.0, 0.02], 1), (50, [0.0, 1.0], 2), (100, [1e-30, 0.0], 1)]


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def nearest(rows, k=5):
    distinct = {(i, tuple(v)) for i, v, _ in rows if i is not None and usable(v)}
    found = {}
    for i, v in distinct:
        if i % 50 == 0:
            best = {}
            for j, w in distinct:
                if j != i and len(v) == len(w):
                    best[j] = max(best.get(j, -2), cosine(v, w))
            found[i, v] = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
    return sorted((i, r + 1, j, s) for (i, _), x in found.items() for r, (j, s) in enumerate(x))


@pytest.mark.parametrize("shard", [4096, 150])
def test_exact_search(spark, shard):
    rows = clustered(500, 12, 3)
    table = frame(spark, rows)
    found = vptree.nearest(table, table["vec_id"] % 50 == 0, relax=1.0, shard=shard).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    expected = nearest([(i, np.float32(v).tolist(), l) for i, v, l in rows])
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-12)


@pytest.mark.parametrize("shard", [4096, 100])
def test_repeated_ids_search(spark, shard):
    """An id with several vectors has one place, that of its nearest vector."""
    rng = np.random.default_rng(8)
    rows = [(50, [1.0, 0.0], 1)] + [(7, [1.0, x], 1) for x in (0.01, 0.02, 0.9)] + [(int(i), [1.0, float(i)], 1) for i in range(1, 7)]
    rows += [(int(rng.integers(100, 160)), [float(c) for c in np.float32(rng.normal(size=3))], 1) for _ in range(500)]
    table = frame(spark, rows)
    found = vptree.nearest(table, table["vec_id"] % 50 == 0, relax=1.0, shard=shard).collect()
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)
    expected = nearest([(i, np.float32(v).tolist(), l) for i, v, l in rows])
    assert sum(f[0] == 50 for f in found) == 5
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert sorted(f[:3] for f in found) == sorted(e[:3] for e in expected)
    assert np.allclose(sorted(f[3] for f in found), sorted(e[3] for e in expected), atol=1e-12)


def test_relaxed_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], None) for r in table.collect()]
    found = {(r["query_id"], r["vec_id"]) for r in vptree.nearest(table, table["vec_id"] % 50 == 0, shard=100).collect()}
    expected = {(e[0], e[2]) for e in nearest(rows)}
    assert len(found & expected) >= 0.9 * len(expected)


def test_pruning_skips_points():
    points = np.array([v for _, v, _ in clustered(2000, 3, 4)])
    tree, ids = vptree.Tree(points), np.arange(len(points))
    met = []
    asked = vptree.Asked(np.array([-1]), points[100:101], 5)
    meet = asked.meet
    asked.meet = lambda some, c, ids, rows: (met.append(len(ids)), meet(some, c, ids, rows))
    tree.search(asked, ids, 1.0)
    assert sum(met) < len(points) / 2
    assert 100 in asked.found[0] or asked.score[0, -1] > 1 - 1e-9


def test_odd_vectors_search(spark):
    table = frame(spark, ODD)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vptree.nearest(table, table["vec_id"] % 50 == 0).collect())
    expected = nearest([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in ODD])
    assert [f[:2] for f in found] == [e[:2] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-9)
    assert vptree.nearest(table.limit(0), table["vec_id"] % 50 == 0).count() == 0


def links(rows, least):
    n = len(rows)
    linked = [[] for _ in rows]
    for a in range(n):
        for b in range(a):
            (_, v, l), (_, w, m) = rows[a], rows[b]
            if usable(v) and usable(w) and len(v) == len(w) and l is not None and l == m and cosine(v, w) >= least:
                linked[a].append(b), linked[b].append(a)
    result, seen = [None] * n, set()
    for a in range(n):
        if a in seen:
            continue
        part, work = {a}, [a]
        while work:
            for b in linked[work.pop()]:
                if b not in part:
                    part.add(b), work.append(b)
        seen |= part
        ids = [rows[b][0] for b in part if rows[b][0] is not None]
        name = min(ids) if ids else None
        for b in part:
            result[b] = (rows[b][0], len(linked[b]), name, rows[b][0] is not None and rows[b][0] == name)
    return sorted(result, key=repr)


@pytest.mark.parametrize("tile", [512, 16])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rows = clustered(400, 64, 6)
    found = sorted((tuple(r) for r in lattice.near_duplicates(frame(spark, rows)).collect()), key=repr)
    expected = links(rows, 0.93)
    assert sum(e[1] for e in expected) > 1000
    assert sum(a != b for a, b in zip(found, expected)) <= 2
    assert sum(f[1] for f in found) <= sum(e[1] for e in expected)


def test_odd_vectors_links(spark):
    table = frame(spark, ODD)
    found = sorted((tuple(r) for r in lattice.near_duplicates(table).collect()), key=repr)
    assert found == links([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], l) for i, v, l in ODD], 0.93)
    assert lattice.near_duplicates(table.limit(0)).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)) * 2
    points = lattice.decode(x)
    assert np.allclose((points * 2) % 1, 0) and np.allclose(points.sum(axis=1) % 2, 0)
    assert len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(axis=1), 2)
    near = ((x - points) ** 2).sum(axis=1)
    for step in lattice.NEIGHBOURS:
        assert (near <= ((x - points - step) ** 2).sum(axis=1) + 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = lattice.unit(rng.normal(size=(3000, 64)))
    z = rng.normal(size=x.shape)
    z = lattice.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    a, b = lattice.cells(x, 0.93), lattice.cells(0.93 * x + np.sqrt(1 - 0.93**2) * z, 0.93)
    met = ((a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)).any(axis=1)
    assert met.mean() > 0.99
