"""Hard negatives by cover trees and whitening by divide and conquer, against all pairs and plain linear algebra."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gritlens.llm import covertree, whitening
from test_vectors import INF, NAN, clustered, frame


def whole(v):
    return tuple(int(np.floor(256.0 * float(np.float32(c)))) for c in v)


def negatives(rows, k=5, low=80, high=100):
    """(anchor, positive, rank, negative, positive score, negative score), all pairs in whole numbers."""
    taken = sorted({
        (i, (l + 1) % 10 if i % 7 == 0 else l, whole(v)) for i, v, l in rows
        if i is not None and l is not None and v and all(c is not None and np.isfinite(c) for c in v)
    })
    found = []
    for i, l, x in taken:
        if i % 100:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), j, m) for j, m, y in taken if j != i and len(x) == len(y)))
        for p, j, _ in [s for s in scored if s[2] == l][:k]:
            fits = [s for s in scored if s[2] != l and low * -p <= high * -s[0] <= high * -p][:k]
            found += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(fits, 1)]
    return sorted(found)


def mined(table, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in covertree.hard_negatives(table, F.col("vec_id") % 100 == 0, label, **options).collect())


@pytest.mark.parametrize("cell", [4096, 60])
def test_hard_negatives(spark, cell):
    rows = [(i, v, (l or 0) * 3 + i % 3) for i, v, l in clustered(700, 8, 11)]
    # ties: rows of one vector under both labels, many of them anchors' neighbours
    rows += [(100 * i, rows[0][1], 1) for i in range(30, 36)] + [(5000 + i, rows[0][1], i % 3) for i in range(60)]
    found = mined(frame(spark, rows), cell=cell)
    assert found == negatives(rows) and len(found) > 100


def test_hard_negatives_of_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    assert mined(table) == negatives(rows)


ODD = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.5, 1.0], 2), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1),
       (5, [1.0, NAN], 1), (6, [INF, 1.0], 1), (8, [1.0, 0.6], 1), (9, [1.0, 0.4], None), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 2),
       (100, [-1.0, -1.0], 3), (101, [1.0, 1.0], 3), (102, [0.9, 0.5], 2), (103, [0.9, 0.5], 2), (200, [0.0, 0.0], 5), (201, [1.0, 1.0], 5),
       (202, [0.0, 1.0], 6), (300, [4e6, 3e6], 7), (301, [4e6, 3e6], 7), (302, [4e6, 2999999.0], 8), (7, [1.0, 0.5], 9), (14, [1.0, 0.5], 0)]


def test_odd_rows_of_negatives(spark):
    table = frame(spark, ODD)
    assert mined(table) == negatives(ODD)
    assert mined(table.limit(0)) == [] and mined(frame(spark, ODD[:1])) == []


def test_cover_tree_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    centres = rng.integers(-300, 300, (12, 6))
    x = np.vstack([centres[rng.integers(0, 12, 3000)] + rng.integers(-8, 9, (3000, 6)), np.zeros((50, 6), int)])
    tree = covertree.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    points = x[tree.order]
    q = centres[0].astype(float)
    for low, high, radius in zip(tree.low, tree.high, tree.radius):
        scale = np.linalg.norm(q) * tree.norm
        angle = np.arccos(np.clip(points[low] @ q / scale, -1, 1))
        inner = points[low:high] @ q
        assert inner.max() <= scale * np.cos(max(angle - radius, 0)) + 1e-6
        assert inner.min() >= scale * np.cos(min(angle + radius, np.pi)) - 1e-6
    asked = covertree.Asked(np.array([-1]), np.array([0]), x[:1], np.array([[-np.inf]]), np.array([[np.inf]]), 5, True, True)
    met, meet = [], asked.meet
    asked.meet = lambda rows, p, ids, labels: (met.append(len(p)), meet(rows, p, ids, labels))
    covertree.search(tree, points, tree.order, np.zeros(len(x), int), asked)
    best = np.lexsort((np.arange(len(x)), -(x @ x[0])))[:5]
    assert asked.found[0, 0].tolist() == best.tolist() and sum(met) < len(x) / 3


def plain_whitening(rows, k=4):
    """Per row its exact deviation, and components by another method."""
    x = [whole(v) for _, v, _ in rows]
    distinct = np.array(sorted(set(x)), float)
    n, sums = len(distinct), [sum(c) for c in zip(*sorted(set(x)))]
    values, vectors = np.linalg.eigh(np.cov(distinct.T, bias=True))
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    y = (np.array(x, float) - distinct.mean(axis=0)) @ vectors / np.sqrt(values)
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return n, deviation, y, values, np.cov(distinct.T, bias=True).trace()


def test_whitening(spark):
    rows = clustered(400, 12, 9)
    n, deviation, y, values, trace = plain_whitening(rows)
    found = whitening.whitened(frame(spark, rows).repartition(5)).collect()
    assert len(found) == 4 * len(rows)
    place = {i: at for at, (i, _, _) in enumerate(rows)}
    got = np.zeros(y.shape)
    for r in found:
        at, c = place[r["vec_id"]], r["component"] - 1
        got[at, c] = r["whitened"]
        assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, deviation[at], deviation[at])
        assert abs(r["explained"] / (values[c] / trace) - 1) < 1e-9 and r["identity_error"] < 1e-9
    sign = np.sign((got * y).sum(axis=0))
    assert np.abs(got * sign - y).max() < 1e-8


def test_components_by_divide_and_conquer():
    rng = np.random.default_rng(4)
    for m in (1, 2, 3, 17, 64):
        basis, _ = np.linalg.qr(rng.standard_normal((m, m)))
        for values in (np.arange(m, 0, -1.0), np.ones(m), 10.0 ** -np.arange(m), np.r_[np.full(m // 2, 3.0), np.zeros(m - m // 2)], np.zeros(m)):
            a = (basis * values) @ basis.T
            a = (a + a.T) / 2
            for wanted in (1, 4, m):
                found, vectors = whitening.components(a, min(wanted, m))
                assert np.allclose(found, np.sort(values)[::-1][: len(found)], atol=1e-13 * max(1, m))
                assert np.allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)
                assert np.allclose(a @ vectors, vectors * found, atol=1e-12 * max(1, np.abs(values).max() * m))


def test_polar_factor():
    rng = np.random.default_rng(6)
    basis, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    values = np.r_[10.0 ** -np.arange(8.0), -(10.0 ** -np.arange(12.0) / 3)]
    factor = whitening.polar_factor((basis * values) @ basis.T)
    assert np.allclose(factor @ factor, np.eye(20), atol=1e-12) and abs(np.trace(factor) + 4) < 1e-3


def test_odd_rows_of_whitening(spark):
    rows = [(1, None), (2, [1.0, None]), (3, [1.0, NAN]), (4, [INF, 0.0]), (5, []), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [3.0, 1.0]),
            (7, [0.0, 0.0]), (8, [0.5]), (9, [1e30, 1.0, 1.0]), (10, [-1e30, 2.0, 1.0])]
    found = whitening.whitened(frame(spark, [(i, v, 1) for i, v in rows])).collect()
    assert Counter(r["vec_id"] for r in found) == Counter({6: 4, None: 2, 7: 2, 8: 1, 9: 3, 10: 3})
    assert {r["n"] for r in found if r["vec_id"] in (6, 7)} == {3}
    (single,) = [r for r in found if r["vec_id"] == 8]
    assert (single["deviation"], single["whitened"], single["explained"], single["identity_error"]) == (0, None, None, None)
    x = [(256, 512), (768, 256), (0, 0)]
    s = [sum(c) for c in zip(*x)]
    assert {r["deviation"] for r in found if r["vec_id"] == 6} == {sum((3 * c - t) ** 2 for c, t in zip(x[0], s))}
    huge = [r for r in found if r["vec_id"] == 9]
    assert [r["whitened"] is None for r in huge] == [False, True, True] and all(r["deviation"] is None for r in huge)
    assert all(r["identity_error"] < 1e-4 for r in found if r["identity_error"] is not None)
    assert whitening.whitened(frame(spark, [])).count() == 0 and whitening.whitened(frame(spark, [(1, None, 1)])).count() == 0


def test_sums_are_exact(spark):
    """Large numbers whose doubles would lose the variance: a plain sum in fractions agrees."""
    base = 2.0**22
    rows = [(i, [base + d / 256, base - d / 128], 1) for i, d in enumerate((0, 64, 128, 192, 256))]
    x = [whole(v) for _, v, _ in rows]
    n = len(set(x))
    mean = [Fraction(sum(c), n) for c in zip(*set(x))]
    variance = sum(sum((a - m) ** 2 for a, m in zip(v, mean)) for v in set(x)) / n
    found = whitening.whitened(frame(spark, rows)).collect()
    first = [r for r in found if r["component"] == 1]
    assert all(r["identity_error"] < 1e-9 for r in first) and abs(np.mean([r["whitened"] ** 2 for r in first]) - 1) < 1e-9
    assert {r["deviation"] for r in first} == {int(sum((n * a - n * m) ** 2 for a, m in zip(v, mean))) for v in x}
    assert variance > 0
