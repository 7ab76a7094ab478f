"""Ball-tree search and hard-negative mining against plain Python: ties, repeats, hot vectors, odd values, lengths, no rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.llm import hard_negatives as H
from rankloom.llm import top_k as K
from rankloom.llm import vectors as V

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score string, rank int, grp int, kind string"
CLIP = (1 << 63) - 1


def floors(v, scale):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return [min(CLIP, max(-CLIP - 1, math.floor(x * float(scale)))) if math.isfinite(x * float(scale)) else (CLIP if x > 0 else -CLIP - 1) for x in v]


def inner(a, b):
    return min(CLIP, max(-CLIP - 1, sum(int(float(x)) * int(float(y)) for x, y in zip(a, b, strict=True))))


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", "y", 1, 2, "z") for i, v, y in rows], SCHEMA).repartition(3)


def some(n, seed, dim=6, hot=0.33, clusters=5):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(clusters)]
    common = [rng.gauss(0, 0.5) for _ in range(dim)]
    rows = []
    for i in range(n):
        v = list(common) if rng.random() < hot else [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]
        rows.append((i, v, rng.randrange(4) if rng.random() < 0.9 else None))
    return rows


ODD = [(None, [1.0] * 6, 1), (1000, None, 1), (1100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (1200, [float("nan")] + [1.0] * 5, 0), (1300, [float("inf")] + [0.0] * 5, 0), (1400, [], 1), (1500, [], 2), (1600, [0.0] * 6, 1), (1700, [2.0, 3.0], 1), (1800, [1.0, -1.0], 2), (1900, [1.0, 1.0], 1), (2000, [-1.0] * 6, 3), (2001, [-1.0] * 6, 3), (200, [0.1] * 6, 2), (200, [0.1] * 6, 2), (200, [0.2] * 6, 1)]
HUGE = [(3000, [1e17, 3.0], 1), (3001, [1e17, 4.0], 1), (3002, [-1e300, 1e300], 2), (3003, [9e15, 1.0], 2), (3100, [1e9 + 1, 7.0], 1), (3101, [2e8, 0.25], 0), (3150, [5e8, 1.0], 0)]


def brute_top(rows, asks, k, scale):
    kept = [(i, floors(v, scale)) for i, v, _ in rows if i is not None and floors(v, scale) is not None]
    queries = {}
    for i, v in kept:
        if asks(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, v in queries.items():
        best = sorted((-inner(v, w), i) for i, w in kept if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("rows, tree_rows, group", [(some(900, 1) + ODD, 150, 4), (some(300, 2) + ODD + HUGE, 16384, 4096), (some(700, 3, hot=1.0), 300, 2)])
def test_top_k(spark, rows, tree_rows, group):
    got = K.top_k(table(spark, rows), F.col("vec_id") % 100 == 0, 10, 1024, tree_rows=tree_rows, group=group)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 100 == 0, 10, 1024)


def test_top_k_without_rows_or_queries(spark):
    assert K.top_k(table(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert K.top_k(table(spark, some(20, 4)), F.col("vec_id") < 0).count() == 0


def test_bounds_hold_and_leaves_fall_away():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 400, (20, 8))
    vecs = np.floor(np.concatenate([c + rng.normal(0, 20, (200, 8)) for c in centres]))
    t = K.Tree.build(vecs, np.arange(len(vecs)))
    q = np.floor(rng.normal(0, 400, (50, 8)))
    first = 0
    for level in range(t.depth + 1):
        cuts = t.edges(len(vecs), level)
        for node, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            assert (t.bounds(q, V.norms(q), first + node) >= (q @ t.vecs[a:b].T).max(1)).all()
        first += 1 << level
    best, read = V.Best(50, 10), []
    offer = best.offer
    best.offer = lambda rows, scores, *more: (read.append(scores.size), offer(rows, scores, *more))
    t.search(q, np.full(50, -1), best)
    want = np.sort(q @ vecs.T, 1)[:, ::-1][:, :10].astype(int)
    assert (best.score.reshape(50, 10) == want).all()
    assert sum(read) < 0.3 * 50 * len(vecs)


def brute_negatives(rows, asks, scale, label):
    kept = [(i, floors(v, scale), label(i, y)) for i, v, y in rows if i is not None and y is not None and floors(v, scale) is not None]
    anchors = {}
    for i, v, y in kept:
        if asks(i):
            anchors[i] = min((y, v), anchors.get(i, (y, v)))
    out = []
    for a, (y, v) in anchors.items():
        scored = sorted((-inner(v, w), i, z) for i, w, z in kept if i != a and len(w) == len(v))
        for ps, p in [(-s, i) for s, i, z in scored if z == y][:5]:
            good = [(-s, i) for s, i, z in scored if z != y and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(a, p, n + 1, i, ps, s) for n, (s, i) in enumerate(good)]
    return sorted(out)


@pytest.mark.parametrize("rows, block, group", [(some(900, 6) + ODD, 64, 5), (some(200, 7) + ODD + HUGE, 2048, 2048), (some(500, 8, hot=0.8), 100, 3), (some(600, 9, clusters=1, hot=0), 30, 4)])
def test_hard_negatives(spark, rows, block, group):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, label, 256, block=block, group=group)
    want = brute_negatives(rows, lambda i: i % 50 == 0, 256, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert want and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_without_rows_or_anchors(spark):
    assert H.hard_negatives(table(spark, []), F.col("vec_id") % 50 == 0, F.col("label")).count() == 0
    assert H.hard_negatives(table(spark, some(20, 4)), F.col("vec_id") < 0, F.col("label")).count() == 0


def test_small_reach_needs_more_rounds(spark, monkeypatch):
    monkeypatch.setattr(H, "REACH", 8)
    monkeypatch.setattr(H, "GROWTH", 2)
    rows = some(400, 10, hot=0.1)
    got = H.hard_negatives(table(spark, rows), F.col("vec_id") % 50 == 0, F.col("label"), 256, block=16, group=3, pivots=4)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 50 == 0, 256, lambda i, y: y)


def test_best_keeps_ties_of_small_ids():
    b = V.Best(1, 2)
    row = np.zeros(1, int)
    for ids in ([9, 8, 7], [3, 5], [1], [6, 0]):
        b.offer(row, np.full((1, len(ids)), 4), np.array(ids))
        b.settle()
    assert b.id.tolist() == [0, 1] and b.score.tolist() == [4, 4]
