"""k-means from many starts against separate runs in plain numpy, and the corners of ROC curves against all points."""

import math
import random

import numpy as np
import pytest

from rankloom.operators import clusters as K
from rankloom.operators import figures


def _lloyd(x, centres, most=50, close=0.0):
    for _ in range(most):
        near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
        new = np.array([x[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = ((new - centres) ** 2).sum(), new
        if moved <= close:
            break
    return ((x[:, None] - centres) ** 2).sum(2).min(1).sum()


def test_together_as_well_as_apart(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 1, (60, 3)) for m in ((0, 0, 0), (5, 0, 0), (0, 6, 1), (7, 7, 7))] + [np.zeros((20, 3))])
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, p array<double>").repartition(5)
    centres, cost = K.kmeans(d, "id", 4, starts=6, seed=9, tol=0.0)
    order = np.array([r.p for r in d.orderBy(K.F.xxhash64(K.F.lit(9), "id"), "id").collect()])
    apart = [_lloyd(x, c) for c in K.first_centres(order, 4, 6, 9)]
    assert cost == pytest.approx(min(apart)) and cost == pytest.approx(((x[:, None] - centres) ** 2).sum(2).min(1).sum())


def test_clusters_of_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [10.0 * (i % 3) + rng.random(), 5.0 * (i % 3 == 1) + rng.random(), 100.0], "x") for i in range(90)]
    odd = [(90, None, "x"), (91, [1.0, None, 2.0], "x"), (92, [math.nan, 0.0, 0.0], "x"), (93, [math.inf, 0.0, 0.0], "x"), (3, rows[3][1], "y")]
    got = K.clusters(spark.createDataFrame(rows + odd, "id int, v array<double>, embedding_cluster string"), "id", "v", k=3, components=2, starts=4).collect()
    assert sorted(r.id for r in got) == sorted([*range(90), 3])
    assert len({(r.id % 3, r.embedding_cluster) for r in got}) == 3
    assert all(r.embedding_cluster_size == (31 if r.id % 3 == 0 else 30) and r.embedding_cluster_distance < 1 < r.embedding_cluster_separation for r in got)


def test_few_or_no_vectors(spark):
    d = spark.createDataFrame([(1, [1.0, 1.0]), (2, [1.0, 1.0])], "id int, v array<double>")
    assert {tuple(r)[1:3] for r in K.clusters(d, "id", "v", k=3, starts=2).collect()} == {(0, 0.0)}
    e = K.clusters(d.filter("id > 5"), "id", "v", k=3)
    assert e.columns == K.clusters(d, "id", "v", k=2, starts=1).columns and e.count() == 0


def test_one_vector(spark):
    d = spark.createDataFrame([(2, [1.0, 1.0]), (3, None)], "id int, v array<double>")
    assert [tuple(r) for r in K.clusters(d, "id", "v", k=3, starts=2).collect()] == [(2, 0, 0.0, 0.0, 1)]


def test_parts_without_rows(spark, tmp_path):
    """Of a file that is read in parts, those in which no row group begins are tasks without rows."""
    rng = np.random.default_rng(2)
    rows = [(i, [10.0 * (i % 2) + x for x in rng.random(3).tolist()]) for i in range(40)]
    spark.createDataFrame(rows, "id int, p array<double>").coalesce(1).write.parquet(str(tmp_path / "p"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        d = spark.read.parquet(str(tmp_path / "p"))
        assert d.rdd.getNumPartitions() > 1 and 0 in d.rdd.glom().map(len).collect()
        centres, cost = K.kmeans(d, "id", 2, starts=2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    x = np.array([v for _, v in rows])
    assert cost == pytest.approx(((x[:, None] - centres) ** 2).sum(2).min(1).sum()) and len(centres) == 2


def test_vectors_of_different_lengths(spark):
    rows = [(i, [10.0 * (i % 2), 1.0, 5.0 * (i % 2)][: 2 if i == 4 else 3]) for i in range(8)] + [(8, [])]
    got = K.clusters(spark.createDataFrame(rows, "id int, v array<double>"), "id", "v", k=2, starts=4).collect()
    assert sorted(r.id for r in got) == list(range(9))
    of = {r.id: r.embedding_cluster for r in got}
    assert of[4] == of[0] == of[8] != of[1]


def test_corners_of_roc_curves(spark):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, math.nan, *(float(i) for i in range(25))]), int(rng.random() < p)) for g, p, n in (("a", 0.3, 400), ("b", 0.5, 60), (None, 0.5, 30)) for _ in range(n)]
    rows += [("one", float(i), 1) for i in range(50)] + [("same", 1.0, i % 2) for i in range(6)]
    got = {}
    for r in figures.roc_curve(spark.createDataFrame(rows, "g string, s double, y int"), ["g"], "s", "y").collect():
        got.setdefault(r.g, []).append(r)
    assert set(got) == {"a", "b", None, "one", "same"}
    for g, mine in got.items():
        d = [(s, y) for x, s, y in rows if x == g and s is not None and not math.isnan(s)]
        pos, neg = sum(y for _, y in d), sum(1 - y for _, y in d)
        points = [(t, sum(y for s, y in d if s >= t), sum(1 - y for s, y in d if s >= t)) for t in sorted({s for s, _ in d}, reverse=True)]
        keep = [p for i, p in enumerate(points) if i in (0, len(points) - 1) or (p[1] - points[i - 1][1]) * (points[i + 1][2] - p[2]) != (p[2] - points[i - 1][2]) * (points[i + 1][1] - p[1])]
        assert sorted((r.threshold, r.tp, r.fp) for r in mine) == sorted([*keep, (math.inf, 0, 0)])
        assert all(r.fpr == (r.fp / neg if neg else None) and r.tpr == (r.tp / pos if pos else None) for r in mine)
    assert len(got["one"]) == 3
