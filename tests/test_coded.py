"""Many comparisons from one row a report, against a row for each comparison, fold and task."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import coded as V
from rankloom.operators import scoring as Z
from rankloom.operators import stats as S


def _wide(spark, n=900):
    rng = random.Random(5)
    value = lambda: rng.choice([rng.random(), float(rng.randrange(4)), -0.0, None, math.nan, 1e9])
    rows = [(i, rng.randrange(2), rng.choice([0, 1, 1, None]), value(), value(), float(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "bug int, a int, b int, f double, g double, h double").repartition(5)


def test_folds_and_weights_of_all_tasks_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 100)
    monkeypatch.setattr(V, "ROWS", 60)
    Z.folds_of_tasks(_wide(spark), "bug", ["a", "b"]).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    names = ["f", "g", "h"]
    parts = []
    for t in "ab":
        d = Z.folds(wide.select("bug", F.lit(t).alias("task"), F.col(t).alias("y"), *names, f"fold_{t}"), "bug", "y", ["task"])
        assert d.filter(F.col("fold") != F.col(f"fold_{t}")).count() == 0
        parts.append(S.long_form(d, ["task", "bug", "y", "fold"], names))
    long = parts[0].union(parts[1])
    want = {(r.task, r.model, r.feature): (r.delta, r.mu, r.sd) for r in Z.fold_params(long, ["task"]).collect()}
    p = V.fold_params(wide, names, {t: (t, f"fold_{t}") for t in "ab"})
    got = {(r.task, r.model, r.feature): (r.delta, r.mu, r.sd) for r in p.collect()}
    assert set(got) == set(want) and len(got) == 2 * 6 * 3
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12)

    params = spark.createDataFrame([(*k, *v) for k, v in got.items() if k[2] != "h"], p.schema)
    rows = wide.select("bug", *names, F.lit("a").alias("task"), F.col("fold_a").alias("model"))
    long = S.long_form(rows, ["bug", "task", "model"], names)
    want = {r.bug: r.score for r in Z.delta_scores(long, params, ["bug"], ["task", "model"]).collect()}
    scored = Z.wide_delta_scores(rows, params, ["bug"], ["task", "model"], names)
    got = {r.bug: r.score for r in scored.collect()}
    assert set(got) == set(want) and len(got) < 900
    assert all(got[b] == pytest.approx(want[b], abs=1e-9) for b in got)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "bug" in plan and "SortMergeJoin" not in plan


def test_values_meet_once_for_all_comparisons(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "CHUNK", 100)
    monkeypatch.setattr(V, "ROWS", 60)
    code = F.col("a") * 2 + F.coalesce(F.col("b"), F.lit(0))
    _wide(spark).withColumn("code", code).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    sides = {"a": [0, 0, 1, 1], "b": [0, 1, 0, 1], "a not b": [None, 0, 1, None], "one sided": [1, None, None, None], "nobody": [None] * 4}
    got = V.two_groups(wide, ["f", "g", "h"], "code", sides, "pair")
    got = {(r.pair, r.feature): r for r in got.collect()}
    first = F.array(*[F.array(*[F.lit(x).cast("int") for x in row]) for row in sides.values()])
    name = F.array(*map(F.lit, sides))
    long = S.long_form(wide, ["bug", "code"], ["f", "g", "h"]).withColumn("i", F.explode(F.array(*map(F.lit, range(5)))))
    long = long.select("feature", "value", name[F.col("i")].alias("pair"), (first[F.col("i")][F.col("code")] == 1).alias("is_first")).filter("is_first is not null")
    want = {(r.pair, r.feature): r for r in S.two_groups(long, ["pair", "feature"]).collect()}
    assert set(got) == set(want) and len(got) == 12
    for k in got:
        for c in want[k].__fields__:
            assert getattr(got[k], c) == (pytest.approx(getattr(want[k], c), rel=1e-9, abs=1e-9) if isinstance(getattr(want[k], c), float) else getattr(want[k], c)), (k, c)


def test_no_rows(spark, tmp_path):
    _wide(spark).filter("bug < 0").withColumns({"code": F.lit(0), "fold_a": F.lit(0)}).write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    assert V.two_groups(wide, ["f"], "code", {"x": [1]}, "pair").count() == 0
    assert V.fold_params(wide, ["f"], {"a": ("a", "fold_a")}).count() == 0


def test_a_pair_is_no_row_of_its_own(spark):
    """Each report was a row for each of 21 pairs and five features before anything was counted."""
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    from rankloom.plans import base, group_stats, scored

    seen = []
    real = V.counted
    try:
        V.counted = lambda wide, *a: (seen.append(wide.count()), real(wide, *a))[1]
        group_stats.pairwise_unique_stats(spark, "/root/testdata/sf0.001").count()
        scored.delta_weights(spark, "/root/testdata/sf0.001").count()
    finally:
        V.counted = real
    assert seen == [base.features(spark, "/root/testdata/sf0.001").count()] * 2


def test_models_of_all_rows_need_no_folds(spark, monkeypatch):
    """Weights of the models of all rows are those that folds give, without a sort of all bugs by fold, and lines are read once for flags and features."""
    from rankloom.plans import scored as X

    sf = "/root/testdata/sf0.001"
    want = {(r.task, r.feature): r.delta for r in X._params(X._tables(spark, sf)).filter("model = -1").collect()}

    def sorted_(*a, **k):
        raise AssertionError("folds aren't needed")

    read, table = [], X.table
    monkeypatch.setattr(X.Z, "folds_of_tasks", sorted_)
    monkeypatch.setattr(X, "table", lambda s, d, name: read.append(name) or table(s, d, name))
    monkeypatch.setattr(X, "features", sorted_)
    cells = {r.feature: r.asDict() for r in X.heatmap_matrix(spark, sf).collect()}
    assert {(t, f) for t, f in want} == {(t, f) for f in cells for t in X.TASKS} and len(want) == 20
    for (t, f), d in want.items():
        cell = cells[f]["task_any" if t == "any" else t]
        assert cell is None if abs(d) < 0.005 else abs(cell - d) <= 1e-6
    assert sorted(read) == ["lineitem", "orders"] and X.heatmap_order(spark, sf).count() > 0
