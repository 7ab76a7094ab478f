"""How scores are put together: what meets where, and weights against a row for each model."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import scoring as Z

LONG = "task string, bug int, feature string, value double, y int, fold int"


def test_params_are_broadcast(spark):
    """A join by (task, model, feature) would send all rows of a feature to one task."""
    rows = spark.createDataFrame([("a", 1, "f", 2.0, 1, 0)], LONG).withColumn("model", F.col("fold"))
    params = spark.createDataFrame([("a", 0, "f", 0.5, 1.0, 2.0)], "task string, model int, feature string, delta double, mu double, sd double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = Z.delta_scores(rows, params, ["bug"], ["task", "model"])
        assert "BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()
        assert [tuple(r) for r in d.collect()] == [(1, "a", 0, 0.25)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_value_meets_once_and_no_window_sees_it(spark):
    """Weights of all models from one small row for each range: every value's row went through windows over eleven sums before."""
    rng = random.Random(3)
    rows = [("ab"[i % 2], i, f, rng.choice([rng.random(), float(rng.randrange(4)), -0.0]), int(rng.random() < 0.3), rng.randrange(5)) for i in range(600) for f in ("f", "g")]
    d = spark.createDataFrame(rows, LONG).repartition(7)
    p = Z.fold_params(d, ["task"])
    assert "Window" not in p._jdf.queryExecution().executedPlan().toString()
    got = {(r.task, r.model, r.feature): r.delta for r in p.collect()}
    for t, m, f in got:
        mine = [r for r in rows if (r[0], r[2]) == (t, f) and r[5] != m]
        ones, rest = [r[3] for r in mine if r[4]], [r[3] for r in mine if not r[4]]
        assert got[t, m, f] == pytest.approx(sum((x > y) - (x < y) for x in ones for y in rest) / len(ones) / len(rest), abs=1e-12)
    assert len(got) == 2 * 6 * 2


def test_the_summary_has_a_task_for_every_tool(spark):
    import os

    from rankloom.plans import catalog

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    got = catalog.queries()["cv_auc_summary"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.task for r in got) == sorted(["any", *(f"T{i}" for i in range(1, 8))])
