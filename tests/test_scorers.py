"""Stored scorers: versions, checks on reading, scores and their evaluation."""

import glob
import math
import os
import random

import pytest

from rankloom.operators import scorers as K

PARAMS = [("any", "a", 0.5, 1.0, 2.0), ("any", "b", -0.25, 0.0, 1.0), ("any", "gone", 0.9, 0.0, 1.0), ("any", "odd.name", 0.0, 0.0, 1.0), ("all", "a", None, 1.0, 2.0)]
SQL_SCHEMA = "task string, feature string, delta double, mu double, sd double"


def test_versions_in_a_fresh_session(spark, tmp_path):
    root = str(tmp_path / "s")
    K.store(spark.createDataFrame(PARAMS, SQL_SCHEMA), root, 1)
    K.store(spark.createDataFrame([("any", "a", 1.0, 0.0, 1.0)], SQL_SCHEMA), root, 10)
    with pytest.raises(Exception, match="(?i)exist"):
        K.store(spark.createDataFrame(PARAMS, SQL_SCHEMA), root, 10)
    fresh = spark.newSession()
    assert K.load(fresh, root) == [("any", "a", 1.0, 0.0, 1.0)]
    assert K.load(fresh, root, 1) == sorted(PARAMS, key=lambda r: r[:2])
    assert len(glob.glob(f"{root}/version=1/*.parquet")) == 1
    with pytest.raises(ValueError, match="no version 2"):
        K.load(fresh, root, 2)


@pytest.mark.parametrize("rows, schema", [
    ([("any", "a", 1.0, 0.0)], "task string, feature string, delta double, mu double"),
    ([("any", "a", "1", 0.0, 1.0)], SQL_SCHEMA.replace("delta double", "delta string")),
    ([("any", "a", 1.0, 0.0, 0.0)], SQL_SCHEMA),
    ([("any", None, 1.0, 0.0, 1.0)], SQL_SCHEMA),
    ([("any", "a", 1.0, 0.0, 1.0)] * 2, SQL_SCHEMA),
])
def test_broken_tables_are_errors(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "version=3"))
    with pytest.raises(ValueError):
        K.load(spark, str(tmp_path))


def test_scores_and_auc_against_plain_python(spark):
    rng = random.Random(2)
    rows = [(i if i else None, rng.choice([None, math.nan, 1.0, 2.0, 5.5]), rng.choice([None, 3, 4]), 1.0) for i in range(60)] + [(7, 2.0, 3, 1.0)]
    got = K.scores(spark.createDataFrame(rows, "bug int, a double, b int, `odd.name` double"), PARAMS, ["bug"])
    assert got.columns == ["bug", "score_any", "score_all"]
    ok = lambda v: v is not None and not math.isnan(v)
    want = [(k, (0.5 * (a - 1) / 2 if ok(a) else 0.0) + (-0.25 * b if ok(b) else 0.0), 0.0) for k, a, b, _ in rows]
    assert all(x[0] == y[0] and abs(x[1] - y[1]) < 1e-12 and x[2] == y[2] for x, y in zip(map(tuple, got.collect()), want, strict=True))
    truth = {k: rng.choice([0, 1, None]) for k, *_ in rows}
    t = spark.createDataFrame([(k, y, 1) for k, y in truth.items()], "bug int, `any` int, `all` int")
    r = {x.task: x for x in K.evaluate(got, t, ["bug"], ["any", "all", "T9"]).collect()}
    pos, neg = [s for k, s, _ in want if truth[k] == 1], [s for k, s, _ in want if truth[k] != 1]
    assert set(r) == {"any", "all"} and (r["any"].n_pos, r["any"].n_neg, r["all"].auc) == (len(pos), len(neg), None)
    assert r["any"].auc == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_stored_scores_agree_with_sql(spark):
    import duckdb

    import __spark_entry__ as e
    from rankloom.plans.stored_scorers import SCORES_SQL

    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    want = {(b, t): s for b, t, s in con.execute(SCORES_SQL + " SELECT bug, task, score FROM sc").fetchall()}
    got = {(r.bug, c[6:]): r[c] for r in e.queries()["stored_scorer_scores"](spark, "/root/testdata/sf0.001").collect() for c in r.asDict() if c != "bug"}
    assert set(want) <= set(got) and all(abs(got[k] - v) < 2e-6 for k, v in want.items()) and all(got[k] == 0 for k in set(got) - set(want))
