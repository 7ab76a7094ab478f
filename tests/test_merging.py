"""Wide outcomes, chains of left joins and vocabularies from the data, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom import schema as C
from rankloom.operators import merging as M
from rankloom.operators import reshape as P


def test_wide_metrics_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(b, t, rng.choice([None, 0, -1, 1, 2, 5, 6])) for b in range(40) for t in "ABZ" for _ in range(rng.choice([0, 1, 3]))]
    got = {r.bug: r for r in M.wide_metrics(spark.createDataFrame(rows, "bug int, tool string, rank int"), ["bug"], ["A", "B"]).collect()}
    assert set(got) == {b for b, _, _ in rows}
    for b, r in got.items():
        for t in "AB":
            mine = [k for x, y, k in rows if (x, y) == (b, t)]
            found = [k for k in mine if k and k > 0]
            want = (min(found, default=None), None if not mine else max((1 / k for k in found), default=0.0), None if not mine else int(1 in found), None if not mine else int(any(k <= 5 for k in found)))
            assert (r[f"rank_{t}"], r[f"mrr_{t}"], r[f"top_1_{t}"], r[f"top_5_{t}"]) == want


def test_wide_metrics_of_nothing(spark):
    d = M.wide_metrics(spark.createDataFrame([], "bug int, tool string, rank int, extra string"), ["bug"], ["A"], map_="rank")
    assert d.columns == ["bug", "rank_A", "mrr_A", "top_1_A", "top_5_A"] and d.count() == 0


def test_merge_chain(spark):
    base = spark.createDataFrame([("p", 1, 1.0), ("p", 2, 2.0), ("q", None, 3.0)], "project string, bug_id int, size double")
    r = spark.createDataFrame([("p", 1, 9.0, "x", 7), ("p", 1, 8.0, "y", 7)], "project string, bug_id int, size double, note string, description_length int")
    c = spark.createDataFrame([("p", 2, "UI", "n")], "project string, bug_id int, category string, note string")
    b = spark.createDataFrame([("q", 5)], "project string, n int")
    seen = []
    out = M.merge_sources(base, [M.Source(r, ["project", "bug_id"], "_ratings", ("description_length",)), M.Source(c, ["project", "bug_id"], "_categ", after=lambda d: (seen.extend(d.columns), d.withColumn("is_ui", F.col("category") == "UI"))[1]), M.Source(b, ["project"], "_bee")])
    assert "size_ratings" in seen and "note_categ" in seen
    assert out.columns == ["project", "bug_id", "size", "note", "category", "is_ui", "n"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [("p", 1, 1.0, "x", None, None, None), ("p", 1, 1.0, "y", None, None, None), ("p", 2, 2.0, None, "UI", True, None), ("q", None, 3.0, None, None, None, 5)]))


def test_suffixes_on_both_sides(spark):
    a, b = spark.createDataFrame([(1, "x", 3)], "k int, v string, `a.b` int"), spark.createDataFrame([(1, "y", 4)], "k int, v string, `a.b` int")
    d = C.join_suffixed(a, b, ["k"], "_new", "inner", "_old")
    assert d.columns == ["k", "v_old", "a.b_old", "v_new", "a.b_new"] and tuple(d.first()) == (1, "x", 3, "y", 4)
    assert C.join_suffixed(a, b, ["k"], "_new").columns == ["k", "v", "a.b", "v_new", "a.b_new"]


def test_one_hot_of_the_data(spark):
    vals = ["a"] * 3 + [" a "] + ["b"] * 2 + ["", None, "  "]
    d = P.one_hot_from(spark.createDataFrame([(v,) for v in vals], "c string"), "c", "c", 3)
    assert d.columns == ["c", "c_a", "c___missing__", "c___other__", "c_is_missing"]
    assert {r.column: r.n for r in P.column_sums(d, d.columns[1:]).collect()} == {"c_a": 4, "c___missing__": 3, "c___other__": 2, "c_is_missing": 3}
    plain = P.one_hot_from(spark.createDataFrame([("a",)], "c string"), "c", "c", 1)
    assert plain.columns == ["c", "c_a", "c_is_missing"] and tuple(plain.first()) == ("a", 1, 0)
    none = P.one_hot_from(spark.createDataFrame([("a",)], "c string"), "c", "c", 2)
    assert none.columns == ["c", "c___other__", "c_is_missing"]
    assert P.one_hot_from(spark.createDataFrame([], "c string"), "c", "c", 1).columns == ["c", "c_is_missing"]


def test_multi_hot_of_the_data(spark):
    rows = [(["log in", "log!in", "x"],), (["log in", "log in"],), ([None],), (None,), (["once"],)]
    d = P.multi_hot_from(spark.createDataFrame(rows, "xs array<string>"), "xs", "w", 1)
    assert d.columns == ["xs", "w_num_concepts", "w_is_missing", "w__log_in", "w__once", "w__x"]
    assert [tuple(r)[1:] for r in d.collect()] == [(3, 0, 1, 0, 1), (2, 0, 1, 0, 0), (0, 1, 0, 0, 0), (0, 1, 0, 0, 0), (1, 0, 0, 1, 0)]


def test_too_many_columns_are_an_error(spark):
    d = spark.range(12).select(F.col("id").cast("string").alias("c"))
    assert len(P.columns_of(d, "c", 1, 12)) == 12
    with pytest.raises(ValueError):
        P.columns_of(d, "c", 1, 11)


def test_map_within(spark):
    d = spark.createDataFrame([(1, 0.4), (5, 0.3), (6, 0.9), (0, 0.9), (None, 0.9)], "rank int, map double")
    assert [r[0] for r in d.select(M.map_within("rank", 5, d.columns)).collect()] == [0.4, 0.3, 0.0, 0.0, 0.0]
    assert [r[0] for r in d.select(M.map_within("rank", 5, ["rank"])).collect()] == [1.0, 0.2, 0.0, 0.0, 0.0]


def test_rating_specs(spark):
    d = spark.createDataFrame([(2, 3, 4, 1, True), (None, 3, 4, 1, False)], "actionability int, clarity int, technical_depth int, causal_reasoning_quality int, has_code boolean")
    r = P.rating_interactions(d).collect()
    assert (r[0].actionability_depth_product, r[0].quality_composite, r[0].reasoning_composite) == (8.0, 2.5, 1 / 7) and r[0].actionability_depth_ratio == pytest.approx(2 / 4.1)
    assert r[1].actionability_depth_product is None and r[1].quality_composite == 3.0 and "clarity_specificity_gap" not in r[0]
    assert P.rating_interactions(d.select("actionability", "clarity")).columns == ["actionability", "clarity"]
    c = P.consistency(d).collect()
    assert c[0].technical_depth_consistency == pytest.approx(1 - abs(1 / 3 - 0.8)) == c[0].consistency_composite and c[1].technical_depth_consistency == pytest.approx(0.2)
    assert "causal_reasoning_consistency" not in c[0] and P.consistency(d.select("clarity")).columns == ["clarity"]
