"""Hand-checked statistics and properties of rank statistics."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rankloom.functions import tails
from rankloom.operators import stats as S

X, Y = [1, 2, 2, 3, 4, 5, 6, 7, 8, 9], [0, 1, 1, 2, 2, 3, 3, 4, 4, 5]


def groups(spark, x, y):
    rows = [("f", float(v), True) for v in x] + [("f", float(v), False) for v in y]
    return spark.createDataFrame(rows, "feature string, value double, is_first boolean")


def test_mann_whitney_and_delta(spark):
    r = S.with_p(S.two_groups(groups(spark, X, Y), ["feature"])).first()
    assert r.u == 73.5 and abs(r.delta - 0.47) < 1e-12 and abs(r.z - 1.753868) < 1e-6
    assert abs(r.p_value - 0.0794532) < 1e-6 and r.effect_size == "medium"


def test_ranks_and_quantiles_over_ranges(spark):
    random.seed(3)
    rows = [(g, random.choice([None, float(random.randint(0, 30)), random.gauss(0, 1e3), float("nan")]), random.random() < 0.5) for g in ("a", "b", None) for _ in range(400)]
    rows += [("one", 1.0, True), ("same", 2.0, True), ("same", 2.0, False)]
    d = spark.createDataFrame(rows, "g string, v double, p boolean")
    groups = {g: sorted(v for h, v, _ in rows if h == g and v is not None and v == v) for g in ("a", "b", None, "one", "same")}
    whole = {(r.g, r.v): r for r in S.value_ranks(d.filter("v is not null and not isnan(v)"), ["g"], "v", {"hits": F.col("p").cast("int")}).collect()}
    for g, vs in groups.items():
        for v in set(vs):
            r = whole[g, v]
            assert (r.c, r.before_c, r.all_c) == (vs.count(v), sum(x < v for x in vs), len(vs)) and r.avg_rank == r.before_c + (r.c + 1) / 2
            assert r.before_hits == sum(1 for h, x, p in rows if h == g and x is not None and x < v and p)
    got = {r.g: r for r in S.quantiles(d, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 1.0, "t": 1 / 3}).collect()}
    for g, vs in groups.items():
        for name, q in (("a", 0.1), ("m", 0.5), ("z", 1.0), ("t", 1 / 3)):
            at = (len(vs) - 1) * q
            want = vs[int(at)] + (at - int(at)) * (vs[min(len(vs) - 1, int(at) + 1)] - vs[int(at)])
            assert getattr(got[g], name) == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert "Window [" in (plan := S.two_groups(d, ["g"], "v", "p")._jdf.queryExecution().toString()) and "percentile(" not in plan


def test_delta_is_antisymmetric_and_pairwise(spark):
    random.seed(4)
    for _ in range(3):
        x, y = ([random.randint(0, 6) for _ in range(random.randint(1, 12))] for _ in range(2))
        pairs = sum((a > b) - (a < b) for a in x for b in y) / (len(x) * len(y))
        d, e = S.two_groups(groups(spark, x, y), ["feature"]).first().delta, S.two_groups(groups(spark, y, x), ["feature"]).first().delta
        assert abs(d - pairs) < 1e-12 and abs(d + e) < 1e-12


def test_one_sided_nan_and_constant(spark):
    r = S.two_groups(groups(spark, [1, float("nan")], []), ["feature"], empty=0.0).first()
    assert (r.n1, r.n2, r.u, r.delta) == (1, 0, None, 0.0)
    c = S.with_p(S.two_groups(groups(spark, [2, 2], [2, 2]), ["feature"])).first()
    assert c.delta == 0 and c.z is None and c.p_value == 1.0


def test_holm(spark):
    d = spark.createDataFrame([("a", 0.01), ("a", 0.04), ("a", 0.03), ("a", 0.005), ("a", None)], "g string, p_value double")
    got = {r.p_value: r.pval_adj for r in S.holm(d, ["g"]).collect()}
    assert [round(got[p], 9) for p in (0.01, 0.04, 0.03, 0.005)] == [0.03, 0.06, 0.06, 0.02] and got[None] is None


def test_spearman(spark):
    d = spark.createDataFrame([(1, a, b) for a, b in zip((1, 2, 2, 4, 5), (2, 1, 3, 3, 5))], "g int, x int, y int")
    assert abs(S.spearman(d, ["g"], "x", "y").first().rho - 0.763158) < 1e-6
    flat = spark.createDataFrame([(1, 1, b) for b in range(4)], "g int, x int, y int")
    assert S.spearman(flat, ["g"], "x", "y", p=True).first().rho is None


def test_auc_and_f1(spark):
    d = spark.createDataFrame([(1, s, y) for s, y in zip((0.9, 0.8, 0.8, 0.6, 0.4, 0.1), (1, 1, 0, 1, 0, 0))], "g int, s double, y int")
    assert abs(S.auc(d, ["g"], "s", "y").first().auc - 0.833333) < 1e-6
    assert abs(S.best_f1(d, ["g"], "s", "y").first().best_f1 - 0.857143) < 1e-6


def test_exact_p_of_a_small_group_against_a_large_one():
    import math

    import pandas as pd

    p = tails.mann_whitney_p.func(pd.Series([5.0 * 501, 0.0]), pd.Series([5.0, 8.0]), pd.Series([501.0, 20000.0]), pd.Series([0.0, 0.0]))
    assert p[0] == pytest.approx(2 / math.comb(506, 5), rel=1e-12) and p[1] == pytest.approx(2 / math.comb(20008, 8), rel=1e-12)


def test_exact_u_and_t_tails():
    assert abs(tails.exact_u_p(0, 3, 3) - 0.1) < 1e-12 and tails.exact_u_p(4, 3, 3) == pytest.approx(1.0)
    assert abs(tails.t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(tails.normal_sf(1.959963985) - 0.025) < 1e-9


def test_verdicts(spark):
    rows = [(0.01, None, 1.0, 1.0), (0.2, 0.01, 1.0, 1.0), (0.01, 0.01, 1.0, 0.9), (0.01, 0.01, 1.0, 0.5), (0.01, 0.01, 1.0, -1.0), (0.01, 0.5, 1.0, 0.1)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in d.select(S.verdict(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == ["model_failed", "not_significant_raw", "survives", "attenuated_but_significant", "sign_flip", "vanishes_after_adjustment"]


def test_tertiles_with_equal_edges(spark):
    d = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "v double")
    assert {r.band for r in S.tertiles(d, [], "v").collect()} == {None}
    e = spark.createDataFrame([(float(i),) for i in range(9)], "v double")
    assert sorted(r.band for r in S.tertiles(e, [], "v").collect()) == [1] * 3 + [2] * 3 + [3] * 3


def test_fits_agree_with_a_general_solver(spark):
    import math

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    from rankloom.operators import logits

    rng = random.Random(11)
    rows, jobs = [], {}
    for i in range(300):
        s = rng.gauss(0, 3)
        f = {"near": s + rng.gauss(0, 1), "own": rng.gauss(5, 2), "steep": rng.gauss(0, 1), "noise": rng.random()}
        y = int(rng.random() < 1 / (1 + math.exp(-(0.4 * s + 0.3 * (f["own"] - 5) + 3 * f["steep"]))))
        rows += [(k, v if rng.random() > 0.05 else None, s, y) for k, v in f.items()]
        rows += [("parted", float(y) + rng.random() / 2, s, y), ("flat", 1.0, s, y), ("one", s, s, 1)]
    rows += [("few", rng.random(), rng.random(), k % 2) for k in range(29)]
    long = spark.createDataFrame(rows, "feature string, value double, scale double, y int")
    sc = spark.sparkContext
    sc.setJobGroup("fits", "")
    got = {r.feature: r for r in logits.confound_fits(long).collect()}
    jobs = len(sc.statusTracker().getJobIdsForGroup("fits"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == {"near", "own", "steep", "noise", "parted", "flat"}
    assert got["parted"].raw_coef is None and got["flat"].raw_coef is None and got["parted"].verdict == "model_failed"
    for f in ("near", "own", "steep", "noise"):
        d = long.filter((F.col("feature") == f) & F.col("value").isNotNull())
        m = d.agg(*[e(c) for c in ("value", "scale") for e in (F.avg, F.stddev_pop)]).first()
        d = d.select(((F.col("value") - m[0]) / m[1]).alias("a"), ((F.col("scale") - m[2]) / m[3]).alias("b"), F.col("y").cast("double").alias("y"))
        for cols, coef, p in ((["a"], got[f].raw_coef, got[f].raw_p), (["a", "b"], got[f].adj_coef, got[f].adj_p)):
            fit = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="x", labelCol="y", tol=1e-12, maxIter=100).fit(VectorAssembler(inputCols=cols, outputCol="x").transform(d))
            assert coef == pytest.approx(fit.coefficients[0], rel=1e-6, abs=1e-9) and p == pytest.approx(fit.summary.pValues[0], rel=1e-4, abs=1e-9)
        assert got[f].n == d.count() and got[f].attenuation == pytest.approx(1 - got[f].adj_coef / got[f].raw_coef)
    assert jobs <= 40  # Spark counts a job for each stage of a broadcast, too; the actions are at most 11


def test_densities_and_boxes(spark):
    import math
    import statistics

    from rankloom.operators import figures

    rng = random.Random(13)
    rows = [("a", rng.gauss(5, 1)) for _ in range(500)] + [("b", 3.0)] * 4 + [("b", 50.0), ("c", None), (None, 1.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {}
    for r in figures.density(d, ["g"], "v", 0, 10, 50).collect():
        got.setdefault(r.g, {})[round(r.at, 6)] = r.density
    assert set(got) == {"a", "b", None} and all(len(x) == 50 for x in got.values())
    assert abs(sum(got["a"].values()) * 0.2 - 1) < 0.01 and max(got["a"], key=got["a"].get) == pytest.approx(5, abs=0.6)
    h = max(statistics.stdev([3.0] * 4 + [50.0]) / 5**0.2, 0.2)
    want = sum(math.exp(-(((4.1 - m) / h) ** 2) / 2) for m in [3.1] * 4 + [9.9]) / 5 / h / math.sqrt(2 * math.pi)
    assert got["b"][4.1] == pytest.approx(want)
    box = {r.g: r for r in figures.boxes(d, ["g"], "v").collect()}
    assert tuple(box["b"])[1:] == (5, 3.0, 3.0, 3.0, 3.0, 3.0, 1) and tuple(box[None])[1:] == (1, 1.0, 1.0, 1.0, 1.0, 1.0, 0) and "c" not in box


def test_best_of_category(spark):
    rows = [("t", "a1", 0.1), ("t", "a2", -0.4), ("t", "a3", 0.4), ("t", "b1", 0.01), ("u", "a1", None), ("u", "b1", -0.3), (None, "a1", 0.2)]
    d = spark.createDataFrame(rows, "tool string, feature string, delta double")
    got = S.best_of_category(d, ["tool"], F.substring("feature", 1, 1), F.abs("delta") >= 0.05)
    assert {(r.tool, r.category): (r.feature, r.delta) for r in got.collect()} == {("t", "a"): ("a2", -0.4), ("u", "b"): ("b1", -0.3), (None, "a"): ("a1", 0.2)}


def test_feature_report_keeps_what_is_not_tested(spark):
    long = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0)], "feature string, value double")
    tests = spark.createDataFrame([("a", 7, 0.5), ("z", 1, 0.1)], "feature string, n int, delta double")
    r = {x.feature: x for x in S.feature_report(long, tests, F.lit("c")).collect()}
    assert set(r) == {"a", "b"} and (r["a"].n, r["a"].median, r["a"].test_n, r["a"].delta) == (2, 2.0, 7, 0.5)
    assert (r["b"].category, r["b"].std, r["b"].delta) == ("c", None, None)


def test_independence_against_plain_counts(spark):
    import math

    rng = random.Random(3)
    rows = [(g, rng.choice("AB"), rng.choice("xyz")) for g in "pq" for _ in range(80)] + [("q", None, "x"), ("one", "A", "x"), ("two", "A", "x"), ("two", "B", "y"), ("gap", "A", "x"), ("gap", "A", "y"), ("gap", "B", "z")]
    got = {r.g: r for r in S.independence(spark.createDataFrame(rows, "g string, a string, b string"), ["g"], "a", "b").collect()}
    for g, r in got.items():
        mine = [(a, b) for x, a, b in rows if x == g and a]
        n, A, B = len(mine), {a for a, _ in mine}, {b for _, b in mine}
        e = {(a, b): sum(x == a for x, _ in mine) * sum(y == b for _, y in mine) / n for a in A for b in B}
        chi = sum((mine.count(c) - v) ** 2 / v for c, v in e.items())
        assert r.n == n and abs(r.chi2 - chi) < 1e-9 and r.df == (len(A) - 1) * (len(B) - 1)
        assert r.p_value is None if r.df != 2 else abs(r.p_value - math.exp(-chi / 2)) < 1e-9


def test_ranges_come_from_one_sketch(spark, monkeypatch):
    """Were the sketch computed by each reader, it could differ between them: here it does, as each reading jolts the cuts."""
    once = S.F.percentile_approx
    jolt = S.F.udf(lambda xs: [x + random.Random(time.time_ns()).uniform(-40, 40) for x in xs], "array<double>").asNondeterministic()
    monkeypatch.setattr(S.F, "percentile_approx", lambda v, q, n: S.F.array_sort(jolt(once(v, q, n))))
    rng = random.Random(5)
    rows = [(g, float(rng.randrange(300))) for g in "ab" for _ in range(2000)]
    got = {(r.g, r.v): r for r in S.value_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {}).collect()}
    for g, v in set(rows):
        below, same = sum(x == g and w < v for x, w in rows), rows.count((g, v))
        assert (got[g, v].before_c, got[g, v].c, got[g, v].avg_rank) == (below, same, below + (same + 1) / 2)


@pytest.mark.parametrize("ranges", [4, 17, 64])
def test_place_among_cuts(spark, monkeypatch, ranges):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        d = spark.range(1000).selectExpr("cast(id % 331 as double) v", "1 g")
        got = S.value_ranks(d, ["g"], "v", {}, ranges_too=True).orderBy("v").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    places = [r._range for r in got]
    assert places == sorted(places) and places[0] == 0 and len(set(places)) == places[-1] + 1 == ranges
    assert [r.before_c for r in got] == [sum(x.c for x in got[:i]) for i in range(len(got))]
