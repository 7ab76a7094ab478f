"""Policies that send all reports one way, and the energy of routes, against plain Python."""

import random

import pytest

from rankloom.operators import routing as G


def test_baselines(spark):
    rows = [(1, 1, 3), (2, None, 7), (3, 0, 5), (4, 4, None)]
    d = spark.createDataFrame(rows, "bug int, rank_A int, rank_B int")
    got = {r.name: r for r in G.baselines(d, {"A": "rank_A", "B": "rank_B"}).collect()}
    assert (got["A"].n, got["A"].hr_1, got["A"].hr_5, got["A"].hr_10) == (4, 0.25, 0.5, 0.5)
    assert (got["B"].hr_1, got["B"].hr_5, got["B"].hr_10) == (0.0, 0.5, 0.75)
    assert got["A"].mrr == pytest.approx((1 + 0.25) / 4) and got["A"].map == pytest.approx((1 + 0.25) / 2)


def test_energy_of_routes_against_plain_python(spark):
    rng = random.Random(6)
    one = [(rng.randrange(30), rng.random(), rng.random()) for _ in range(50)] + [(99, 5.0, 5.0), (None, 7.0, 7.0)]
    three = [(rng.randrange(20), rng.random() * 9, rng.random()) for _ in range(40)]
    two = [(3.0, 1.0), (6.0, None)]
    bugs = list(range(40))
    routes = [(b, s, rng.choice([1, 2, 3])) for b in bugs for s in ("x", "y")] + [(b, "none", 1) for b in bugs] + [(b, "all", 3) for b in bugs]
    df = lambda rows, s: spark.createDataFrame(rows, s)
    costs = G.with_energy(df([(b,) for b in bugs], "bug int"), "bug", df(one, "bug int, kwh double, co2 double"), df(two, "kwh double, co2 double"), df(three, "bug int, kwh double, co2 double"), ["kwh", "co2"])
    got = {r.split: r for r in G.energy_of_routes(df(routes, "bug int, split string, tier int").join(costs, "bug"), ["split"], ["kwh", "co2"]).collect()}
    for i, a in ((1, "kwh"), (2, "co2")):
        total = lambda log, i=i: {b: sum(r[i] for r in log if r[0] == b) for b in {r[0] for r in log} - {None}}
        t1, t3 = total(one), total(three)
        m1, m3 = sum(t1.values()) / len(t1), sum(t3.values()) / len(t3)
        e2 = sum(r[i - 1] or 0 for r in two) / len(bugs)
        for s in ("x", "y", "none", "all"):
            mine = [(b, t) for b, x, t in routes if x == s]
            want = sum(t1.get(b, m1) + e2 * (t > 1) + t3.get(b, m3) * (t == 3) for b, t in mine) / len(mine)
            assert got[s][a] == pytest.approx(want) and got[s][f"{a}_saved_pct"] == pytest.approx(100 * (1 - want / (m1 + e2 + m3)))
    assert got["none"].escalated == 0 and got["all"].escalated == 1


def test_energy_without_logs(spark):
    none = spark.createDataFrame([], "bug int, kwh double")
    d = G.with_energy(spark.createDataFrame([(1,), (2,)], "bug int"), "bug", none, none.drop("bug"), none, ["kwh"])
    assert [tuple(r) for r in d.orderBy("bug").collect()] == [(1, 0.0, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0)]
    r = G.energy_of_routes(d.withColumn("tier", d.bug), [], ["kwh"]).first()
    assert (r.n, r.kwh, r.kwh_saved_pct) == (2, 0.0, None)


def test_splits_are_dealt_without_a_row_for_each(spark):
    """Reports placed before they are routed get the tiers that plain Python deals in each split."""
    rng = random.Random(3)
    rows = [(k, k % 2, rng.random()) for k in range(300)] + [(7, 1, 0.5), (None, 0, 0.25)]
    d = spark.createDataFrame(rows, "k bigint, model int, score double")
    cuts = spark.createDataFrame([(m, s, h, w) for m in (0, 1) for s, h, w in (("a", 0.7, 0.2), ("b", float("-inf"), float("-inf")), ("c", 0.5, 0.5))], "model int, split string, high double, low double")
    got = {}
    for r in G.deal(G.route(G.placed(d, ["model"], "k", prefixes=16), cuts, ["model"]), G.sizes(G.route(d, cuts, ["model"]), ["model", "split"]), ["model", "split"]).collect():
        got.setdefault((r.model, r.split), []).append((r.k is None, r.k or 0, r.tier, r.random_tier))
    for (m, s), mine in got.items():
        high, low = {"a": (0.7, 0.2), "b": (float("-inf"), float("-inf")), "c": (0.5, 0.5)}[s]
        own = [(k, 1 if x >= high else 3 if x < low else 2) for k, g, x in rows if g == m]
        assert sorted(x[:3] for x in mine) == sorted((k is None, k or 0, t) for k, t in own)
        n1, n2 = (sum(t == i for _, t in own) for i in (1, 2))
        order = sorted(k for k, _ in own if k is not None)
        order.sort(key=lambda k: (k + 7) * 2654435761 % 4294967296)
        want = [(k, 1 if i < n1 else 2 if i < n1 + n2 else 3) for i, k in enumerate(order)]
        if m == 1:  # the one without a key has no hash, and its place is its prefix's
            assert sorted((k, t) for _, k, _, t in mine) == sorted(want)
        assert sorted(t for *_, t in mine) == sorted(t for _, t in own)
    assert set(got) == {(m, s) for m in (0, 1) for s in "abc"}


def test_routing_holds_a_bug_once(spark):
    import os

    from rankloom.plans import scored

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    own, cuts = scored._routed(spark, "/root/testdata/sf0.001")
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").join(spark.read.parquet("/root/testdata/sf0.001/orders.parquet").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").select("l_orderkey").distinct().count()
    assert own.count() == own.select("bug").distinct().count() == n and cuts.count() == 5 * len(scored.SPLITS)
    best = {r.bug: tuple(r)[1:] for r in scored._best(spark, "/root/testdata/sf0.001").collect()}
    assert all(best[r.bug] == (r.best_1, r.best_2, r.best_3) for r in own.collect())
