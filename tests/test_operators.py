"""Hand-checked ranking, rating, shaping, scoring and routing operators, sources and resuming."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom import schema as C
from rankloom.operators import ranking as R
from rankloom.operators import ratings as J
from rankloom.operators import redundancy as R2
from rankloom.operators import reshape as P
from rankloom.operators import routing as G
from rankloom.operators import scoring as Z
from rankloom.sources import reports, tables
from rankloom.streaming import resume


def test_map_at_k(spark):
    truth = spark.createDataFrame([("b", "X.java"), ("b", "src/b/Y.java")], "bug string, gt_file string")
    pred = spark.createDataFrame([("b", "t", "a/X.java", 1), ("b", "t", "z/Q.java", 2), ("b", "t", "b/Y.java", 3), ("c", "t", "X.java", 1)], "bug string, tool string, file string, rank int")
    r = R.map_at_k(pred, truth, ["bug"], [1, 5, 10]).collect()
    assert len(r) == 1
    assert (r[0].best_rank, r[0].mrr_1, r[0].mrr_5, r[0].map_1) == (1, 1.0, 1.0, 0.5) and abs(r[0].map_5 - 0.833333) < 1e-6


def _ranks(spark):
    rows = [(1, "A", 1), (1, "B", 3), (1, "C", 5), (2, "A", 6), (2, "C", 9), (3, "A", 2), (3, "B", 8), (4, "A", None)]
    return spark.createDataFrame(rows, "bug int, tool string, rank int")


def test_membership(spark):
    f = R.membership(R.success_flags(_ranks(spark), "bug", ["A", "B", "C"], 5), ["A", "B", "C"])
    assert {r.bug: (r.members, r.num_found) for r in f.collect()} == {1: ("A,B,C", 3), 2: ("", 0), 3: ("A", 1), 4: ("", 0)}
    sizes = {r.name: r.n for r in R.set_sizes(f, ["A", "B", "C"]).collect()}
    assert (sizes["none"], sizes["all"], sizes["only_A"], sizes["exactly_one"], sizes["any"]) == (2, 1, 1, 1, 2)


def test_success_falls_back(spark):
    d = spark.createDataFrame([(0.25, "yes")], "mrr double, detected string")
    assert d.select(R.success(["mrr", "detected"], 5)).first()[0] is True
    assert d.select(R.success(["mrr", "detected"], 3)).first()[0] is False
    assert d.select(R.success(["detected"], 3)).first()[0] is True
    assert d.select(R.success([], 3)).first()[0] is False


def test_tiers_and_cascade(spark):
    w = P.pivot_tools(_ranks(spark), ["bug"], ["A", "B", "C"], {"rank": "min"})
    t = {r.bug: (r.best_1, r.best_2, r.best_3) for r in G.tier_best_rank(w, [["A"], ["A", "B"], ["A", "B", "C"]]).collect()}
    assert t[2] == (6, 6, 6) and t[4] == (None, None, None)
    q = G.tier_best_rank(w, [["A"]]).agg(*[e.alias(n) for n, e in G.quality(F.col("best_1"), 5).items()]).first()
    assert abs(q.mrr - 0.375) < 1e-12 and abs(q.map - 0.75) < 1e-12 and q.hr == 0.5


def test_ratings(spark):
    d = spark.createDataFrame([(1, a, b) for a, b in ((1, 1), (1, 0), (0, 0), (1, 1), (0, 1))], "g int, v1 int, v2 int")
    k = J.kappa(d, ["g"]).first()
    assert abs(k.percent_agreement - 0.6) < 1e-12 and abs(k.cohens_kappa - 0.166667) < 1e-6
    p = spark.createDataFrame([(True, 0.90, False, 0.88), (True, 0.60, False, 0.90), (True, 0.5, True, 0.9)], "v1 boolean, c1 double, v2 boolean, c2 double")
    assert [(r.value, r.source) for r in J.adjudicate(p).collect()] == [(True, "both_partial"), (False, "judge2"), (True, "both")]
    counts = {"Actionability": (4, 5), "Ambiguity": (1, 5), "HiddenReproducibility": (1, 1), "RepairReadiness": (2, 5)}
    rows = [("b", dim, str(i), i < yes) for dim, (yes, n) in counts.items() for i in range(n)]
    rolled = J.roll_up(spark.createDataFrame(rows, "bug string, dimension string, item string, value boolean"), "bug")
    z = {r.dimension: round(r.z, 6) for r in rolled.collect()}
    assert z == {"Actionability": 0.96225, "Ambiguity": 0.96225, "HiddenReproducibility": -1.347151, "RepairReadiness": -0.57735}
    d = J.derived(rolled, "bug").first()
    assert d.repair_difficulty == 3 and d.hidden_s2r_present is True and d.root_cause_evidence is None


def test_judge_and_answers(spark):
    d = spark.createDataFrame([("1", "The parser fails"), ("2", None)], "bug_id string, text string")
    r = {(x.bug_id, x.item): (x.value, x.confidence) for x in J.judge("mock").evaluate(d, [("D", "i", "parser fails on input data")]).collect()}
    assert r["1", "i"] == (True, 0.745) and r["2", "i"] == (False, 0.5)  # "on" has two letters, so four words count
    with pytest.raises(NotImplementedError):
        J.judge("remote")
    a = spark.createDataFrame([('```json\n{"x": {"value": true, "confidence": 0.9, "reason": "r"}}\n```',), ("nonsense",)], "a string")
    got = [(x.item, x.value, x.confidence) for x in J.parse_answers(a, "a", ["x", "y"]).collect()]
    assert got == [("x", True, 0.9), ("y", False, 0.0), ("x", False, 0.0), ("y", False, 0.0)]


def test_keys_and_names(spark):
    d = spark.createDataFrame([("Chart-1",), ("JacksonDatabind-12",), ("Foo",)], "id string")
    assert [tuple(r) for r in d.select(*C.split_id()).collect()] == [("Chart", 1), ("JacksonDatabind", 12), ("Foo", None)]
    e = spark.createDataFrame([("Lang", "Chart-1"), ("Lang", "7")], "project string, bug_id string")
    assert [tuple(r) for r in e.select(*C.repair_keys("project", "bug_id")).collect()] == [("Chart", 1), ("Lang", 7)]
    assert C.drop_suffixed_copies(["id", "a", "a_ratings", "b_ratings", "a_fine_grained"]) == ["id", "a", "b_ratings", "a_fine_grained"]
    assert C.without_leaks(["mrr_x", "rank_A", "ok", "z_top@1", "map"]) == ["ok"]
    assert C.tools_of(["rank_A", "rank_B_is_missing", "rank_B"], "rank") == ["A", "B"]


def test_scaling_and_filling(spark):
    d = spark.createDataFrame([(1.0, None, 3.0), (3.0, 4.0, 3.0)], "a double, b double, c double")
    s = P.standard_scale(d, ["a", "c"]).collect()
    assert sorted(r.a for r in s) == [-1.0, 1.0] and {r.c for r in s} == {0.0} and sorted(r.a__orig for r in s) == [1.0, 3.0]
    assert sorted(r.b for r in P.fill_missing(d, ["b"], []).collect()) == [4.0, 4.0]
    none = spark.createDataFrame([(None,)], "b double")
    assert P.fill_missing(none, ["b"], []).first().b == 0.0


def test_one_hot(spark):
    d = spark.createDataFrame([("x",), ("y",), (" ",), (None,)], "c string")
    r = P.one_hot(d, "c", ["x"], "c").collect()
    assert [(a.c_x, a.c__other__, a.c_is_missing) for a in r] == [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 1)]


def test_prune(spark):
    rows = [(i, float(i), float(i) * 2, float(i % 7), 1.0, None if i % 3 else float(i * i)) for i in range(40)]
    d = spark.createDataFrame(rows, "k int, a double, copy double, other double, flat double, holes double")
    d = d.withColumns({"a__orig_mean": F.col("other"), "z__orig_max": F.col("other") * F.col("a"), "z__orig_median": F.col("other") - F.col("a"), "txt_t_word_count": -F.col("other") * F.col("other") + F.col("a"), "txt_t_chars": F.col("a")})
    names = [c for c in d.columns if c != "k"]
    assert R2.prune(d, names, "k") == [("family", "a__orig_mean"), ("family", "z__orig_max"), ("length", "txt_t_chars"), ("constant", "flat"), ("duplicate", "copy"), ("duplicate", "holes"), ("correlated", "a")]
    assert R2.clusters(["a", "b", "c"], {("a", "b"): 0.97, ("a", "c"): 0.1, ("b", "c"): 0.1}) == [["a", "b"], ["c"]]
    assert R2.collapsed(["txt_a_length", "txt_b", "txt_a_avg_words_per_line", "x__orig"]) == [("length", "txt_a_avg_words_per_line")]


def test_spearman_matrix_agrees_with_pandas(spark):
    import random

    import pandas as pd

    from rankloom.operators.stats import long_form

    rng = random.Random(5)
    rows = [{"k": i, **{f"f{j}": None if j % 4 == 3 and rng.random() < 0.2 else float(rng.randint(0, 9)) + (j > 6) * rng.random() for j in range(12)}, "h": None if i % 5 == 0 else float(i % 11), "g": None if i % 5 == 0 else rng.random(), "flat": 2.0} for i in range(120)]
    names = [c for c in rows[0] if c != "k"]
    got = R2.spearman_matrix(long_form(spark.createDataFrame(pd.DataFrame(rows).astype("float64")), ["k"], names), "k").collect()
    want = pd.DataFrame(rows)[names].rank()  # checked without nulls; those with nulls are ranked by pair below
    assert len(got) == len(names) * (len(names) - 1) // 2
    for r in got:
        both = pd.DataFrame(rows)[[r.feature_a, r.feature_b]].dropna()
        rho = both.rank().corr().iloc[0, 1]
        assert r.n == len(both) and (r.rho is None if rho != rho else abs(r.rho - abs(rho)) < 1e-9)
    assert len(want) == 120


def test_linkage_against_merging_the_closest(spark):
    import random

    rng = random.Random(8)
    for n in (1, 2, 7, 25):
        names = [f"c{i:02}" for i in range(n)]
        rho = {(a, b): rng.choice([rng.random(), 0.9 + rng.random() / 10]) for i, a in enumerate(names) for b in names[i + 1 :]}
        groups = [[c] for c in names]
        while len(groups) > 1:
            gap, i, j = min((sum(1 - rho[min(a, b), max(a, b)] for a in g for b in h) / (len(g) * len(h)), i, j) for i, g in enumerate(groups) for j, h in enumerate(groups) if i < j)
            if gap > 0.3:
                break
            groups[i] = sorted(groups[i] + groups.pop(j))
        assert R2.clusters(names, rho, 0.3) == sorted(groups)


def test_random_routing_by_prefix(spark):
    d = spark.range(900).select((F.col("id") % 3).alias("g"), F.col("id").alias("k"), F.when(F.col("id") % 7 < 2, 1).when(F.col("id") % 7 < 5, 2).otherwise(3).alias("tier"))
    d = d.unionByName(d.filter("k = 5"))
    got = {}
    for r in G.random_route(d, ["g"], "k", prefixes=16).collect():
        got.setdefault(r.g, []).append((r.k, r.random_tier))
    for g, rows in got.items():
        mine = [r for r in d.collect() if r.g == g]
        order = sorted((((r.k + 7) * 2654435761) % 4294967296, r.k) for r in mine)
        n1, n2 = (sum(r.tier == t for r in mine) for t in (1, 2))
        assert sorted(rows) == sorted((k, 1 if i < n1 else 2 if i < n1 + n2 else 3) for i, (_, k) in enumerate(order))


def test_folds_partition_and_stratify(spark):
    d = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    f = Z.folds(d, "k", "y", buckets=8)
    assert f.count() == 2000
    n = {(r.y, r.fold): r["count"] for r in f.groupBy("y", "fold").count().collect()}
    assert len(n) == 10 and max(n[1, i] for i in range(5)) - min(n[1, i] for i in range(5)) <= 8
    t = Z.for_training(f, full=None)
    assert t.filter("model = fold").count() == 0 and t.count() == 8000


def test_scores_skip_missing_values(spark):
    params = spark.createDataFrame([(0, "f", 0.5, 1.0, 2.0), (0, "g", 0.0, 0.0, 1.0)], "model int, feature string, delta double, mu double, sd double")
    rows = spark.createDataFrame([(1, 0, "f", 5.0), (1, 0, "g", 9.0)], "k int, model int, feature string, value double")
    assert Z.delta_scores(rows, params, ["k"], ["model"]).first().score == 1.0


def test_random_routing_keeps_sizes(spark):
    d = spark.range(100).select(F.lit(0).alias("g"), F.col("id").alias("k"), F.when(F.col("id") < 30, 1).when(F.col("id") < 70, 2).otherwise(3).alias("tier"))
    r = {x.random_tier: x["count"] for x in G.random_route(d, ["g"], "k").groupBy("random_tier").count().collect()}
    assert r == {1: 30, 2: 40, 3: 30}


def test_xml_and_json_reports(spark, tmp_path):
    body = "<bugRepository><bug id='{}'><buginformation><summary>{}</summary><description>{}</description></buginformation><fixedFiles><file>A.java</file></fixedFiles></bug></bugRepository>"
    (tmp_path / "Chart_1.xml").write_text(body.format(1, "s &amp;lt; t", "d"))
    (tmp_path / "plain.xml").write_bytes(body.format(7, "caf\xe9\x01", "").encode("latin-1"))
    (tmp_path / "blank_2.xml").write_text(body.format(2, " ", ""))
    (tmp_path / "broken_3.xml").write_text("<bug><nothing")
    r = {x.id: x for x in reports.read_xml(spark, f"{tmp_path}/*.xml").collect()}
    assert set(r) == {"Chart-1", "plain-7"} and r["Chart-1"].title == "s < t" and r["plain-7"].title == "caf\xe9" and r["Chart-1"].files == ["A.java"]
    assert {tuple(x) for x in reports.broken_xml(spark, f"{tmp_path}/*.xml").collect()} == {("broken_3.xml", "malformed")}
    odd = tmp_path / "odd"
    odd.mkdir()
    one = "<bug id='A7' opendate='x'><buginformation><summary>{}</summary><description>{}</description></buginformation></bug>"
    (odd / "cdata_1.xml").write_text("<?xml version='1.0'?>\n<!-- <bug> -->\n" + one.format("<![CDATA[see <bug id='9'><buginformation>]]>", "é"))
    (odd / "other_2.xml").write_text("<list>" + one.format("t", "d") + "</list>")
    (odd / "cut_3.xml").write_text("<bugRepository>" + one.format("t", "d") + "<bug>")
    (odd / "two.xml").write_text("\ufeff<bugRepository>" + one.format("t", "d") + one.format("u", "") + "<bug id='z'/></bugRepository>")
    (odd / "text_4.xml").write_text("no markup")
    got = sorted((x.id, x.title, x.description, x.opendate) for x in reports.read_xml(spark, f"{odd}/*.xml").collect())
    assert got == [("cdata-1", "see <bug id='9'><buginformation>", "é", "x"), ("two-A7", "t", "d", "x"), ("two-A7", "u", "", "x")]
    assert {tuple(x) for x in reports.broken_xml(spark, f"{odd}/*.xml").collect()} == {("other_2.xml", "root"), ("cut_3.xml", "malformed"), ("text_4.xml", "malformed")}
    (tmp_path / "issues.json").write_text('[{"issue_id": "Lang-3", "title": "t", "description": "d"}]')
    assert tuple(reports.rating_input(spark, f"{tmp_path}/issues.json").first()) == ("Lang-3", "Lang", "t", "d")


def test_statements_listing_latex_and_optional(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"bug_id": "A-1", "stats": {"has_OB": true, "num_OB": 2}}\nnot json\n{"bug_id": "B-1"}\n')
    r = tables.read_statements(spark, str(tmp_path / "s.jsonl")).collect()
    assert len(r) == 1 and r[0].has_OB is True and r[0].num_OB == 2
    empty = tables.optional(lambda: tables.read_csv(spark, str(tmp_path / "none.csv"), "a int"), spark, "a int")
    assert empty.count() == 0 and empty.columns == ["a"]
    n = spark.createDataFrame([("defects4j-Chart-12.html",), ("other.txt",)], "name string")
    k = tables.keys_of_names(n, "name", tables.HTML_NAME, ("project", "bug_id")).collect()
    assert (k[0].project, k[0].bug_id, k[0].status) == ("Chart", "12", "processed") and (k[1].project, k[1].status) == (None, "skipped")
    (tmp_path / "t.tex").write_text("\\textbf{Counts} \\\\\nNum A & 1.5 & 0.5 & 0 & 3 \\\\\n\\textbf{Text}\\\\\nLen & -2 & 1 & -5 & 9 \\\\\n")
    got = [tuple(x) for x in tables.read_latex_stats(spark, str(tmp_path / "t.tex")).collect()]
    assert got == [("Counts", "Num A", 1.5, 0.5, 0.0, 3.0), ("Text", "Len", -2.0, 1.0, -5.0, 9.0)]


def test_latex_tables(spark, tmp_path):
    groups = {"Semantic Quality": 6, "Ambiguity": 2, r"Structural \& Surface": 18, "Readability": 7, r"Embedding \& Semantic": 5}
    lines = [r"\begin{table}[h]", r"\caption{Means (n=8, 5\% cut).} % a & b \\", r"\begin{tabular}{lrrrr}", r"\toprule", r"\textbf{Feature} & \textbf{Mean} & \textbf{STD} & \textbf{Min} & \textbf{Max} \\"]
    for g, n in groups.items():
        lines += [r"\midrule", rf"    \multicolumn{{5}}{{l}}{{\textit{{{g}}}}} \\"]
        lines += [rf"    Feature {i}" + r"$^\dagger$" * (i % 2) + rf" \& rest ({g[0]})  & ${i}.50$ & $0.25$ & $-{i}.00$ & $11140.00$ \\" for i in range(n)]
    lines += [r"\bottomrule", r"\end{tabular}", r"\end{table}"]
    (tmp_path / "p.tex").write_text("\n".join(lines))
    got = tables.read_latex_stats(spark, str(tmp_path / "p.tex")).collect()
    want = [(g.replace("\\", ""), f"Feature {i} & rest ({g[0]})", i + 0.5, 0.25, -float(i), 11140.0) for g, n in groups.items() for i in range(n)]
    assert len(want) == 38 and sorted(map(tuple, got)) == sorted(want)
    d = spark.createDataFrame([("A & b_c", "x % {y}", 1.5, None), ("A & b_c", "#2 $", -2.0, 0.25), ("Z", "q", 0.0, 3.0)], "g string, name string, a double, b double")
    tables.write_latex(tables.latex_table(d, ["name", "a", "b"], ["Name", "A", "B"], group="g"), str(tmp_path / "out"))
    back = [(r.group, *r.cells) for r in tables.read_latex_rows(spark, str(tmp_path / "out")).orderBy("i").collect()]
    assert back == [(None, "Name", "A", "B"), ("A & b_c", "#2 $", "-2.00", "0.25"), ("A & b_c", "x % {y}", "1.50", "--"), ("Z", "q", "0.00", "3.00")]


def test_suffix_matches_against_all_pairs(spark):
    import random
    import time

    rng = random.Random(12)
    name = lambda: "/".join(rng.choices(["a", "b", "src", "X.java", "Y.java", "ab", ""], k=rng.randint(1, 4)))
    pred = [(rng.randrange(4), "t", rng.choice([name(), name(), name(), None]), rng.randrange(9)) for _ in range(300)]
    truth = [(rng.randrange(4), name()) for _ in range(40)] + [(1, None)]
    p, t = spark.createDataFrame(pred, "bug int, tool string, file string, rank int"), spark.createDataFrame(truth, "bug int, gt_file string")
    got = sorted(tuple(r) for r in R.matched_ranks(p, t, ["bug"]).select("bug", "tool", "file", "rank").collect())
    assert got == sorted(r for r in pred if r[2] is not None and any(b == r[0] and g is not None and (r[2].endswith(g) or g.endswith(r[2])) for b, g in truth))
    many = spark.range(100_000).select(F.lit(1).alias("bug"), F.lit("t").alias("tool"), F.concat(F.lit("src/p"), F.col("id") % 977, F.lit("/F"), "id", F.lit(".java")).alias("file"), F.col("id").alias("rank"))
    hot = spark.range(10_000).select(F.lit(1).alias("bug"), F.concat(F.lit("/F"), F.col("id") * 10, F.lit(".java")).alias("gt_file"))
    began = time.time()
    assert R.matched_ranks(many, hot, ["bug"]).count() == 10_000 and time.time() - began < 60


def test_pairs_of_keys(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, t string")
    some = d.filter("k = 1 and t = 'b'").unionByName(d.filter("k = 1 and t = 'b'"))
    assert [tuple(r) for r in resume.gate(d, some, ["k", "t"]).collect()] == [(1, "b")]
    assert sorted(tuple(r) for r in resume.pending(d, some, ["k", "t"]).collect()) == [(1, "a"), (2, "a")]
    assert sorted(tuple(r) for r in resume.flagged(d, some, ["k", "t"], "known").collect()) == [(1, "a", False), (1, "b", True), (2, "a", False)]


def test_csv_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a;b", 1.5), ("line\nbreak", None)], "t string, v double")
    tables.write_table(d, str(tmp_path / "out"), "csv")
    assert sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out"), "t string, v double").collect()) == [("a;b", 1.5), ("line\nbreak", None)]


def test_resume_and_stream(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("src", "out", "mark"))
    spark.createDataFrame([(1,), (2,), (2,)], "id int").write.parquet(src)
    run = lambda: resume.annotate_stream(spark.readStream.schema("id int").parquet(src), "id", lambda d: d.withColumn("x", F.col("id") * 10), out, mark).awaitTermination()
    run()
    spark.createDataFrame([(2,), (3,)], "id int").write.mode("append").parquet(src)
    run()
    assert sorted(tuple(r) for r in tables.read_batches(spark, out).collect()) == [(1, 10), (2, 20), (3, 30)]
    done = spark.createDataFrame([(1, "old")], "id int, s string")
    items = spark.createDataFrame([(1,), (2,)], "id int")
    r = resume.resume(items, done, "id", lambda d: d.withColumn("s", F.lit("new"))).collect()
    assert sorted(tuple(x) for x in r) == [(1, "old"), (2, "new")]


def test_stream_state_and_replayed_batches(spark, tmp_path):
    src, out, mark, log = (str(tmp_path / x) for x in ("src", "out", "mark", "log"))
    broken = {"times": 1}

    def annotate(batch):
        if broken["times"] and batch.filter("id = 4").count():
            broken["times"] -= 1
            tables.append_once(batch, out, "stream", 1)  # written, then lost before the batch is committed
            raise ValueError("lost")
        return batch.withColumn("status", F.when(F.col("id") % 2 == 0, "failed").otherwise("ok"))

    def run():
        q = resume.annotate_stream(spark.readStream.schema("id int").parquet(src), "id", annotate, out, mark, log=log, failed=F.col("status") == "failed")
        try:
            q.awaitTermination()
        except Exception as e:
            assert "lost" in str(e)

    put = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1).write.mode("append").parquet(src)
    put(1, 2, None, 2)
    run()
    put(2, 3, 4, None)
    run()
    run()
    run()
    got = sorted((r.id or 0, r.status) for r in tables.read_batches(spark, out).collect())
    assert got == [(0, "ok"), (1, "ok"), (2, "failed"), (3, "ok"), (4, "failed")] and not broken["times"]
    counts = spark.read.parquet(log)
    assert tuple(counts.agg(F.sum("processed"), F.sum("failed")).first()) == (5, 2) and counts.select("batch").distinct().count() == counts.count()


def test_append_once(spark, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    d = spark.range(10).select("id", F.when(F.col("id") % 4 > 0, F.col("id")).alias("x"))
    for _ in range(2):
        for b in (0, 1):
            c = tables.append_once(d.filter(F.col("id") % 2 == b), out, "r1", b, {"processed": F.count("*"), "failed": F.count_if(F.col("x").isNull())}, log)
            assert c == {"processed": 5, "failed": 3 if b == 0 else 0}
    tables.append_once(d.filter("id < 0"), out, "r2", 0, {"processed": F.count("*"), "failed": F.count_if(F.col("x").isNull())}, log)
    assert sorted(r.id for r in tables.read_batches(spark, out).collect()) == list(range(10))
    assert sorted((r.run, r.batch, r.processed, r.failed) for r in spark.read.parquet(log).collect()) == [("r1", 0, 5, 3), ("r1", 1, 5, 0), ("r2", 0, 0, 0)]


def test_vectors(spark):
    from rankloom.functions import vectors as V

    d = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("a", [2.0, 0.0]), ("b", [1.0, 1.0])], "g string, v array<double>")
    r = {x.g: x.cosine for x in V.mean_pairwise_cosine(d, "g", "v", 2).collect()}
    assert abs(r["a"] - 1 / 3) < 1e-12 and r["b"] == 0.0
    e = {x.g: x.semantic_entropy for x in V.semantic_diversity(d, "g", "v").collect()}
    assert e["b"] == 0.0 and math.isfinite(e["a"])


def test_fold_params_are_those_of_rows_for_each_model(spark):
    import random

    from rankloom.operators import scoring as Z

    rng = random.Random(3)
    rows = [(t, i, int(rng.random() < 0.4), rng.randrange(5), f, None if rng.random() < 0.05 else float(rng.randint(0, 12)) + (f == "b") * rng.random()) for t in "xy" for i in range(150) for f in "ab"]
    rows += [("z", i, 1, i, "a", 3.0) for i in range(5)]  # one class, no spread
    d = spark.createDataFrame(rows, "task string, bug int, y int, fold int, feature string, value double").filter("value is not null")
    train, by = Z.for_training(d), ["task", "model"]
    want = {tuple(r)[:3]: tuple(r)[3:] for r in Z.delta_weights(train, by).join(Z.train_stats(train, by), [*by, "feature"]).select("task", "model", "feature", "delta", "mu", "sd").collect()}
    got = {tuple(r)[:3]: tuple(r)[3:] for r in Z.fold_params(d, ["task"]).select("task", "model", "feature", "delta", "mu", "sd").collect()}
    assert set(got) == set(want) and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
