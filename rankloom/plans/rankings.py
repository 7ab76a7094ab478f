"""Ranked results: MRR and MAP, tool performance, failures and where they lie."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R
from ..operators import stats as S
from .base import RANKS, TOOLS, query, ranks, table

_RES = "SELECT l_orderkey AS bug, concat('T', l_linenumber) AS tool, l_returnflag AS project, CAST(l_quantity AS INT) AS rank, l_returnflag <> 'N' AS detected FROM lineitem"


def _results(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("bug"), F.concat(F.lit("T"), F.col("l_linenumber")).alias("tool"), F.col("l_returnflag").alias("project"), F.col("l_quantity").cast("int").alias("rank"), (F.col("l_returnflag") != "N").alias("detected"))


_RR = lambda k: f"round(avg(CASE WHEN rank > 0 AND rank <= {k} THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_{k}"
_MRR = ", ".join(map(_RR, (1, 5, 10)))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c.startswith(("mrr_", "map_")) else F.col(c) for c in df.columns])


@query("mrr_at_k_by_tool", f"SELECT tool, {_MRR}, count(*)::BIGINT AS n FROM ({_RES}) GROUP BY ROLLUP (tool)")
def mrr_at_k_by_tool(spark, sf_dir):
    return _rounded(R.rates_by_tool(_results(spark, sf_dir), [1, 5, 10]))


@query("mrr_by_project_tool", f"SELECT project, tool, {_MRR}, count(*)::BIGINT AS n FROM ({_RES}) GROUP BY GROUPING SETS ((tool), (project, tool))")
def mrr_by_project_tool(spark, sf_dir):
    return _rounded(R.rates_by_tool(_results(spark, sf_dir), [1, 5, 10], "project"))


_PRED = "SELECT l_orderkey AS bug, l_linestatus AS tool, concat('src/p', l_partkey, '.java') AS file, l_linenumber AS rank FROM lineitem"
_TRUE = "SELECT l_orderkey AS bug, concat('p', l_partkey, '.java') AS gt_file FROM lineitem WHERE l_returnflag = 'R'"
_MAP = f"""WITH p AS ({_PRED}), t AS ({_TRUE}), n AS (SELECT bug, count(*)::BIGINT AS n_truth FROM t GROUP BY bug), g AS (SELECT DISTINCT bug, tool, n_truth FROM p JOIN n USING (bug)),
 h AS (SELECT *, row_number() OVER (PARTITION BY bug, tool ORDER BY rank, file) AS i FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.bug = p.bug AND (t.gt_file = p.file OR ends_with(p.file, t.gt_file) OR ends_with(t.gt_file, p.file)))),
 s AS (SELECT bug, tool, min(rank) AS best_rank, {", ".join(f"sum(i::DOUBLE / rank) FILTER (WHERE rank <= {k}) AS s{k}" for k in (1, 5))} FROM h GROUP BY 1, 2)
 SELECT bug, tool, n_truth, best_rank, {", ".join(f"round(CASE WHEN best_rank <= {k} THEN 1.0::DOUBLE / best_rank ELSE 0 END, 6) AS mrr_{k}" for k in (1, 5))}, {", ".join(f"round(coalesce(s{k} / n_truth, 0), 6) AS map_{k}" for k in (1, 5))} FROM g LEFT JOIN s USING (bug, tool)"""


def _map(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_orderkey").alias("bug"), F.col("l_linestatus").alias("tool"), F.concat(F.lit("src/p"), "l_partkey", F.lit(".java")).alias("file"), F.col("l_linenumber").alias("rank"))
    t = li.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("bug"), F.concat(F.lit("p"), "l_partkey", F.lit(".java")).alias("gt_file"))
    return p, R.map_at_k(p, t, ["bug"], [1, 5])


@query("map_at_k", _MAP)
def map_at_k(spark, sf_dir):
    return _rounded(_map(spark, sf_dir)[1])


@query("best_rank_suffix_match", f"SELECT bug, tool, best_rank FROM ({_MAP}) WHERE best_rank IS NOT NULL")
def best_rank_suffix_match(spark, sf_dir):
    return _map(spark, sf_dir)[1].select("bug", "tool", "best_rank").filter("best_rank is not null")


@query("metric_write_back", f"SELECT l_orderkey AS bug, l_linestatus AS tool, count(*)::BIGINT AS n, coalesce(max(map_5), 0) AS map_5 FROM lineitem LEFT JOIN ({_MAP}) m ON m.bug = l_orderkey AND m.tool = l_linestatus GROUP BY 1, 2")
def metric_write_back(spark, sf_dir):
    """Metrics joined back onto the result table; without truth or predictions they are 0."""
    p, m = _map(spark, sf_dir)
    rows = p.groupBy("bug", "tool").agg(F.count("*").alias("n"))
    return rows.join(m.select("bug", "tool", F.round("map_5", 6).alias("map_5")), ["bug", "tool"], "left").fillna(0.0, ["map_5"])


@query("tool_performance_stats", f"""SELECT tool, count(*) FILTER (WHERE rank <= 1)::BIGINT AS top1, count(*) FILTER (WHERE rank <= 5)::BIGINT AS top5, round(avg((rank <= 1)::INT), 3) AS top1_rate, round(avg((rank <= 5)::INT), 3) AS top5_rate, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 3) AS mrr_5,
 count(*) FILTER (WHERE detected)::BIGINT AS detected, count(*) FILTER (WHERE NOT detected)::BIGINT AS not_detected, count(*)::BIGINT AS total, round(100 * avg((rank <= 5)::INT) - 100 * avg((rank <= 1)::INT), 3) AS top5_not_top1_share, round(100 - 100 * avg((rank <= 5)::INT), 3) AS rest_share FROM ({_RES}) GROUP BY tool""")
def tool_performance_stats(spark, sf_dir):
    one, five = (F.col("rank") <= 1).cast("int"), (F.col("rank") <= 5).cast("int")
    return _results(spark, sf_dir).groupBy("tool").agg(
        F.sum(one).alias("top1"), F.sum(five).alias("top5"), F.round(F.avg(one), 3).alias("top1_rate"), F.round(F.avg(five), 3).alias("top5_rate"), F.round(F.avg(R.reciprocal_at(F.col("rank"), 5)), 3).alias("mrr_5"),
        F.count_if("detected").alias("detected"), F.count_if(~F.col("detected")).alias("not_detected"), F.count("*").alias("total"), F.round(100 * F.avg(five) - 100 * F.avg(one), 3).alias("top5_not_top1_share"), F.round(100 - 100 * F.avg(five), 3).alias("rest_share"),
    )


@query("mrr_spread_by_tool", f"WITH r AS (SELECT tool, CASE WHEN rank > 0 AND rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END AS mrr FROM ({_RES})) SELECT tool, count(*)::BIGINT AS n, round(avg(mrr), 6) AS mean_mrr, round(median(mrr), 6) AS median_mrr, round(max(mrr), 6) AS max_mrr FROM r GROUP BY tool UNION ALL SELECT 'overall', count(*)::BIGINT, round(avg(mrr), 6), round(median(mrr), 6), round(max(mrr), 6) FROM r")
def mrr_spread_by_tool(spark, sf_dir):
    """Mean, median and largest reciprocal rank of each tool and of all results."""
    r = _results(spark, sf_dir).select(F.explode(F.array("tool", F.lit("overall"))).alias("tool"), R.reciprocal_at(F.col("rank"), 10).alias("mrr"))
    d = S.describe(r, ["tool"], "mrr")
    return d.select("tool", F.col("count").alias("n"), *[F.round(c, 6).alias(f"{n}_mrr") for n, c in (("mean", "mean"), ("median", "median"), ("max", "max"))])


_KIND = f"SELECT bug, CASE WHEN bool_or(rank <= 10) THEN 'localised' WHEN bool_or(detected) THEN 'soft' ELSE 'hard' END AS kind FROM ({RANKS}) GROUP BY bug"


def _kinds(spark, sf_dir):
    return R.failure_kind(ranks(spark, sf_dir), "bug", 10)


@query("unlocalizable_hard_soft", f"SELECT kind, count(*)::BIGINT AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_KIND}) GROUP BY kind")
def unlocalizable_hard_soft(spark, sf_dir):
    from pyspark.sql import Window as W

    n = _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6))


_EDGES = {"1-1": "rank <= 1", "2-5": "rank <= 5", "6-10": "rank <= 10", "11-20": "rank <= 20", "21-50": "rank <= 50"}
_BUCKETS = ["not_found", *_EDGES, ">50"]
_B = "CASE WHEN rank IS NULL OR rank <= 0 THEN 'not_found' " + " ".join(f"WHEN {c} THEN '{b}'" for b, c in _EDGES.items()) + " ELSE '>50' END"


@query("rank_buckets", f"SELECT tool, {', '.join(f'''(count(*) FILTER (WHERE b = '{b}'))::BIGINT AS \"b_{b}\"''' for b in _BUCKETS)} FROM (SELECT tool, {_B} AS b FROM ({RANKS})) GROUP BY tool")
def rank_buckets(spark, sf_dir):
    d = ranks(spark, sf_dir).select("tool", R.rank_bucket(F.col("rank")).alias("b"))
    p = d.groupBy("tool").pivot("b", _BUCKETS).count().fillna(0)
    return p.select("tool", *[F.col(f"`{b}`").alias(f"b_{b}") for b in _BUCKETS])


@query("closest_tool", f"SELECT bug, tool, rank FROM (SELECT *, row_number() OVER (PARTITION BY bug ORDER BY rank, tool) AS k FROM ({RANKS})) WHERE k = 1")
def closest_tool(spark, sf_dir):
    return R.closest_tool(ranks(spark, sf_dir), "bug")


@query("project_failure_breakdown", f"SELECT o_orderpriority AS project, count(DISTINCT bug) FILTER (WHERE kind = 'hard')::BIGINT AS hard, count(DISTINCT bug) FILTER (WHERE kind = 'soft')::BIGINT AS soft, count(DISTINCT bug) FILTER (WHERE kind <> 'localised')::BIGINT AS total FROM ({_KIND}) JOIN orders ON o_orderkey = bug GROUP BY 1")
def project_failure_breakdown(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bug"), F.col("o_orderpriority").alias("project"))
    p = _kinds(spark, sf_dir).join(o, "bug").groupBy("project").pivot("kind", ["hard", "soft"]).agg(F.count_distinct("bug")).fillna(0)
    return p.withColumn("total", F.col("hard") + F.col("soft")).orderBy(F.desc("total"), "project")


_FLAGS = {"urgent": "o_orderpriority = '1-URGENT'", "open": "o_orderstatus = 'O'", "dear": "o_totalprice > 150000"}


@query("prevalence_diff", f"WITH d AS (SELECT kind <> 'localised' AS gone, o.* FROM ({_KIND}) JOIN orders o ON o_orderkey = bug) " + " UNION ALL ".join(f"SELECT '{f}' AS flag, round(100.0::DOUBLE * avg(({c})::INT) FILTER (WHERE gone), 6) AS in_unlocalised, round(100.0::DOUBLE * avg(({c})::INT) FILTER (WHERE NOT gone), 6) AS in_localised FROM d" for f, c in _FLAGS.items()))
def prevalence_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "bug")
    d = _kinds(spark, sf_dir).join(o, "bug").select((F.col("kind") != "localised").alias("gone"), *[F.expr(c).cast("int").alias(f) for f, c in _FLAGS.items()])
    long = d.unpivot(["gone"], list(_FLAGS), "flag", "v")
    return long.groupBy("flag").agg(F.round(100 * F.avg(F.when(F.col("gone"), F.col("v"))), 6).alias("in_unlocalised"), F.round(100 * F.avg(F.when(~F.col("gone"), F.col("v"))), 6).alias("in_localised"))


@query("rank_describe", f"SELECT tool, count(rank)::BIGINT AS count, round(avg(rank), 6) AS mean, round(stddev_samp(rank), 6) AS std, min(rank)::DOUBLE AS min, quantile_cont(rank::DOUBLE, 0.25) AS q1, quantile_cont(rank::DOUBLE, 0.5) AS median, quantile_cont(rank::DOUBLE, 0.75) AS q3, max(rank)::DOUBLE AS max FROM ({RANKS}) GROUP BY tool")
def rank_describe(spark, sf_dir):
    return S.describe(ranks(spark, sf_dir), ["tool"], "rank").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("always_missed", f"SELECT bug, list_sort(list(tool)) AS tools FROM ({RANKS}) GROUP BY bug HAVING bool_and(rank > 10)")
def always_missed(spark, sf_dir):
    """Bugs that no tool has in its first ten, with the tools that tried."""
    g = ranks(spark, sf_dir).groupBy("bug").agg(F.bool_and(F.col("rank") > 10).alias("all_miss"), F.array_sort(F.collect_list("tool")).alias("tools"))
    return g.filter("all_miss").select("bug", "tools")


@query("verdict_crosstab", f"SELECT project, {', '.join(f'''(count(*) FILTER (WHERE tool = '{t}'))::BIGINT AS {t}''' for t in TOOLS)} FROM ({_RES}) GROUP BY project")
def verdict_crosstab(spark, sf_dir):
    return _results(spark, sf_dir).groupBy("project").pivot("tool", TOOLS).count().fillna(0)


@query("value_counts", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("map_override_coalesce", f"SELECT l_orderkey AS bug, l_linenumber AS line, coalesce(max(map_5), max(l_discount)) AS value FROM lineitem LEFT JOIN ({_MAP}) m ON m.bug = l_orderkey AND m.tool = l_linestatus GROUP BY 1, 2")
def map_override_coalesce(spark, sf_dir):
    """A recalculated metric where there is one, else the stored one."""
    _, m = _map(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bug"), F.col("l_linestatus").alias("tool"), F.col("l_linenumber").alias("line"), "l_discount")
    j = li.join(m.select("bug", "tool", F.round("map_5", 6).alias("map_5")), ["bug", "tool"], "left")
    return j.groupBy("bug", "line").agg(F.coalesce(F.max("map_5"), F.max("l_discount")).alias("value"))
