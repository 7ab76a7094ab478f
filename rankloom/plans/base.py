"""The driver tables in the roles of reports, results and features, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

TOOLS = [f"T{i}" for i in range(1, 8)]


def query(name: str, sql: str | None = None):
    """Register a query, with its DuckDB equivalent if there is one."""

    def put(f):
        if name in catalog.QUERIES:
            raise ValueError(f"{name} is there already")
        catalog.QUERIES[name] = f
        if sql is not None:
            catalog.ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks(spark, sf_dir) -> DataFrame:
    """(bug, tool, rank, detected, project): the best rank of each tool for each order."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("bug"), F.concat(F.lit("T"), F.col("l_linenumber")).alias("tool")).agg(F.min(F.col("l_quantity").cast("int")).alias("rank"), F.max(F.col("l_returnflag") != "N").alias("detected"))


RANKS = "SELECT l_orderkey AS bug, concat('T', l_linenumber) AS tool, min(CAST(l_quantity AS INT)) AS rank, bool_or(l_returnflag <> 'N') AS detected FROM lineitem GROUP BY 1, 2"


def flags_sql(k: int) -> str:
    cols = ", ".join(f"coalesce(bool_or(rank <= {k}) FILTER (WHERE tool = '{t}'), false) AS found_{t}" for t in TOOLS)
    return f"SELECT *, {' + '.join(f'found_{t}::INT' for t in TOOLS)} AS num_found FROM (SELECT bug, {cols} FROM ({RANKS}) GROUP BY bug)"


FEATURES = ["o_totalprice", "sum_price", "avg_discount", "avg_tax", "n_items"]


def _whole(column: str, times: int):
    """A sum in whole numbers, the same in any order."""
    return F.sum(F.round(F.col(column) * times).cast("long")).cast("double")


def item_features() -> list:
    """The numbers that an order's lines give, as aggregates."""
    return [(_whole("l_extendedprice", 100) / 100.0).alias("sum_price"), (_whole("l_discount", 10000) / 10000.0 / F.count("*")).alias("avg_discount"), (_whole("l_tax", 10000) / 10000.0 / F.count("*")).alias("avg_tax"), F.count("*").cast("double").alias("n_items")]


def features(spark, sf_dir) -> DataFrame:
    """(bug, project, five numbers) of each order."""
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bug")).agg(*item_features())
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bug"), F.col("o_orderpriority").alias("project"), "o_totalprice")
    return o.join(li, "bug")


FEATURES_SQL = """SELECT o.o_orderkey AS bug, o.o_orderpriority AS project, o.o_totalprice, l.sum_price, l.avg_discount, l.avg_tax, l.n_items FROM orders o JOIN
(SELECT l_orderkey AS bug, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0::DOUBLE AS sum_price, sum(round(l_discount * 10000)::BIGINT)::DOUBLE / 10000.0::DOUBLE / count(*) AS avg_discount, sum(round(l_tax * 10000)::BIGINT)::DOUBLE / 10000.0::DOUBLE / count(*) AS avg_tax, count(*)::DOUBLE AS n_items FROM lineitem GROUP BY 1) l ON l.bug = o.o_orderkey"""

LONG_SQL = " UNION ALL ".join(f"SELECT bug, project, '{f}' AS feature, {f}::DOUBLE AS value FROM feats" for f in FEATURES)


def two_groups_sql(rel: str, by: list[str], tail: str = "") -> str:
    """The statistics of :func:`rankloom.operators.stats.two_groups` over a relation (by, value, is_first)."""
    b = ", ".join(by)
    return f"""
r AS (SELECT *, rank() OVER (PARTITION BY {b} ORDER BY value) + (count(*) OVER (PARTITION BY {b}, value) - 1) / 2.0::DOUBLE AS ar, count(*) OVER (PARTITION BY {b}, value) AS t FROM ({rel})),
g AS (SELECT {b}, count(*) FILTER (WHERE is_first) AS n1, count(*) FILTER (WHERE NOT is_first) AS n2,
 median(value) FILTER (WHERE is_first) AS median1, median(value) FILTER (WHERE NOT is_first) AS median2,
 avg(value) FILTER (WHERE is_first) AS mean1, avg(value) FILTER (WHERE NOT is_first) AS mean2,
 sum(ar) FILTER (WHERE is_first) AS r1, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY {b}),
u AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN r1 - n1::DOUBLE * (n1 + 1) / 2 END AS u,
 n1::DOUBLE * n2 / 12 * ((n1 + n2 + 1) - ties / nullif((n1 + n2)::DOUBLE * (n1 + n2 - 1), 0)) AS v FROM g),
s AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND v > 0 THEN (greatest(u, n1::DOUBLE * n2 - u) - n1::DOUBLE * n2 / 2 - 0.5) / sqrt(v) END AS z, 2 * u / nullif(n1::DOUBLE * n2, 0) - 1 AS delta FROM u)
SELECT {b}, n1::BIGINT AS n1, n2::BIGINT AS n2, round(median1, 4) AS median1, round(median2, 4) AS median2, round(mean1 + 1e-8::DOUBLE, 4) AS mean1, round(mean2 + 1e-8::DOUBLE, 4) AS mean2, u, round(z, 6) AS z, round(delta, 6) AS delta,
 CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' WHEN delta IS NOT NULL THEN 'large' END AS effect_size{tail} FROM s"""


def tidy(stats: DataFrame, by: list[str], *more) -> DataFrame:
    from ..operators.stats import effect_label

    cols = [F.round(c, 4).alias(c) for c in ("median1", "median2")]
    cols += [F.round(F.col(c) + 1e-8, 4).alias(c) for c in ("mean1", "mean2")]  # a tie falls one way, whatever the order of the sum
    return stats.select(*by, "n1", "n2", *cols, "u", F.round("z", 6).alias("z"), F.round("delta", 6).alias("delta"), effect_label(F.col("delta")).alias("effect_size"), *more)
