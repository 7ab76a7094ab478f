"""Everything known about an order as one wide row, and columns whose vocabulary comes from the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging as M
from ..operators import reshape as P
from .base import FEATURES, FEATURES_SQL, RANKS, TOOLS, features, query, ranks, table

_WIDE = ", ".join(
    f"min(rank) FILTER (WHERE tool = '{t}' AND rank > 0) AS rank_{t}, max(CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END) FILTER (WHERE tool = '{t}') AS mrr_{t}, "
    + ", ".join(f"max(coalesce(rank > 0 AND rank <= {k}, false)::INT) FILTER (WHERE tool = '{t}') AS top_{k}_{t}" for k in (1, 5))
    for t in TOOLS
)
_WIDE_NAMES = [f"{m}_{t}" for t in TOOLS for m in ("rank", "mrr", "top_1", "top_5")]
_LINES = "SELECT l_orderkey AS bug, concat('T', l_linenumber) AS tool, CAST(l_quantity AS INT) AS rank FROM lineitem"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bug"), F.concat(F.lit("T"), "l_linenumber").alias("tool"), F.col("l_quantity").cast("int").alias("rank"))


@query("wide_metrics", f"SELECT bug, {_WIDE} FROM ({_LINES}) GROUP BY bug")
def wide_metrics(spark, sf_dir):
    """Rank, reciprocal rank and success within 1 and 5 of every tool beside each other."""
    return M.wide_metrics(_lines(spark, sf_dir), ["bug"], TOOLS)


_RATED = "SELECT l_orderkey AS bug, count(*)::BIGINT AS n_items, count(DISTINCT l_returnflag)::BIGINT AS clarity, max(l_quantity) AS actionability FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1"
_CATEG = "SELECT o_orderkey AS bug, o_orderstatus AS category, o_totalprice FROM orders WHERE o_orderstatus <> 'P'"
_FINE = "SELECT o_orderkey AS bug, c_mktsegment AS category, c_acctbal AS confidence FROM orders JOIN customer ON c_custkey = o_custkey"


@query("merge_chain", f"""WITH feats AS ({FEATURES_SQL}), w AS (SELECT bug, {_WIDE} FROM ({_LINES}) GROUP BY bug), r AS ({_RATED}), c AS ({_CATEG}), f AS ({_FINE}),
 b AS (SELECT o_orderpriority AS project, count(*)::BIGINT AS project_reports, avg(o_totalprice) AS o_totalprice FROM orders GROUP BY 1)
 SELECT bug, project, {', '.join(f'feats.{x}' for x in FEATURES)}, {', '.join(_WIDE_NAMES)}, clarity, c.category, {', '.join(f"coalesce(f.category = '{s}', false)::INT AS fg_{s.lower()}" for s in ('BUILDING', 'FURNITURE'))}, confidence, project_reports
 FROM feats LEFT JOIN w USING (bug) LEFT JOIN r USING (bug) LEFT JOIN c USING (bug) LEFT JOIN f USING (bug) LEFT JOIN b USING (project)""")
def merge_chain(spark, sf_dir):
    """Features with pivoted outcomes, ratings, two kinds of categories and statistics of the project; copies of columns that are there go.

    The finer category is encoded right after its join, as its own column is a copy by name and goes with the others."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rated = li.filter("l_linestatus = 'F'").groupBy(F.col("l_orderkey").alias("bug")).agg(F.count("*").alias("n_items"), F.count_distinct("l_returnflag").alias("clarity"), F.max("l_quantity").alias("actionability"))
    coarse = o.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("bug"), F.col("o_orderstatus").alias("category"), "o_totalprice")
    c = table(spark, sf_dir, "customer")
    fine = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("bug"), F.col("c_mktsegment").alias("category"), F.col("c_acctbal").alias("confidence"))
    by_project = o.groupBy(F.col("o_orderpriority").alias("project")).agg(F.count("*").alias("project_reports"), F.avg("o_totalprice").alias("o_totalprice"))
    flags = lambda d: d.withColumns({f"fg_{s.lower()}": F.coalesce(F.col("category_fine") == s, F.lit(False)).cast("int") for s in ("BUILDING", "FURNITURE")})
    return M.merge_sources(
        features(spark, sf_dir),
        [
            M.Source(M.wide_metrics(_lines(spark, sf_dir), ["bug"], TOOLS), ["bug"], "_perf"),
            M.Source(rated, ["bug"], "_ratings", drop=("actionability",)),
            M.Source(coarse, ["bug"], "_categ"),
            M.Source(fine, ["bug"], "_fine", after=flags),
            M.Source(by_project, ["project"], "_bee"),
        ],
        keys=("bug", "project"),
    )


@query("map_within_5", f"WITH r AS ({RANKS}), m AS (SELECT l_orderkey AS bug, concat('T', l_linenumber) AS tool, max(1 - l_discount) AS map FROM lineitem GROUP BY 1, 2) SELECT tool, count(*)::BIGINT AS n, round(avg(CASE WHEN rank > 0 AND rank <= 5 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr_5, round(avg(CASE WHEN rank > 0 AND rank <= 5 THEN map ELSE 0 END), 6) AS map_5 FROM r JOIN m USING (bug, tool) GROUP BY 1")
def map_within_5(spark, sf_dir):
    """The stored precision of what is found within five, by tool, beside the reciprocal rank that stands in where none is stored."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bug"), F.concat(F.lit("T"), "l_linenumber").alias("tool")).agg(F.max(1 - F.col("l_discount")).alias("map"))
    d = ranks(spark, sf_dir).join(m, ["bug", "tool"])
    return d.groupBy("tool").agg(F.count("*").alias("n"), F.round(F.avg(M.map_within("rank", 5, ["rank"])), 6).alias("mrr_5"), F.round(F.avg(M.map_within("rank", 5, d.columns)), 6).alias("map_5"))


@query("onehot_from_data", """WITH l AS (SELECT coalesce(trim(city), '') AS v FROM clients), k AS (SELECT v, count(*) AS n FROM l WHERE v <> '' GROUP BY 1), x AS (SELECT CASE WHEN l.v = '' THEN '__missing__' WHEN n >= 20 THEN l.v ELSE '__other__' END AS v FROM l LEFT JOIN k ON k.v = l.v)
 SELECT 'city_' || v AS "column", count(*)::BIGINT AS n FROM x GROUP BY 1 UNION ALL SELECT 'city_is_missing', count(*) FILTER (WHERE v = '__missing__')::BIGINT FROM x""")
def onehot_from_data(spark, sf_dir):
    """How often each column is set that the cities of twenty clients or more give, with those for other and missing ones."""
    d = P.one_hot_from(table(spark, sf_dir, "clients").select("city"), "city", "city", 20)
    return P.column_sums(d, d.columns[1:])


@query("multihot_from_data", """WITH l AS (SELECT item_id, list_filter(string_split(name || ' ' || coalesce(kind, ''), ' '), lambda x: x <> '') AS xs FROM items WHERE name IS NOT NULL UNION ALL SELECT item_id, [] FROM items WHERE name IS NULL), k AS (SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(xs)) AS w FROM l) GROUP BY 1 HAVING count(*) >= 30)
 SELECT 'w__' || regexp_replace(w, '[^a-z0-9_]+', '_', 'g') AS "column", n::BIGINT AS n FROM k UNION ALL SELECT 'w_num_concepts', sum(len(xs))::BIGINT FROM l UNION ALL SELECT 'w_is_missing', count(*) FILTER (WHERE len(xs) = 0)::BIGINT FROM l""")
def multihot_from_data(spark, sf_dir):
    """How often each column is set that the words of an item's name and kind give, where thirty items or more hold them."""
    words = F.filter(F.split(F.concat("name", F.lit(" "), F.coalesce("kind", F.lit(""))), " "), lambda x: x != "")
    d = P.multi_hot_from(table(spark, sf_dir, "items").select(words.alias("xs")), "xs", "w", 30)
    return P.column_sums(d, d.columns[1:])
