"""Keys, joins, pivots, indicators, scaling, filling and pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as C
from ..operators import redundancy
from ..operators import reshape as P
from ..operators import stats as S
from .base import FEATURES, FEATURES_SQL, LONG_SQL, RANKS, TOOLS, features, query, ranks, table
from .rated import RATINGS_SQL, ratings


@query("split_and_repair_ids", """WITH c AS (SELECT c_custkey, c_mktsegment AS project, CASE WHEN c_custkey % 3 = 0 THEN 'Chart-' || c_custkey ELSE c_custkey::VARCHAR END AS bug_id FROM customer)
 SELECT c_custkey, CASE WHEN contains(bug_id, '-') THEN split_part(bug_id, '-', 1) ELSE project END AS project, TRY_CAST(CASE WHEN contains(bug_id, '-') THEN split_part(bug_id, '-', 2) ELSE bug_id END AS BIGINT) AS bug_id, regexp_replace(c_custkey::VARCHAR || '.0', '\\.0$', '') AS normal FROM c""")
def split_and_repair_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("project"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Chart-"), F.col("c_custkey"))).otherwise(F.col("c_custkey").cast("string")).alias("bug_id"), F.concat(F.col("c_custkey"), F.lit(".0")).alias("f"))
    return c.select("c_custkey", *C.repair_keys("project", "bug_id"), C.normal_id("f").alias("normal"))


@query("split_report_ids", "SELECT c_custkey, c_mktsegment AS project, c_custkey::BIGINT AS bug_id FROM customer")
def split_report_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", *C.split_id(F.concat("c_mktsegment", F.lit("-"), "c_custkey")))


_PIV = ", ".join(f"min(rank) FILTER (WHERE tool = '{t}') AS rank_{t}" for t in TOOLS)


@query("merge_features_pivot", f"""WITH feats AS ({FEATURES_SQL}), p AS (SELECT bug, {_PIV} FROM ({RANKS}) GROUP BY bug), r AS (SELECT o_orderkey AS bug, o_totalprice AS o_totalprice_ratings, o_orderstatus FROM orders WHERE o_orderstatus = 'F')
 SELECT bug, o_totalprice, n_items, {', '.join(f'rank_{t}' for t in TOOLS)}, o_totalprice_ratings, o_orderstatus FROM feats LEFT JOIN p USING (bug) LEFT JOIN r USING (bug)""")
def merge_features_pivot(spark, sf_dir):
    """Features, the pivoted ranks and a second table whose clashing column gets a suffix."""
    f = features(spark, sf_dir).select("bug", "o_totalprice", "n_items")
    p = P.pivot_tools(ranks(spark, sf_dir), ["bug"], TOOLS, {"rank": "min"})
    r = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("bug"), "o_totalprice", "o_orderstatus")
    return C.join_suffixed(C.join_suffixed(f, p, ["bug"], "_perf"), r, ["bug"], "_ratings")


@query("pivot_max_zero_fill", "SELECT l_orderkey AS bug, " + ", ".join(f"coalesce(max(l_extendedprice) FILTER (WHERE l_linenumber = {i}), 0) AS price_T{i}" for i in range(1, len(TOOLS) + 1)) + " FROM lineitem GROUP BY 1")
def pivot_max_zero_fill(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bug"), F.concat(F.lit("T"), "l_linenumber").alias("tool"), F.col("l_extendedprice").alias("price"))
    return P.pivot_tools(li, ["bug"], TOOLS, {"price": "max"}, fill=0.0)


_HOT = ("retail", "online", "public")


@query("onehot_topk", "SELECT client_id, " + ", ".join(f"coalesce(segment = '{v}', false)::INT AS seg_{v}" for v in _HOT) + f", coalesce(trim(segment) <> '' AND segment NOT IN {_HOT}, false)::INT AS seg__other__, (segment IS NULL OR trim(segment) = '')::INT AS seg_is_missing FROM clients")
def onehot_topk(spark, sf_dir):
    c = table(spark, sf_dir, "clients").select("client_id", "segment")
    return P.one_hot(c, "segment", list(_HOT), "seg").drop("segment")


@query("onehot_frequent", "SELECT p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) >= 20")
def onehot_frequent(spark, sf_dir):
    """The vocabulary that one-hot columns are made for."""
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n")).filter("n >= 20")


@query("multihot_concepts", "SELECT client_id, list_contains(items, 'retail')::INT AS c_retail, list_contains(items, 'web')::INT AS c_web, len(items)::INT AS c_count, (len(items) = 0)::INT AS c_is_missing FROM (SELECT client_id, CASE WHEN segment IS NULL THEN [] ELSE list_filter([segment, source], lambda x: x IS NOT NULL) END AS items FROM clients)")
def multihot_concepts(spark, sf_dir):
    """What describes a client that has a segment: the segment and the source."""
    c = table(spark, sf_dir, "clients").select("client_id", F.when(F.col("segment").isNotNull(), F.array_compact(F.array("segment", "source"))).otherwise(F.array().cast("array<string>")).alias("items"))
    return P.multi_hot(c, "items", ["retail", "web"], "c").drop("items")


@query("vocabulary_frequency", "SELECT w AS item, count(*)::BIGINT AS n FROM (SELECT unnest(list_distinct(string_split(p_type, ' '))) AS w FROM part) GROUP BY 1 HAVING count(*) >= 30")
def vocabulary_frequency(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.explode(F.array_distinct(F.split("p_type", " "))).alias("item"))
    return p.groupBy("item").agg(F.count("*").alias("n")).filter("n >= 30")


@query("missingness", f"WITH p AS (SELECT bug, {_PIV} FROM ({RANKS}) GROUP BY bug) SELECT bug, " + ", ".join(f"rank_{t}, (rank_{t} IS NULL)::INT AS rank_{t}__is_missing" for t in TOOLS) + " FROM p")
def missingness(spark, sf_dir):
    return P.missing_flags(P.pivot_tools(ranks(spark, sf_dir), ["bug"], TOOLS, {"rank": "min"}), [f"rank_{t}" for t in TOOLS])


@query("missing_share", f"WITH p AS (SELECT bug, {_PIV} FROM ({RANKS}) GROUP BY bug) " + " UNION ALL ".join(f"SELECT 'rank_{t}' AS feature, count(*) FILTER (WHERE rank_{t} IS NULL)::BIGINT AS n_missing, round(100.0::DOUBLE * avg((rank_{t} IS NULL)::INT), 6) AS share FROM p" for t in TOOLS))
def missing_share(spark, sf_dir):
    w = P.pivot_tools(ranks(spark, sf_dir), ["bug"], TOOLS, {"rank": "min"})
    m = w.select(*[F.col(f"rank_{t}").isNull().cast("int").alias(f"rank_{t}") for t in TOOLS]).unpivot([], [f"rank_{t}" for t in TOOLS], "feature", "m")
    return m.groupBy("feature").agg(F.sum("m").alias("n_missing"), F.round(100 * F.avg("m"), 6).alias("share"))


_RATE = RATINGS_SQL


@query("rating_interactions", f"""SELECT doc_id, round(clarity - specificity, 9) AS clarity_specificity_gap, round(clarity / (specificity + 0.1::DOUBLE), 9) AS clarity_specificity_ratio, round(actionability * technical_depth, 9) AS actionability_depth_product, round(actionability / (technical_depth + 0.1::DOUBLE), 9) AS actionability_depth_ratio,
 round((actionability + clarity + specificity) / 3, 9) AS quality_composite, round(list_stddev_samp([actionability, clarity, specificity]), 9) AS quality_std, round((technical_depth + expected_observed_alignment) / 2, 9) AS technical_completeness, round((causal_reasoning_quality + 2 * hidden_s2r_present) / 7, 9) AS reasoning_composite, round(clarity - 2 * contradiction_present, 9) AS clarity_minus_contradiction FROM ({_RATE})""")
def rating_interactions(spark, sf_dir):
    d = P.rating_interactions(ratings(spark, sf_dir))
    return d.select("doc_id", *[F.round(c, 9).alias(c) for c in d.columns[9:]])


@query("consistency_features", f"""WITH x AS (SELECT doc_id, 1 - abs((contradiction_present + hidden_s2r_present) / 3 - technical_depth / 5) AS a, 1 - abs(least(actionability / 5, 1.0::DOUBLE) - causal_reasoning_quality / 5) AS b FROM ({_RATE}))
 SELECT doc_id, round(a, 9) AS technical_depth_consistency, round(b, 9) AS causal_reasoning_consistency, round((a + b) / 2, 9) AS consistency_composite FROM x""")
def consistency_features(spark, sf_dir):
    d = ratings(spark, sf_dir).withColumnsRenamed({"contradiction_present": "has_code", "hidden_s2r_present": "has_stacktrace", "actionability": "num_causal_markers"})
    return P.consistency(d).select("doc_id", *[F.round(c, 9).alias(c) for c in ("technical_depth_consistency", "causal_reasoning_consistency", "consistency_composite")])


@query("interaction_features", f"SELECT doc_id, round(actionability * clarity, 9) AS complexity_reasoning, round(clarity * specificity, 9) AS reasoning_clarity, round(technical_depth + causal_reasoning_quality - expected_observed_alignment, 9) AS readability_combo FROM ({_RATE})")
def interaction_features(spark, sf_dir):
    d = ratings(spark, sf_dir).withColumnsRenamed({"actionability": "z_repair_readiness", "clarity": "z_reasoning_quality", "specificity": "z_clarity", "technical_depth": "ari", "causal_reasoning_quality": "fog", "expected_observed_alignment": "flesch"})
    return P.interactions(d).select("doc_id", *[F.round(c, 9).alias(c) for c in ("complexity_reasoning", "reasoning_clarity", "readability_combo")])


@query("standard_scale", f"WITH feats AS ({FEATURES_SQL}) SELECT bug, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in FEATURES) + " FROM feats")
def standard_scale(spark, sf_dir):
    d = P.standard_scale(features(spark, sf_dir).drop("project"), FEATURES, keep=False)
    return d.select("bug", *[F.round(c, 6).alias(c) for c in FEATURES])


@query("feature_summary_stats", f"WITH feats AS ({FEATURES_SQL}) SELECT feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, count(*)::BIGINT AS n FROM ({LONG_SQL}) GROUP BY feature")
def feature_summary_stats(spark, sf_dir):
    long = S.long_form(features(spark, sf_dir), ["bug"], FEATURES)
    return long.groupBy("feature").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_pop("value"), 4).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))


@query("scaling_parameters", f"WITH feats AS ({FEATURES_SQL}) SELECT feature, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max, 0::BIGINT AS n_missing FROM ({LONG_SQL}) GROUP BY feature")
def scaling_parameters(spark, sf_dir):
    p = P.scaling_params(features(spark, sf_dir), FEATURES)
    return p.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("nan_median_fill", f"WITH p AS (SELECT bug, {_PIV} FROM ({RANKS}) GROUP BY bug) SELECT bug, coalesce(rank_T1::DOUBLE, (SELECT median(rank_T1) FROM p)) AS rank_T1, coalesce(rank_T2::DOUBLE, (SELECT median(rank_T2) FROM p)) AS rank_T2, coalesce(rank_T3, 0) AS rank_T3 FROM p")
def nan_median_fill(spark, sf_dir):
    w = P.pivot_tools(ranks(spark, sf_dir), ["bug"], TOOLS, {"rank": "min"}).withColumns({c: F.col(c).cast("double") for c in ("rank_T1", "rank_T2")})
    return P.fill_missing(w.select("bug", "rank_T1", "rank_T2", "rank_T3"), ["rank_T1", "rank_T2"], ["rank_T3"])


@query("low_variance_filter", f"WITH feats AS ({FEATURES_SQL}) SELECT feature FROM ({LONG_SQL}) GROUP BY feature HAVING count(DISTINCT value) < 5 OR stddev_samp(value) < 0.01 OR var_samp(value) < 0.001")
def low_variance_filter(spark, sf_dir):
    return redundancy.constant_columns(features(spark, sf_dir), FEATURES)


@query("redundancy_prune")
def redundancy_prune(spark, sf_dir):
    f = features(spark, sf_dir).withColumns({"price_again": F.col("o_totalprice") * 2, "half_items": F.col("n_items") / 2, "avg_tax__orig": F.col("avg_tax") + 1, "txt_x_word_count": F.col("n_items"), "txt_x_chars": F.col("n_items") * 6})
    names = [c for c in f.columns if c not in ("bug", "project")]
    return spark.createDataFrame(redundancy.prune(f, names, "bug"), "stage string, feature string")


@query("binary_features", f"WITH p AS (SELECT bug, (count(*) > 1)::INT::DOUBLE AS several, min(rank)::DOUBLE AS best FROM ({RANKS}) GROUP BY bug) SELECT 'several' AS feature, bool_and(several IN (0, 1)) AS is_binary FROM p UNION ALL SELECT 'best', bool_and(best IN (0, 1)) FROM p")
def binary_features(spark, sf_dir):
    p = ranks(spark, sf_dir).groupBy("bug").agg((F.count("*") > 1).cast("double").alias("several"), F.min("rank").cast("double").alias("best"))
    return S.long_form(p, ["bug"], ["several", "best"]).groupBy("feature").agg(F.bool_and(F.col("value").isin(0.0, 1.0)).alias("is_binary"))


@query("display_names", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug, regexp_replace(p_name, '([&%$#_{}])', '\\\\\\1', 'g') AS latex FROM part")
def display_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", C.slug(F.col("p_name")).alias("slug"), C.latex_escape(F.col("p_name")).alias("latex"))


@query("prefer_raw_values", f"WITH feats AS ({FEATURES_SQL}) SELECT bug, coalesce(CASE WHEN n_items > 3 THEN sum_price END, o_totalprice) AS value FROM feats")
def prefer_raw_values(spark, sf_dir):
    return features(spark, sf_dir).select("bug", F.coalesce(F.when(F.col("n_items") > 3, F.col("sum_price")), F.col("o_totalprice")).alias("value"))


_GROUPS = {"o_totalprice": "price", "sum_price": "price", "avg_discount": "rate", "avg_tax": "rate", "n_items": "size"}


@query("feature_group_values", f"WITH feats AS ({FEATURES_SQL}) SELECT project, CASE feature {' '.join(f'WHEN {chr(39)}{f}{chr(39)} THEN {chr(39)}{g}{chr(39)}' for f, g in _GROUPS.items())} END AS grp, count(value)::BIGINT AS n, round(avg(value), 4) AS mean FROM ({LONG_SQL}) GROUP BY 1, 2")
def feature_group_values(spark, sf_dir):
    """Values under display groups, by a small spec that is joined to the long form."""
    spec = spark.createDataFrame(list(_GROUPS.items()), "feature string, grp string")
    long = S.long_form(features(spark, sf_dir), ["bug", "project"], FEATURES).join(F.broadcast(spec), "feature")
    return long.groupBy("project", "grp").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
