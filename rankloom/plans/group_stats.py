"""Group comparisons: all against none, one tool against the rest, pairs of tools, difficulty."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema as C
from .. import scratch
from ..operators import coded, logits
from ..operators import ranking as R
from ..operators import redundancy
from ..operators import stats as S
from ..operators.reshape import standard_scale
from .base import FEATURES, FEATURES_SQL, LONG_SQL, TOOLS, features, flags_sql, query, ranks, tidy, two_groups_sql

K, N = 25, len(TOOLS)


def _flags(spark, sf_dir, k=K):
    return R.success_flags(ranks(spark, sf_dir), "bug", TOOLS, k)


def _long(spark, sf_dir):
    return S.long_form(features(spark, sf_dir), ["bug", "project"], FEATURES)


@query("success_flags_topk", f"SELECT bug, {', '.join(f'found_{t}' for t in TOOLS)}, num_found::INT AS num_found FROM ({flags_sql(10)})")
def success_flags_topk(spark, sf_dir):
    return _flags(spark, sf_dir, 10)


@query("tool_membership_upset", f"SELECT concat_ws(',', {', '.join(f"CASE WHEN found_{t} THEN '{t}' END" for t in TOOLS)}) AS members, count(*)::BIGINT AS n FROM ({flags_sql(10)}) GROUP BY 1")
def tool_membership_upset(spark, sf_dir):
    return R.membership(_flags(spark, sf_dir, 10), TOOLS).groupBy("members").agg(F.count("*").alias("n"))


_SIZES = {f"found_{t}": f"found_{t}" for t in TOOLS} | {f"only_{t}": f"found_{t} AND num_found = 1" for t in TOOLS} | {"none": "num_found = 0", "any": "num_found > 0", "all": f"num_found = {N}", "exactly_one": "num_found = 1"}


@query("upset_set_sizes", f"WITH f AS ({flags_sql(10)}) " + " UNION ALL ".join(f"SELECT '{k}' AS name, (count(*) FILTER (WHERE {c}))::BIGINT AS n FROM f" for k, c in _SIZES.items()))
def upset_set_sizes(spark, sf_dir):
    return R.set_sizes(_flags(spark, sf_dir, 10), TOOLS)


_ALL_NONE = f"SELECT feature, value, num_found = {N} AS is_first FROM ({LONG_SQL}) JOIN flags USING (bug) WHERE num_found IN (0, {N})"


@query("all_vs_none_stats", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), {two_groups_sql(_ALL_NONE, ['feature'])}")
def all_vs_none_stats(spark, sf_dir):
    f = _flags(spark, sf_dir).filter(F.col("num_found").isin(0, N)).select("bug", (F.col("num_found") == N).alias("is_first"))
    return tidy(S.two_groups(_long(spark, sf_dir).join(f, "bug"), ["feature"]), ["feature"])


@query("all_vs_none_tested")
def all_vs_none_tested(spark, sf_dir):
    """All thresholds at once, with p, Holm within each, and practical significance."""
    r = ranks(spark, sf_dir)
    parts = [R.success_flags(r, "bug", TOOLS, k).filter(F.col("num_found").isin(0, N)).select("bug", F.lit(k).alias("k"), (F.col("num_found") == N).alias("is_first")) for k in (5, 10, 25)]
    groups = parts[0].union(parts[1]).union(parts[2])
    stats = S.with_p(S.two_groups(_long(spark, sf_dir).join(groups, "bug"), ["k", "feature"])).filter((F.col("n1") >= 5) & (F.col("n2") >= 5))
    return S.significant(S.holm(stats, ["k"], tie=["feature"]))


_MODES = f"""
cnt AS (SELECT {", ".join(f"count(*) FILTER (WHERE found_{t} AND num_found = 1) AS u_{t}, count(*) FILTER (WHERE num_found - found_{t}::INT = {N - 1}) AS a_{t}, count(*) FILTER (WHERE num_found - found_{t}::INT > 0) AS o_{t}" for t in TOOLS)} FROM flags),
grp AS ({" UNION ALL ".join(f"SELECT '{t}' AS tool, bug, found_{t} AND num_found = 1 AS is_first, CASE WHEN a_{t} >= 5 THEN 'all' WHEN o_{t} < 5 AND u_{t} >= 10 THEN 'majority' ELSE 'any' END AS mode, num_found - found_{t}::INT AS others FROM flags, cnt WHERE u_{t} >= 5" for t in TOOLS)}),
sel AS (SELECT * FROM grp WHERE is_first OR CASE mode WHEN 'all' THEN others = {N - 1} WHEN 'majority' THEN others >= {N // 2} ELSE others > 0 END)"""
_REST = f"SELECT tool, mode, feature, value, is_first FROM ({LONG_SQL}) JOIN sel USING (bug)"


@query("tool_vs_rest_stats", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), {_MODES}, {two_groups_sql(_REST, ['tool', 'mode', 'feature'])}")
def tool_vs_rest_stats(spark, sf_dir):
    g = R.unique_groups(_flags(spark, sf_dir), TOOLS, "bug")
    by = ["tool", "mode", "feature"]
    return tidy(S.two_groups(_long(spark, sf_dir).join(g, "bug"), by), by)


_PAIRS = [(a, b) for i, a in enumerate(TOOLS) for b in TOOLS[i + 1 :]]
_PAIR = " UNION ALL ".join(f"SELECT '{a}|{b}' AS pair, bug, found_{a} AS is_first FROM flags WHERE found_{a} <> found_{b}" for a, b in _PAIRS)


@query("pairwise_unique_stats", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), {two_groups_sql(f'SELECT pair, feature, value, is_first FROM ({LONG_SQL}) JOIN ({_PAIR}) USING (bug)', ['pair', 'feature'])}")
def pairwise_unique_stats(spark, sf_dir):
    f = _flags(spark, sf_dir)
    found = sum((F.col(f"found_{t}").cast("int") * F.lit(1 << i) for i, t in enumerate(TOOLS)), F.lit(0))
    wide = scratch.stored(features(spark, sf_dir).drop("project").join(f.select("bug", found.alias("found")), "bug"), "rows")
    has = lambda code, t: code >> TOOLS.index(t) & 1
    sides = {f"{a}|{b}": [has(c, a) if has(c, a) != has(c, b) else None for c in range(1 << N)] for a, b in _PAIRS}
    return tidy(coded.two_groups(wide, FEATURES, "found", sides, "pair"), ["pair", "feature"])


@query("top_pair_features", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), st AS (WITH {two_groups_sql(f'SELECT pair, feature, value, is_first FROM ({LONG_SQL}) JOIN ({_PAIR}) USING (bug)', ['pair', 'feature'])}) SELECT pair, feature, delta, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY abs(delta) DESC, feature) AS k FROM st) WHERE k <= 3")
def top_pair_features(spark, sf_dir):
    w = W.partitionBy("pair").orderBy(F.desc(F.abs("delta")), "feature")
    return pairwise_unique_stats(spark, sf_dir).select("pair", "feature", "delta", F.row_number().over(w).alias("k")).filter("k <= 3")


_CATEGORY = (("price", "price"), ("avg_", "rate"), ("n_", "counts"))
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN contains(feature, '{s}') THEN '{c}'" for s, c in _CATEGORY) + " ELSE 'other' END"


def _category():
    """A feature's category, as a lookup over the few names that there are."""
    names = F.create_map(*[F.lit(x) for f in FEATURES for x in (f, C.category_of(f, _CATEGORY))])
    return F.try_element_at(names, F.col("feature"))


@query("category_best_features", f"""WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), st AS (WITH {two_groups_sql(f'SELECT pair, feature, value, is_first FROM ({LONG_SQL}) JOIN ({_PAIR}) USING (bug)', ['pair', 'feature'])}),
 k AS (SELECT *, {_CATEGORY_SQL} AS category FROM st WHERE delta IS NOT NULL) SELECT pair, category, feature, delta, effect_size FROM (SELECT *, row_number() OVER (PARTITION BY pair, category ORDER BY abs(delta) DESC, feature) AS i FROM k) WHERE i = 1 AND abs(delta) >= 0.02""")
def category_best_features(spark, sf_dir):
    """The feature of each category that tells two tools apart best, where it tells them apart at all."""
    best = S.best_of_category(pairwise_unique_stats(spark, sf_dir), ["pair"], _category(), F.abs("delta") >= 0.02)
    return best.select("pair", "category", "feature", "delta", "effect_size")


@query("feature_report", f"""WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), st AS (WITH {two_groups_sql(_ALL_NONE, ['feature'])}), d AS (SELECT feature, count(*)::BIGINT AS n, round(avg(value) + 1e-8::DOUBLE, 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, median(value) AS median, max(value) AS max FROM ({LONG_SQL}) GROUP BY 1)
 SELECT {_CATEGORY_SQL} AS category, feature, n, mean, std, min, median, max, n1, n2, delta, effect_size FROM d LEFT JOIN st USING (feature)""")
def feature_report(spark, sf_dir):
    """What each feature is like beside how it differs between bugs that all tools find and those that none finds."""
    r = S.feature_report(_long(spark, sf_dir), all_vs_none_stats(spark, sf_dir), _category())
    return r.select("category", "feature", "n", F.round(F.col("mean") + 1e-8, 4).alias("mean"), F.round("std", 4).alias("std"), "min", "median", "max", "n1", "n2", "delta", "effect_size")


_SP = """SELECT feature, count(*)::BIGINT AS n, round(corr(rx, ry), 6) AS rho FROM (SELECT feature,
 rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY feature ORDER BY num_found) + (count(*) OVER (PARTITION BY feature, num_found) - 1) / 2.0::DOUBLE AS ry FROM x) GROUP BY feature"""


@query("difficulty_spectrum_spearman", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), x AS (SELECT feature, value, num_found FROM ({LONG_SQL}) JOIN flags USING (bug)) {_SP}")
def difficulty_spectrum_spearman(spark, sf_dir):
    d = _long(spark, sf_dir).join(_flags(spark, sf_dir).select("bug", "num_found"), "bug")
    return S.spearman(d, ["feature"], "value", "num_found").withColumn("rho", F.round("rho", 6))


@query("difficulty_spectrum_tested")
def difficulty_spectrum_tested(spark, sf_dir):
    d = _long(spark, sf_dir).join(_flags(spark, sf_dir).select("bug", (F.col("num_found") / N).alias("rate")), "bug")
    out = S.holm(S.spearman(d, ["feature"], "value", "rate", p=True).withColumn("family", F.lit("all")), ["family"], tie=["feature"])
    return out.withColumn("direction", F.when(F.col("rho") > 0, "easier").otherwise("harder"))


def _chi_sql(name: str, where: str) -> str:
    """CTE ``name`` (l_suppkey, p): whether return flag and line status depend on each other in a supplier's lines."""
    return f"""{name}_c AS (SELECT l_suppkey, l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS o FROM lineitem WHERE {where} AND l_returnflag IS NOT NULL AND l_linestatus IS NOT NULL GROUP BY 1, 2, 3),
 {name}_e AS (SELECT *, sum(o) OVER (PARTITION BY l_suppkey) AS n, sum(o) OVER (PARTITION BY l_suppkey, a) * sum(o) OVER (PARTITION BY l_suppkey, b) / sum(o) OVER (PARTITION BY l_suppkey) AS e FROM {name}_c),
 {name} AS (SELECT l_suppkey, CASE WHEN (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) = 2 THEN round(exp(-greatest(sum(o * o / e) - any_value(n), 0) / 2), 9) END AS p FROM {name}_e GROUP BY 1)"""


def _dependence(lines):
    return S.independence(lines, ["l_suppkey"], "l_returnflag", "l_linestatus").select("l_suppkey", F.round("p_value", 9).alias("p"))


@query("holm_adjust", f"""WITH {_chi_sql('t', 'true')}, p AS (SELECT s_suppkey, s_nationkey, p AS p_value FROM supplier JOIN t ON l_suppkey = s_suppkey), s AS (SELECT *, (count(*) OVER (PARTITION BY s_nationkey) - row_number() OVER (PARTITION BY s_nationkey ORDER BY p_value, s_suppkey) + 1) * p_value AS st FROM p WHERE p_value IS NOT NULL),
 a AS (SELECT *, least(1.0::DOUBLE, max(st) OVER (PARTITION BY s_nationkey ORDER BY p_value, s_suppkey ROWS UNBOUNDED PRECEDING)) AS adj FROM s)
 SELECT s_suppkey, s_nationkey, p_value, round(adj, 6) AS pval_adj, round(adj, 9) <= 0.05 AS reject FROM a UNION ALL SELECT s_suppkey, s_nationkey, p_value, NULL, false FROM p WHERE p_value IS NULL""")
def holm_adjust(spark, sf_dir):
    """Which suppliers' lines have a return flag that depends on their status, adjusted within each nation."""
    from .base import table

    p = table(spark, sf_dir, "supplier").join(_dependence(table(spark, sf_dir, "lineitem")), F.col("s_suppkey") == F.col("l_suppkey")).select("s_suppkey", "s_nationkey", F.col("p").alias("p_value"))
    return S.holm(p, ["s_nationkey"], tie=["s_suppkey"]).withColumn("pval_adj", F.round("pval_adj", 6))


@query("category_difficulty", f"""WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), t AS ({' UNION ALL '.join(f"SELECT '{t}' AS tool, bug FROM flags WHERE found_{t}" for t in TOOLS)} UNION ALL SELECT 'overall', bug FROM flags)
 SELECT tool, project AS category, count(*)::BIGINT AS n, round(avg(n_items), 6) AS mean, median(n_items) AS median, round(stddev_samp(n_items), 6) AS std, min(n_items) AS min, max(n_items) AS max FROM t JOIN feats USING (bug) GROUP BY 1, 2 HAVING count(*) >= 5""")
def category_difficulty(spark, sf_dir):
    """Difficulty by category, for what each tool finds and overall."""
    f = _flags(spark, sf_dir)
    t = f.select("bug", F.explode(F.array_compact(F.array(*[F.when(F.col(f"found_{t}"), F.lit(t)) for t in TOOLS], F.lit("overall")))).alias("tool"))
    d = t.join(features(spark, sf_dir).select("bug", F.col("project").alias("category"), "n_items"), "bug")
    out = S.describe(d, ["tool", "category"], "n_items").withColumnRenamed("count", "n").filter("n >= 5")
    return out.select("tool", "category", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), "min", "max")


@query("roc_best_f1", """WITH d AS (SELECT doc_id, n_chars::DOUBLE AS score, toxic FROM documents JOIN labels USING (doc_id)),
 c AS (SELECT score, sum(sum(toxic)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k FROM d GROUP BY score),
 r AS (SELECT score, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ar, toxic FROM d),
 n AS (SELECT sum(toxic)::DOUBLE AS p, (count(*) - sum(toxic))::DOUBLE AS q FROM d)
 SELECT (SELECT p FROM n)::BIGINT AS n_pos, (SELECT q FROM n)::BIGINT AS n_neg, round(((SELECT sum(ar) FROM r WHERE toxic = 1) - (SELECT p * (p + 1) / 2 FROM n)) / (SELECT p * q FROM n), 6) AS auc, round((SELECT max(2 * tp::DOUBLE / ((SELECT p FROM n) + k)) FROM c), 6) AS best_f1""")
def roc_best_f1(spark, sf_dir):
    from .base import table

    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.lit(1).alias("g"), F.col("n_chars").cast("double").alias("score"), "toxic")
    return S.auc(d, ["g"], "score", "toxic").join(S.best_f1(d, ["g"], "score", "toxic"), "g").select("n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("best_f1", 6).alias("best_f1"))


@query("spearman_matrix", f"""WITH feats AS ({FEATURES_SQL}), l AS ({LONG_SQL}), x AS (SELECT a.feature AS feature_a, b.feature AS feature_b, a.value AS va, b.value AS vb FROM l a JOIN l b ON a.bug = b.bug AND a.feature < b.feature),
 r AS (SELECT feature_a, feature_b, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY va) + (count(*) OVER (PARTITION BY feature_a, feature_b, va) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY feature_a, feature_b ORDER BY vb) + (count(*) OVER (PARTITION BY feature_a, feature_b, vb) - 1) / 2.0::DOUBLE AS rb FROM x)
 SELECT feature_a, feature_b, count(*)::BIGINT AS n, round(abs(corr(ra, rb)), 6) AS rho FROM r GROUP BY 1, 2""")
def spearman_matrix(spark, sf_dir):
    return redundancy.spearman_matrix(_long(spark, sf_dir), "bug", FEATURES).withColumn("rho", F.round("rho", 6))


@query("stratified_delta_tertiles", f"WITH feats AS ({FEATURES_SQL}), flags AS ({flags_sql(K)}), c AS (SELECT quantile_cont(n_items, 1/3::DOUBLE) AS a, quantile_cont(n_items, 2/3::DOUBLE) AS b, min(n_items) AS lo, max(n_items) AS hi FROM feats), x AS (SELECT bug, CASE WHEN lo < a AND a < b AND b < hi THEN CASE WHEN n_items <= a THEN 1 WHEN n_items <= b THEN 2 ELSE 3 END END AS band FROM feats, c), {two_groups_sql(f'SELECT band, feature, value, num_found > 0 AS is_first FROM ({LONG_SQL}) JOIN x USING (bug) JOIN flags USING (bug) WHERE band IS NOT NULL', ['band', 'feature'])}")
def stratified_delta_tertiles(spark, sf_dir):
    """Effects within thirds of a scale variable."""
    f = features(spark, sf_dir)
    bands = S.tertiles(f, [], "n_items").select("bug", "band").filter("band is not null")
    d = S.long_form(f, ["bug"], FEATURES).join(bands, "bug").join(_flags(spark, sf_dir).select("bug", (F.col("num_found") > 0).alias("is_first")), "bug")
    return tidy(S.two_groups(d, ["band", "feature"]), ["band", "feature"])


@query("confound_logit")
def confound_logit(spark, sf_dir):
    """Each feature alone and with a scale variable beside it, what attenuates, and the verdict."""
    d = features(spark, sf_dir).join(_flags(spark, sf_dir).select("bug", (F.col("num_found") > 0).cast("int").alias("y")), "bug")
    long = d.withColumn("scale", F.col("n_items")).select("scale", "y", *FEATURES[:-1]).unpivot(["scale", "y"], FEATURES[:-1], "feature", "value")
    fits = logits.confound_fits(long)
    return fits.select("feature", "n", *[F.round(c, 4).alias(c) for c in ("raw_coef", "raw_p", "adj_coef", "adj_p", "attenuation")], "verdict")


_OPEN = "round(avg((l_linestatus = 'O')::INT) FILTER (WHERE l_returnflag = 'N'{w}) - avg((l_linestatus = 'O')::INT) FILTER (WHERE l_returnflag <> 'N'{w}), 9)"


@query("confound_verdict", f"""WITH {_chi_sql('t', 'true')}, {_chi_sql('u', 'l_quantity > 25')}, d AS (SELECT l_suppkey, {_OPEN.format(w='')} AS raw, {_OPEN.format(w=' AND l_quantity > 25')} AS adj FROM lineitem GROUP BY 1),
 v AS (SELECT d.l_suppkey, raw, adj, t.p AS raw_p, u.p AS adj_p FROM d LEFT JOIN t USING (l_suppkey) LEFT JOIN u ON u.l_suppkey = d.l_suppkey)
 SELECT l_suppkey, CASE WHEN adj_p IS NULL THEN 'model_failed' WHEN raw_p IS NULL OR raw_p >= 0.05 THEN 'not_significant_raw' WHEN adj_p < 0.05 AND sign(raw) = sign(adj) AND 100 * (1 - adj / nullif(raw, 0)) < 40 THEN 'survives' WHEN adj_p < 0.05 AND sign(raw) = sign(adj) THEN 'attenuated_but_significant' WHEN sign(raw) <> sign(adj) THEN 'sign_flip' ELSE 'vanishes_after_adjustment' END AS verdict FROM v""")
def confound_verdict(spark, sf_dir):
    """Whether what return flags say of open lines holds among large lines, too, by supplier: shares and tests of all lines and of the large ones."""
    from .base import table

    li = table(spark, sf_dir, "lineitem")
    large = F.col("l_quantity") > 25
    share = lambda ok: F.avg(F.when(ok, (F.col("l_linestatus") == "O").cast("int")))
    kept = F.col("l_returnflag") == "N"
    d = li.groupBy("l_suppkey").agg(F.round(share(kept) - share(~kept), 9).alias("raw"), F.round(share(kept & large) - share(~kept & large), 9).alias("adj"))
    d = d.join(_dependence(li).withColumnRenamed("p", "raw_p"), "l_suppkey", "left").join(_dependence(li.filter(large)).withColumnRenamed("p", "adj_p"), "l_suppkey", "left")
    return d.select("l_suppkey", S.verdict(F.col("raw_p"), F.col("adj_p"), F.col("raw"), F.col("adj")).alias("verdict"))
