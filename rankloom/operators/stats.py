"""Rank statistics over long tables: (keys..., value), many features and comparisons in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from ..functions.tails import correlation_p, mann_whitney_p


def long_form(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """(keys, feature, value): one row for each feature that has a value; NaN counts as none."""
    cast = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in features])
    return cast.unpivot(keys, features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))


def meet(left: DataFrame, right: DataFrame, on: list[str], few: bool = False) -> DataFrame:
    """Inner join on columns of the same name, where null is a value like another; ``few``: the right side has a bounded number of rows and may be broadcast."""
    right = F.broadcast(right) if few else right
    if not on:
        return left.crossJoin(right)  # one row
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= left[c].eqNullSafe(right[f"_r_{c}"])
    return left.join(right, same).drop(*[f"_r_{c}" for c in on])


#: Cuts are looked up among every such one first, then between two of them.
_STEP = 16


def in_ranges(each: DataFrame, by: list[str], value: str, whole: dict[str, Column], few: bool = True) -> DataFrame:
    """Add ``_range``, the number of the range of values that a row is in, and ``whole``, aggregates over its group.

    A sketch parts each group's rows into about as many ranges of equal size as there are shuffle partitions; a value is in one range only. ``each`` is a written table.
    """
    ranges = min(256, max(4, int(each.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cut = F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 20 * ranges).alias("_cuts")
    cuts = each.groupBy(*by).agg(cut, *[e.alias(n) for n, e in whole.items()]).withColumn("_every", F.filter("_cuts", lambda x, i: i % _STEP == 0))
    # Written, as a sketch differs with the order in which its parts meet: all readers must see the same cuts.
    each = meet(each, scratch.stored(cuts, "cuts"), by, few).withColumn("_range", F.size(F.filter("_every", lambda x: x < F.col(value))))
    between = F.filter(F.slice("_cuts", F.greatest(F.col("_range") - 1, F.lit(0)) * _STEP + 2, F.lit(_STEP - 1)), lambda x: x < F.col(value))
    return each.withColumn("_range", F.when(F.col("_range") > 0, (F.col("_range") - 1) * _STEP + 1 + F.size(between)).otherwise(0)).drop("_cuts", "_every")


def value_ranks(df: DataFrame, by: list[str], value: str, sums: dict[str, Column], weight: Column | None = None, few: bool = True, ranges_too: bool = False) -> DataFrame:
    """One row for each distinct value of a group: ``c`` (its rows, or their weight) and ``sums``, and of each of them before_ (over lower values) and all_ (over the group).

    ``avg_rank`` is the average rank, ties sharing it. No task holds a group: distinct values meet first, with their sums, in a table that is written at once, as
    it is read three times; a sketch of them parts each group into ranges of about equal size; sums of the ranges give what lies below a range, and a window sees
    the values of one range only. There are about as many ranges as shuffle partitions; where they are cut changes no result, and the cuts are written, too.
    Groups are comparisons by features, so a row for each of their ranges is broadcast; say ``few=False`` if ``by`` holds a key of the data.
    ``ranges_too`` leaves the range's number as ``_range``.
    """
    cols = {"c": F.count("*") if weight is None else F.sum(weight), **{n: F.sum(e) for n, e in sums.items()}}
    each = scratch.stored(df.groupBy(*by, value).agg(*[e.cast("double").alias(n) for n, e in cols.items()]), "values")
    each = in_ranges(each, by, value, {f"all_{n}": F.sum(n) for n in cols}, few)
    lower = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    parts = each.groupBy(*by, "_range").agg(*[F.sum(n).alias(f"_p_{n}") for n in cols])
    parts = parts.select(*by, "_range", *[F.coalesce(F.sum(f"_p_{n}").over(lower), F.lit(0.0)).alias(f"_b_{n}") for n in cols])
    within = W.partitionBy(*by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    out = meet(each, parts, [*by, "_range"], few)
    out = out.withColumns({f"before_{n}": F.coalesce(F.sum(n).over(within), F.lit(0.0)) + F.col(f"_b_{n}") for n in cols})
    return out.drop(*([] if ranges_too else ["_range"]), *[f"_b_{n}" for n in cols]).withColumn("avg_rank", F.col("before_c") + (F.col("c") + 1) / 2)


def _at(value: Column, place: Column, before: Column, c: Column) -> Column:
    """The value at a place (from 0) of a group in order, as an aggregate over the rows of :func:`value_ranks`."""
    return F.max(F.when((before <= place) & (place < before + c), value.cast("double")))


def _quantile(value: Column, q: float, before: Column, c: Column, all_: Column) -> Column:
    """The quantile ``q`` with linear interpolation, as an aggregate over the rows of :func:`value_ranks`."""
    place = (all_ - 1) * q
    low, high = F.floor(place), F.ceil(place)
    between = F.max(place - low)  # the same in all rows of a group
    return F.when(between > 0, (1 - between) * _at(value, low, before, c) + between * _at(value, high, before, c)).otherwise(_at(value, low, before, c))


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """Exact quantiles of each group, by name, of the values that are there; no task holds a group's values."""
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    r = value_ranks(d, by, value, {})
    return r.groupBy(*by).agg(*[_quantile(F.col(value), q, F.col("before_c"), F.col("c"), F.col("all_c")).alias(n) for n, q in wanted.items()])


def effect_label(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d.isNull(), None).when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").otherwise("large")


def two_groups(df: DataFrame, by: list[str], value: str = "value", first: str = "is_first", empty: float | None = None) -> DataFrame:
    """Compare rows where the boolean ``first`` is true with the others, in each group of ``by``.

    Returns by, n1, n2, median1, median2, mean1, mean2, u (of the first), ties (sum of t^3 - t), z and delta (Cliff's).
    Where one side is empty, u and z are null and delta is ``empty``.
    """
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    r = value_ranks(d, by, value, {"c1": F.col(first).cast("int")})
    r = r.withColumns({f"{x}c2": F.col(f"{x}c") - F.col(f"{x}c1") for x in ("", "before_", "all_")})
    out = r.groupBy(*by).agg(
        F.sum("c1").cast("long").alias("n1"),
        F.sum("c2").cast("long").alias("n2"),
        *[_quantile(F.col(value), 0.5, F.col(f"before_{c}"), F.col(c), F.col(f"all_{c}")).alias(n) for n, c in (("median1", "c1"), ("median2", "c2"))],
        F.try_divide(F.sum(F.col("c1") * F.col(value)), F.sum("c1")).alias("mean1"),
        F.try_divide(F.sum(F.col("c2") * F.col(value)), F.sum("c2")).alias("mean2"),
        F.sum(F.col("c1") * F.col("avg_rank")).alias("r1"),
        F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    both = (F.col("n1") > 0) & (F.col("n2") > 0)
    out = out.withColumn("u", F.when(both, F.col("r1") - n1 * (n1 + 1) / 2)).drop("r1")
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.when(both & (var > 0), (F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2 - 0.5) / F.sqrt(var))
    return out.withColumns({"z": z, "delta": F.coalesce(F.try_divide(2 * F.col("u"), n1 * n2) - 1, F.lit(empty).cast("double"))})


def with_p(stats: DataFrame) -> DataFrame:
    """Add the Mann-Whitney p and the effect's label to the rows of :func:`two_groups`."""
    return stats.withColumns({"p_value": mann_whitney_p("u", "n1", "n2", "ties"), "effect_size": effect_label(F.col("delta"))})


def holm(df: DataFrame, family: list[str], p: str = "p_value", tie: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Add pval_adj and reject by Holm's step-down within each family; a null p takes no part and is not rejected."""
    some = df.filter(F.col(p).isNotNull())
    w = W.partitionBy(*family).orderBy(p, *(tie or []))
    m = F.count("*").over(W.partitionBy(*family))
    some = some.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    some = some.withColumn("pval_adj", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(W.unboundedPreceding, 0)))).drop("_step")
    none = df.filter(F.col(p).isNull()).withColumn("pval_adj", F.lit(None).cast("double"))
    return some.unionByName(none).withColumn("reject", F.coalesce(F.col("pval_adj") <= alpha, F.lit(False)))


def significant(df: DataFrame, least_delta: float = 0.2) -> DataFrame:
    """Add abs_delta and practically_significant: rejected, and large enough."""
    return df.withColumns({"abs_delta": F.abs("delta"), "practically_significant": F.col("reject") & (F.abs("delta") >= least_delta)})


def independence(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, chi2, df, p_value) of Pearson's test that ``a`` and ``b`` don't depend on each other, for each group of ``by``.

    The p is exp(-chi2 / 2) for two degrees of freedom, as in a table of two by three, where that is exact; null for others. Rows with a missing value
    take no part. Rows are counted by cell first, and a group's cells, at most values of a times values of b, meet in one list.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").cast("double").alias("_o"))
    total = lambda *on: F.sum("_o").over(W.partitionBy(*by, *on))
    cells = cells.withColumns({"_n": total(), "_e": total("_a") * total("_b") / total()})
    # The cells that are there give sum of o^2 / e - n, which counts the empty ones, too.
    g = cells.groupBy(*by).agg(F.first("_n").alias("_n"), F.sum(F.col("_o") * F.col("_o") / F.col("_e")).alias("_s"), F.count_distinct("_a").alias("_ka"), F.count_distinct("_b").alias("_kb"))
    chi2 = F.greatest(F.col("_s") - F.col("_n"), F.lit(0.0))
    df_ = ((F.col("_ka") - 1) * (F.col("_kb") - 1)).cast("int")
    return g.select(*by, F.col("_n").cast("long").alias("n"), chi2.alias("chi2"), df_.alias("df"), F.when(df_ == 2, F.exp(-chi2 / 2)).alias("p_value"))


def best_of_category(tests: DataFrame, by: list[str], category: Column, gate: Column, size: str = "delta", name: str = "feature") -> DataFrame:
    """(all columns, category): in each group and category the row of the largest |size|, the first by name on ties, where it passes ``gate``.

    A category whose largest fails has no row, even if a smaller one passes. Rows without a size take no part. One aggregate, no window.
    """
    d = tests.filter(F.col(size).isNotNull()).withColumn("category", category)
    whole = F.struct(*[F.col(f"`{c}`") for c in d.columns])
    best = d.groupBy(*by, "category").agg(F.min_by(whole, F.struct(-F.abs(size), F.col(name))).alias("_b"))
    return best.select("_b.*").filter(gate)


def feature_report(long: DataFrame, tests: DataFrame, category: Column) -> DataFrame:
    """(category, feature, n, mean, std, min, median, max, and what ``tests`` has of the feature): every feature of the long form, tested or not."""
    d = describe(long, ["feature"], "value").select("feature", F.col("count").alias("n"), "mean", "std", "min", "median", "max")
    clash = set(d.columns) - {"feature"}
    right = tests.select(*[F.col(c).alias(f"test_{c}" if c in clash else c) for c in tests.columns])
    out = d.join(right, "feature", "left")
    return out.select(category.alias("category"), *out.columns)


def spearman(df: DataFrame, by: list[str], x: str, y: str, p: bool = False) -> DataFrame:
    """(by, n, rho) of rows where both are there; a constant side gives null. ``p`` adds p_value.

    Equal pairs meet first; each side is ranked over its distinct values (:func:`value_ranks`), and pairs get their ranks by joins.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").cast("double").alias("_w"))
    pairs = scratch.stored(pairs, "pairs")
    rank = lambda v: value_ranks(pairs, by, v, {}, F.col("_w")).select(*by, v, (F.col("avg_rank") - (F.col("all_c") + 1) / 2).alias(f"_r{v}"))
    d = meet(meet(pairs, rank("_x"), [*by, "_x"]), rank("_y"), [*by, "_y"])
    w, rx, ry = F.col("_w"), F.col("_r_x"), F.col("_r_y")
    out = d.groupBy(*by).agg(F.sum(w).cast("long").alias("n"), F.try_divide(F.sum(w * rx * ry), F.sqrt(F.sum(w * rx * rx) * F.sum(w * ry * ry))).alias("rho"))
    return out.withColumn("p_value", correlation_p("rho", "n")) if p else out


def auc(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """(by, n_pos, n_neg, auc), ties counting half; null with one class."""
    s = two_groups(df.withColumn("_first", F.col(y) == 1), by, score, "_first")
    return s.select(*by, F.col("n1").alias("n_pos"), F.col("n2").alias("n_neg"), F.try_divide("u", F.col("n1").cast("double") * F.col("n2")).alias("auc"))


def roc_points(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """(by, score, tp, fp, pos, neg) with every score as threshold, score >= threshold being positive."""
    r = value_ranks(df.filter(F.col(score).isNotNull()), by, score, {"p": F.col(y).cast("int")})
    tp, found = F.col("all_p") - F.col("before_p"), F.col("all_c") - F.col("before_c")
    return r.select(*by, score, tp.alias("tp"), (found - tp).alias("fp"), F.col("all_p").alias("pos"), (F.col("all_c") - F.col("all_p")).alias("neg"))


def best_f1(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    r = roc_points(df, by, score, y)
    return r.groupBy(*by).agg(F.max(F.try_divide(2 * F.col("tp"), F.col("pos") + F.col("tp") + F.col("fp"))).alias("best_f1"))


def z_scores(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """Population z of a value in its group; 0 where the group doesn't vary."""
    w = W.partitionBy(*by)
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)), F.lit(0.0)))


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, mean, std (sample), min, quartiles and max of each group."""
    v = F.col(value)
    plain = df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("min"), F.max(v).cast("double").alias("max"))
    some = quantiles(df, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    if by:
        right = some.withColumnsRenamed({c: f"_r_{c}" for c in by})
        same = F.lit(True)
        for c in by:
            same &= plain[c].eqNullSafe(right[f"_r_{c}"])
        out = plain.join(right, same, "left")
    else:
        out = plain.join(some, F.lit(True), "left")
    return out.select(*by, "count", "mean", "std", "min", "q1", "median", "q3", "max")


def tertiles(df: DataFrame, by: list[str], value: str, out: str = "band") -> DataFrame:
    """Add the right-closed third of ``value`` (1, 2, 3); null where edges coincide or the value is missing."""
    v = F.col(value)
    cuts = meet(df.groupBy(*by).agg(F.min(v).alias("_0"), F.max(v).alias("_3")), quantiles(df, by, value, {"_1": 1 / 3, "_2": 2 / 3}), by)
    d = meet(df, cuts, by)
    apart = (F.col("_0") < F.col("_1")) & (F.col("_1") < F.col("_2")) & (F.col("_2") < F.col("_3"))
    band = F.when(apart & v.isNotNull(), F.when(v <= F.col("_1"), 1).when(v <= F.col("_2"), 2).otherwise(3))
    return d.withColumn(out, band).drop("_0", "_1", "_2", "_3")


def verdict(raw_p: Column, adj_p: Column, raw: Column, adj: Column, alpha: float = 0.05, most: float = 40.0) -> Column:
    """What is left of an effect when scale is held fixed; ``most`` is the attenuation in percent that an effect survives."""
    sign = F.signum(raw) == F.signum(adj)
    lost = 100 * (1 - F.try_divide(adj, raw))
    return (
        F.when(adj_p.isNull(), "model_failed")
        .when(raw_p.isNull() | (raw_p >= alpha), "not_significant_raw")
        .when((adj_p < alpha) & sign & (lost < most), "survives")
        .when((adj_p < alpha) & sign, "attenuated_but_significant")
        .when(~sign, "sign_flip")
        .otherwise("vanishes_after_adjustment")
    )
