"""The numbers behind figures: densities on a grid, boxes with whiskers and what lies beyond them, and ROC curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .stats import meet, quantiles, value_ranks


def density(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int = 64) -> DataFrame:
    """(by, at, density): a Gaussian kernel density of each group at the middles of ``bins`` equal bins from ``low`` to ``high``.

    Values are counted by bin first, so what meets the grid is at most ``bins`` rows for each group; values outside count in the
    outermost bins. The bandwidth is Scott's, deviation / n ** 0.2, at least a bin's width. Missing values and NaN take no part.
    """
    width = (high - low) / bins
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull() & ~F.isnan(v))
    at = F.least(F.greatest(F.floor((v - low) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = d.groupBy(*by, at.alias("_bin")).agg(F.count("*").alias("_c"))
    size = d.groupBy(*by).agg(F.count("*").alias("_n"), F.stddev_samp(v).alias("_sd"))
    h = F.greatest(F.coalesce(F.col("_sd"), F.lit(0.0)) / F.pow(F.col("_n").cast("double"), F.lit(0.2)), F.lit(width))
    grid = meet(counts, size.withColumn("_h", h), by).withColumn("_g", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    z = (F.col("_g") - F.col("_bin")) * width / F.col("_h")
    kernel = F.sum(F.col("_c") * F.exp(-z * z / 2)) / F.first("_n") / F.first("_h") / (2 * 3.141592653589793) ** 0.5
    return grid.groupBy(*by, (low + (F.col("_g") + 0.5) * width).alias("at")).agg(kernel.alias("density"))


def boxes(df: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """(by, n, q1, median, q3, low_whisker, high_whisker, n_outliers): whiskers end at the last values within ``reach`` times the quartiles' distance."""
    v = F.col(value).cast("double")
    d = df.filter(v.isNotNull() & ~F.isnan(v))
    q = quantiles(d, by, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    far = reach * (F.col("q3") - F.col("q1"))
    inside = (v >= F.col("q1") - far) & (v <= F.col("q3") + far)
    out = meet(d, q, by, few=True).groupBy(*by, "q1", "median", "q3")
    out = out.agg(F.count("*").alias("n"), F.min(F.when(inside, v)).alias("low_whisker"), F.max(F.when(inside, v)).alias("high_whisker"), F.count_if(~inside).alias("n_outliers"))
    return out.select(*by, "n", "q1", "median", "q3", "low_whisker", "high_whisker", "n_outliers")


def roc_curve(df: DataFrame, by: list[str], score: str, y: str) -> DataFrame:
    """(by, threshold, tp, fp, tpr, fpr): the corners of each group's curve, score >= threshold being positive.

    The point of a threshold goes where it lies on the line from the one above to the one below, as it changes no figure; those of the highest and the
    lowest score stay, and (0, 0) with an infinite threshold comes before them. Rates are null where a class is absent. Missing scores and NaN take no part.
    Neighbours meet within ranges of values, and a range knows the last value of the one before, so no task holds a group.
    """
    d = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    r = value_ranks(d, by, score, {"p": F.coalesce(F.col(y).cast("int"), F.lit(0))}, ranges_too=True)
    step = F.struct(F.col("p"), (F.col("c") - F.col("p")).alias("n"))
    last = r.groupBy(*by, "_range").agg(F.max_by(step, score).alias("_last"))
    last = last.select(*by, "_range", F.lag("_last").over(W.partitionBy(*by).orderBy("_range")).alias("_before"))
    below = F.lag(step).over(W.partitionBy(*by, "_range").orderBy(score))
    r = meet(r, last, [*by, "_range"], few=True).withColumn("_next", F.coalesce(below, F.col("_before")))
    n = F.col("c") - F.col("p")
    corner = F.col("_next").isNull() | (F.col("before_c") + F.col("c") == F.col("all_c")) | (F.col("p") * F.col("_next.n") != n * F.col("_next.p"))
    tp = F.col("all_p") - F.col("before_p")
    pos, neg = F.col("all_p"), F.col("all_c") - F.col("all_p")
    fp = neg - (F.col("before_c") - F.col("before_p"))
    points = r.filter(corner).select(*by, F.col(score).cast("double").alias("threshold"), tp.cast("long").alias("tp"), fp.cast("long").alias("fp"), pos.alias("_pos"), neg.alias("_neg"))
    zero = r.groupBy(*by).agg(F.max(pos).alias("_pos"), F.max(neg).alias("_neg")).select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), "_pos", "_neg")
    out = points.unionByName(zero)
    return out.select(*by, "threshold", "tp", "fp", F.try_divide("tp", "_pos").alias("tpr"), F.try_divide("fp", "_neg").alias("fpr"))
