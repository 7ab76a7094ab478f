"""Summaries of embedding arrays as Column expressions, and features of reports' sentence embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def summary(v: Column) -> dict[str, Column]:
    """Norm, mean, population deviation, extremes, share of near-zero entries, positives over negatives plus one."""
    v = as_doubles(v)
    n = F.size(v)
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total(v), n)
    square = total(F.transform(v, lambda x: x * x))
    return {
        "embedding_norm": F.sqrt(square),
        "embedding_mean": mean,
        "embedding_std": F.sqrt(F.try_divide(total(F.transform(v, lambda x: (x - mean) * (x - mean))), n)),
        "embedding_min": F.array_min(v),
        "embedding_max": F.array_max(v),
        "embedding_sparsity": F.try_divide(F.size(F.filter(v, lambda x: F.abs(x) < 0.01)).cast("double"), n),
        "embedding_pos_neg_ratio": F.size(F.filter(v, lambda x: x > 0)) / (F.size(F.filter(v, lambda x: x < 0)) + 1),
    }


def unit(v: Column) -> Column:
    v = as_doubles(v)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def mean_pairwise_cosine(df: DataFrame, by: str, v: str, dims: int, empty: float = 0.0) -> DataFrame:
    """(by, n, cosine): the mean over all pairs of a group's vectors, from the sum of their unit vectors: no pairs are made. ``empty`` for fewer than two."""
    u = df.select(by, unit(F.col(v)).alias("u"))
    s = u.groupBy(by).agg(F.count("*").alias("n"), *[F.sum(F.get("u", F.lit(i))).alias(f"s{i}") for i in range(dims)])
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, dims)), F.col("s0") * F.col("s0"))
    n = F.col("n").cast("double")
    return s.select(by, "n", F.when(F.col("n") > 1, F.try_divide(square - n, n * (n - 1))).otherwise(F.lit(empty)).alias("cosine"))


def _diversity(vectors: np.ndarray) -> tuple[float, float, float]:
    """Entropy of the shares of variance, and the spread along the first two directions."""
    if len(vectors) < 2:
        return 0.0, 0.0, 0.0
    centred = vectors - vectors.mean(0)
    _, s, right = np.linalg.svd(centred, full_matrices=False)
    var = s * s
    if var.sum() <= 1e-18:
        return 0.0, 0.0, 0.0
    share = var / var.sum()
    along = centred @ right[:2].T
    spread = along.std(0)
    return float(-(share * np.log(share + 1e-10)).sum()), float(spread[0]), float(spread[1]) if len(spread) > 1 else 0.0


def semantic_diversity(df: DataFrame, by: str, v: str) -> DataFrame:
    """(by, n, semantic_entropy, semantic_spread_pc1, semantic_spread_pc2) of each group's vectors: a report's sentences, so a group is small."""
    kind = df.schema[by].dataType.simpleString()

    def one(pdf):
        import pandas as pd

        e, a, b = _diversity(np.stack(pdf[v].tolist()).astype(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(pdf)], "semantic_entropy": [e], "semantic_spread_pc1": [a], "semantic_spread_pc2": [b]})

    return df.filter(F.col(v).isNotNull()).select(by, v).groupBy(by).applyInPandas(one, f"{by} {kind}, n long, semantic_entropy double, semantic_spread_pc1 double, semantic_spread_pc2 double")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A stand-in for a sentence encoder: words hashed with signs into ``dims`` sums, scaled to length 1. It says how alike vocabularies are, no more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    zero = F.array_repeat(F.lit(0.0), dims)
    add = lambda a, w: F.transform(a, lambda x, i: x + F.when(i == F.pmod(F.xxhash64(w), F.lit(dims)), F.when(F.pmod(F.xxhash64(F.lit("s"), w), F.lit(2)) == 0, 1.0).otherwise(-1.0)).otherwise(0.0))
    return unit(F.aggregate(words, zero, add))
