"""Correlations of many features at once, their clusters, and what can go without loss."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .stats import meet, long_form, spearman, value_ranks

# Endings of statistics of a column, and of measures of a text's length.
FAMILY = r"__orig(_(mean|std|min|median|max))?$"
LENGTH = r"_(char_len|chars|length|word_count|line_count|avg_words_per_line)$"
KEPT_LENGTHS = ("word_count", "line_count")


def _partial(features: list[str]):
    """Rows (features, ranks) as partial sums of all pairs i <= j: products of ranks, and how often both are there."""
    d = len(features)
    place = {f: i for i, f in enumerate(features)}
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("product", pa.float64()), ("both", pa.int64())])

    def run(batches):
        gram, both = np.zeros((d, d)), np.zeros((d, d))
        for b in batches:
            names, ranks = b.column(0), b.column(1)
            rows = np.repeat(np.arange(len(b)), names.value_lengths().to_numpy(zero_copy_only=False))
            which = np.array([place[f] for f in names.flatten().to_pylist()], int)
            x, there = np.zeros((len(b), d)), np.zeros((len(b), d))
            x[rows, which], there[rows, which] = ranks.flatten().to_numpy(zero_copy_only=False), 1
            gram += x.T @ x
            both += there.T @ there
        i, j = np.triu_indices(d)
        some = both[i, j] > 0
        yield pa.RecordBatch.from_arrays([pa.array(i[some].astype(np.int32)), pa.array(j[some].astype(np.int32)), pa.array(gram[i, j][some]), pa.array(both[i, j][some].astype(np.int64))], schema=schema)

    return run


def spearman_matrix(long: DataFrame, key: str, features: list[str] | None = None) -> DataFrame:
    """Absolute Spearman correlation of every two features (feature_a < feature_b), pairwise complete, from (key, feature, value) without repeated keys.

    Each feature is ranked once, over its distinct values. Rows meet by key, and a Gram matrix of centred ranks, summed by
    partition first, has all pairs. Two features that are missing in the same rows have the ranks of their common rows, so that is exact; a pair
    whose rows differ is ranked again over those that have both. (feature_a, feature_b, n, rho); a constant side gives null.
    """
    long = scratch.stored(long.select(key, "feature", "value"), "long")
    names = sorted(features if features is not None else [r[0] for r in long.select("feature").distinct().collect()])
    ranked = value_ranks(long, ["feature"], "value", {}).select("feature", "value", (F.col("avg_rank") - (F.col("all_c") + 1) / 2).alias("r"))
    rows = meet(long, ranked, ["feature", "value"]).groupBy(key).agg(F.collect_list(F.struct("feature", "r")).alias("x"))
    sums = rows.select("x.feature", "x.r").mapInArrow(_partial(names), "i int, j int, product double, both long").groupBy("i", "j").agg(F.sum("product").alias("product"), F.sum("both").alias("both"))
    sums = scratch.stored(sums, "gram")
    own = sums.filter("i = j").select("i", F.col("product").alias("own"), F.col("both").alias("n_own"))  # a row for each feature
    a, b = (F.broadcast(own.toDF(k, f"own_{k}", f"n_{k}")) for k in "ij")
    label = lambda k: F.get(F.array(*map(F.lit, names)), F.col(k))
    pairs = sums.filter("i < j").join(a, "i").join(b, "j").select(label("i").alias("feature_a"), label("j").alias("feature_b"), F.col("both").alias("n"), F.abs(F.try_divide("product", F.sqrt(F.col("own_i") * F.col("own_j")))).alias("rho"), ((F.col("both") == F.col("n_i")) & (F.col("both") == F.col("n_j"))).alias("same"))
    out = pairs.filter("same").drop("same")
    odd = pairs.filter("not same").select("feature_a", "feature_b")
    if odd.isEmpty():
        return out
    x = long.select(key, F.col("feature").alias("feature_a"), F.col("value").alias("va")).join(F.broadcast(odd), "feature_a")
    y = long.select(key, F.col("feature").alias("feature_b"), F.col("value").alias("vb"))
    again = spearman(x.join(y, [key, "feature_b"]), ["feature_a", "feature_b"], "va", "vb")
    return out.unionByName(again.withColumn("rho", F.abs("rho")))


def average_linkage(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """(a, b, height) of each merge of items a and b's clusters: chains of nearest neighbours, distances updated from those of the parts."""
    d = np.array(dist, float)
    n = len(d)
    np.fill_diagonal(d, np.inf)
    size, alive, merges, chain = np.ones(n), np.ones(n, bool), [], []
    while len(merges) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            at = chain[-1]
            near = np.where(alive, d[at], np.inf)
            best = int(near.argmin())
            if len(chain) > 1 and near[chain[-2]] <= near[best]:
                best = chain[-2]
                break
            chain.append(best)
        a, b = chain.pop(), chain.pop()
        merges.append((a, b, float(d[a, b])))
        mixed = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        alive[b] = False
        d[a] = d[:, a] = np.where(alive, mixed, np.inf)
        d[a, a] = np.inf
        size[a] += size[b]
    return merges


def clusters(names: list[str], rho: dict[tuple[str, str], float], apart: float = 0.05) -> list[list[str]]:
    """Average-linkage clusters at distance 1 - |rho| of at most ``apart``; a pair that is missing is 1 apart. Columns are few, so this runs on the driver."""
    names = sorted(names)
    place = {c: i for i, c in enumerate(names)}
    dist = np.ones((len(names), len(names)))
    for (a, b), r in rho.items():
        if a in place and b in place:
            dist[place[a], place[b]] = dist[place[b], place[a]] = 1 - abs(r)
    root = list(range(len(names)))

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for a, b, height in average_linkage(dist):
        if height <= apart:
            root[top(b)] = top(a)
    groups: dict[int, list[str]] = {}
    for i, c in enumerate(names):
        groups.setdefault(top(i), []).append(c)
    return sorted(groups.values())


def collapsed(columns: list[str]) -> list[tuple[str, str]]:
    """(stage, column) of what names alone tell: all but one of a column's statistics (itself, else the median, else the first), and of the
    measures of a text's length all but words and lines."""
    gone = []
    families: dict[str, list[str]] = {}
    for c in columns:
        families.setdefault(re.sub(FAMILY, "", c), []).append(c)
    for base, family in families.items():
        stay = base if base in family else next((c for c in family if "median" in c), family[0])
        gone += [("family", c) for c in family if c != stay]
    dropped = {c for _, c in gone}
    texts: dict[str, list[str]] = {}
    for c in columns:
        if c.startswith("txt_") and c not in dropped:
            texts.setdefault(re.sub(LENGTH, "", c), []).append(c)
    for kin in texts.values():
        stay = [c for c in kin if c.endswith(KEPT_LENGTHS)] or kin[:1]
        gone += [("length", c) for c in kin if c not in stay]
    return gone


def spread(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, n_distinct, std, var) of each column, over the values that are there; equal values meet before they are counted."""
    long = long_form(df, [], columns)
    each = long.groupBy("feature", "value").agg(F.count("*").alias("c")).groupBy("feature").agg(F.sum("c").alias("n"), F.count("*").alias("n_distinct"))
    vary = long.groupBy("feature").agg(F.stddev_samp("value").alias("std"), F.var_samp("value").alias("var"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    out = every.join(F.broadcast(each), "feature", "left").join(F.broadcast(vary), "feature", "left")  # a row for each column
    return out.fillna(0, ["n", "n_distinct"])


def constant_columns(df: DataFrame, columns: list[str], distinct: int = 5, std: float = 0.01, var: float = 0.001) -> DataFrame:
    """(feature) of columns with fewer than ``distinct`` values or that hardly vary."""
    few = (F.col("n_distinct") < distinct) | (F.coalesce("std", F.lit(0.0)) < std) | (F.coalesce("var", F.lit(0.0)) < var)
    return spread(df, columns).filter(few).select("feature")


def prune(df: DataFrame, columns: list[str], key: str, same: float = 0.999, apart: float = 0.05) -> list[tuple[str, str]]:
    """(stage, column) of what goes: by name (:func:`collapsed`), constant columns, copies of an earlier column, and all but one of each cluster of correlated ones.

    The one that stays varies most, missing values counted against it. The driver holds a row for each pair of columns.
    """
    gone = collapsed(columns)
    live = [c for c in columns if c not in {g for _, g in gone}]
    flat = {r.feature for r in constant_columns(df, live).collect()} if live else set()
    gone += [("constant", c) for c in live if c in flat]
    live = [c for c in live if c not in flat]
    rho = {(r.feature_a, r.feature_b): r.rho or 0.0 for r in spearman_matrix(long_form(df, [key], live), key, live).collect()} if len(live) > 1 else {}
    for i, b in enumerate(live):
        if any(("duplicate", a) not in gone and rho.get((min(a, b), max(a, b)), 0) >= same for a in live[:i]):
            gone.append(("duplicate", b))
    live = [c for c in live if ("duplicate", c) not in gone]
    if live:
        rows = df.count()
        worth = {r.feature: (r["var"] or 0.0) * r.n / max(1, rows) for r in spread(df, live).collect()}
        for g in clusters(live, rho, apart):
            stay = max(g, key=lambda c: (worth[c], c))
            gone += [("correlated", c) for c in g if c != stay]
    return gone
