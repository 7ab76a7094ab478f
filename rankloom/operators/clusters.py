"""Clusters of vectors: a centred projection, and k-means from many starts that advance together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.vectors import as_doubles

#: Rows that first centres are drawn from, those of the least hash; all rows take part in every step.
SEEDS = 4096


def projected(df: DataFrame, key: str, v: str, components: int = 50) -> DataFrame:
    """(key, p): vectors less their mean along the first principal components, as a written table.

    Null vectors and those with null or non-finite parts take no part; shorter vectors than the longest are zero where they end."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = as_doubles(F.col(v))
    fine = F.col(v).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = df.filter(fine).select(F.col(key), x.alias("_x"))
    n, count = rows.agg(F.max(F.size("_x")), F.count("*")).first()
    if not n:
        return rows.select(key, F.col("_x").alias("p")).filter(F.lit(False))
    d = min(components, n)
    if count == 1:  # has no covariance, and lies at its own mean
        return rows.select(key, F.array_repeat(F.lit(0.0), d).alias("p"))
    rows = rows.select(key, array_to_vector(F.concat("_x", F.array_repeat(F.lit(0.0), F.lit(n) - F.size("_x")))).alias("_v"))
    p = PCA(k=d, inputCol="_v", outputCol="_p").fit(rows).transform(rows).select(key, vector_to_array("_p").alias("p"))
    p = scratch.stored(p, "projected")
    mean = p.agg(F.array(*[F.avg(F.col("p")[i]) for i in range(d)]).alias("_m"))  # one row
    return p.crossJoin(F.broadcast(mean)).select(key, F.zip_with("p", "_m", lambda a, b: a - b).alias("p"))


def first_centres(x: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """(starts, k, dims): centres drawn in turn with probability in proportion to the squared distance from those that are there."""
    out = []
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        chosen = [x[rng.integers(len(x))]]
        for _ in range(k - 1):
            far = np.min([((x - c) ** 2).sum(1) for c in chosen], axis=0)
            total = far.sum()
            chosen.append(x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))])
        out.append(chosen)
    return np.array(out)


def _sums(points: DataFrame, centres: np.ndarray) -> dict:
    """(start, cluster): (rows, sum of squared distances, sums by dimension) of the nearest centres of every start, from one pass.

    A task keeps a row for each start and cluster, and so does what reaches the driver, whatever the number of points."""
    starts, k, dims = centres.shape

    def local(batches):
        n, cost, sums = np.zeros((starts, k)), np.zeros((starts, k)), np.zeros((starts, k, dims))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dims)
            for s in range(starts):
                d = ((x * x).sum(1)[:, None] - 2 * x @ centres[s].T + (centres[s] ** 2).sum(1)).clip(0)
                c = d.argmin(1)
                n[s] += np.bincount(c, minlength=k)
                cost[s] += np.bincount(c, d[np.arange(len(x)), c], minlength=k)
                np.add.at(sums[s], c, x)
        s, c = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1) * dims, pa.int32()), pa.array(sums[s, c].ravel(), pa.float64()))
        # The types are given, as a task without rows, such as a part of a file in which no row group begins, has nothing to infer them from.
        yield pa.record_batch([pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(n[s, c], pa.float64()), pa.array(cost[s, c], pa.float64()), lists], ["start", "cluster", "n", "cost", "sums"])

    parts = points.select("p").mapInArrow(local, "start int, cluster int, n double, cost double, sums array<double>")
    rows = parts.groupBy("start", "cluster").agg(F.sum("n"), F.sum("cost"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)])).collect()
    return {(r[0], r[1]): (r[2], r[3], np.array(r[4])) for r in rows}


def kmeans(points: DataFrame, key: str, k: int, starts: int = 10, seed: int = 42, most: int = 50, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centres and inertia of the best of ``starts`` runs over (key, p). Each pass over the points takes one step of every run that still moves.

    A run ends when its centres move by less than ``tol`` of the mean variance in a step, or after ``most`` steps. A centre without points stays.
    """
    sample = points.orderBy(F.xxhash64(F.lit(seed), key), key).limit(SEEDS).select("p").collect()
    x = np.array([r.p for r in sample])
    centres = first_centres(x, k, starts, seed)
    close = tol * float(x.var(0).mean())
    moving = list(range(starts))
    for _ in range(most):
        found = _sums(points, centres[moving])
        still = []
        for i, s in enumerate(moving):
            new = centres[s].copy()
            for c in range(k):
                if (i, c) in found:
                    n, _, total = found[i, c]
                    new[c] = total / n
            moved = float(((new - centres[s]) ** 2).sum())
            centres[s] = new
            if moved > close:
                still.append(s)
        moving = still
        if not moving:
            break
    cost = np.zeros(starts)
    for (s, _), (_, c, _) in _sums(points, centres).items():
        cost[s] += c
    best = int(cost.argmin())
    return centres[best], float(cost[best])


def clusters(df: DataFrame, key: str, v: str, k: int = 10, components: int = 50, seed: int = 42, starts: int = 10) -> DataFrame:
    """(key, embedding_cluster, embedding_cluster_distance, embedding_cluster_separation, embedding_cluster_size): the nearest centre, how far it and the next one are, and its rows.

    Repeated keys are rows of their own. Without a usable vector there are no rows; equal vectors share a cluster, so there may be fewer than ``k``.
    """
    p = projected(df, key, v, components)
    if p.isEmpty():
        kind = df.schema[key].dataType.simpleString()
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, embedding_cluster int, embedding_cluster_distance double, embedding_cluster_separation double, embedding_cluster_size bigint")
    p = scratch.stored(p, "centred")
    centres, _ = kmeans(p, key, k, starts, seed)
    at = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    far = F.transform(at, lambda c: F.sqrt(F.aggregate(F.zip_with(c, F.col("p"), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)))
    d = p.select(key, far.alias("d")).withColumn("embedding_cluster", (F.array_position("d", F.array_min("d")) - 1).cast("int"))
    size = d.groupBy("embedding_cluster").agg(F.count("*").alias("embedding_cluster_size"))  # k rows
    out = d.select(key, "embedding_cluster", F.array_min("d").alias("embedding_cluster_distance"), F.get(F.array_sort("d"), F.lit(1)).alias("embedding_cluster_separation"))
    return out.join(F.broadcast(size), "embedding_cluster").select(key, "embedding_cluster", "embedding_cluster_distance", "embedding_cluster_separation", "embedding_cluster_size")
