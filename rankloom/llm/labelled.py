"""Bounded samples of labelled documents, for fitting on the driver, and the calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, longest: int, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` documents of each class 0 and 1 of at most ``longest`` code points, and their labels.

    Those first in the order of a hash of their id, so that reruns agree. ``learn`` is a condition on the labels' rows. An
    id that repeats with both labels counts as 1, and of its texts the least; null labels, and ids without a document or with
    a null text, are left out.
    """
    lab = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    lab = (lab.filter(learn) if learn is not None else lab).groupBy("doc_id").agg(F.max(label).alias("y"))
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.length(text).alias("n")).filter(F.col("n") <= longest).groupBy("doc_id").agg(F.max("n").alias("n"))
    have = lab.join(sized, "doc_id", "left_semi")
    order = F.xxhash64("doc_id")
    ids = [have.filter(F.col("y") == y).select("doc_id", "y", order.alias("h")).orderBy("h", "doc_id").limit(per_class) for y in (0, 1)]
    picked = ids[0].union(ids[1]).collect()
    if not picked:
        return [], np.zeros(0, np.int8)
    spark = docs.sparkSession
    few = spark.createDataFrame([(r.doc_id, r.y, r.h) for r in picked], f"doc_id {docs.schema[doc_id].dataType.simpleString()}, y int, h long")
    got = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(few), "doc_id").filter(F.length("text") <= longest)
    got = got.groupBy("doc_id", "y", "h").agg(F.min("text").alias("text"))
    rows = sorted({(r.h, r.doc_id, r.text, r.y) for r in got.collect()})
    return [r[2] for r in rows], np.array([r[3] for r in rows], np.int8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights (the last one constant) by Newton's method with step halving on standardised columns, returned for the columns as they are."""
    mean, sd = x.mean(0), x.std(0) + 1e-12
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    shrink = np.append(np.full(x.shape[1], ridge), 1e-3)
    loss = lambda w: np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (shrink * w * w).sum() / 2
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(shrink), z.T @ (p - y) + shrink * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    own = w[:-1] / sd
    return np.append(own, w[-1] - own @ mean)
