"""Logistic regressions of many features at once, each alone and with a scale variable beside it."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions.tails import normal_sf
from .stats import verdict

#: Models by name: which of (constant, feature, scale) they have.
MODELS = {"raw": (0, 1), "adj": (0, 1, 2)}


def _sums(which: tuple[int, ...], name: str) -> dict[str, Column]:
    """The gradient and the Hessian of one model as aggregates, and its log-likelihood."""
    x = [F.lit(1.0), F.col("f"), F.col("s")]
    eta = sum((F.col(f"{name}{i}") * x[i] for i in which), F.lit(0.0))
    p = 1 / (1 + F.exp(-eta))
    out = {f"{name}_g{i}": F.sum((F.col("y") - p) * x[i]) for i in which}
    out |= {f"{name}_h{i}{j}": F.sum(p * (1 - p) * x[i] * x[j]) for i in which for j in which if i <= j}
    return out | {f"{name}_l": F.sum(F.col("y") * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta))))}


def confound_fits(long: DataFrame, value: str = "value", scale: str = "scale", y: str = "y", least: int = 30, steps: int = 9, close: float = 1e-9) -> DataFrame:
    """(feature, n, raw_coef, raw_p, adj_coef, adj_p, attenuation, verdict) of logits of ``y`` on each feature, alone and with ``scale``.

    ``long`` is (feature, value, scale, y); rows that miss one of them take no part. Both columns are standardised over a feature's
    rows (population deviation). All models take their Newton steps together: a step is one aggregate, by feature, of the gradients and
    Hessians of both, and the driver solves systems of at most three unknowns for each feature; so there are at most ``steps`` + 2 jobs,
    however many features there are. A feature with fewer than ``least`` rows or one class is left out. A model that is singular or doesn't settle, as where
    a threshold parts the classes, has null figures.
    """
    spark = long.sparkSession
    rows = long.select("feature", F.col(value).cast("double").alias("f"), F.col(scale).cast("double").alias("s"), F.col(y).cast("double").alias("y"))
    rows = rows.filter("f is not null and s is not null and y is not null and not isnan(f) and not isnan(s)")
    known = rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), *[e(c).alias(f"{m}_{c}") for c in "fs" for m, e in (("avg", F.avg), ("sd", F.stddev_pop))])
    known = known.filter((F.col("n") >= least) & (F.col("hits") > 0) & (F.col("hits") < F.col("n")))
    z = lambda c: F.try_divide(F.col(c) - F.col(f"avg_{c}"), F.col(f"sd_{c}"))
    rows = scratch.stored(rows.join(F.broadcast(known), "feature").select("feature", "n", z("f").alias("f"), z("s").alias("s"), "y"), "fits")  # a row for each feature
    sizes = {r.feature: r.n for r in rows.groupBy("feature").agg(F.first("n").alias("n")).collect()}
    beta = {(f, m): np.zeros(len(w)) for f in sizes for m, w in MODELS.items()}
    done: dict[tuple[str, str], tuple[float, float]] = {}
    open_ = set(beta)
    before: dict[tuple[str, str], float] = {}
    for _ in range(steps):
        if not open_:
            break
        names = [f"{m}{i}" for m, w in MODELS.items() for i in w]
        now = [(f, *[float(beta[f, m][k]) for m, w in MODELS.items() for k in range(len(w))]) for f in sorted({f for f, _ in open_})]
        at = spark.createDataFrame(now, "feature string, " + ", ".join(f"{c} double" for c in names))
        sums = [e.alias(c) for m, w in MODELS.items() for c, e in _sums(w, m).items()]
        for r in rows.join(F.broadcast(at), "feature").groupBy("feature").agg(*sums).collect():
            for m, w in MODELS.items():
                key = (r.feature, m)
                if key not in open_:
                    continue
                parts = [r[f"{m}_g{i}"] for i in w] + [r[f"{m}_h{min(i, j)}{max(i, j)}"] for i in w for j in w] + [r[f"{m}_l"]]
                if any(x is None or not math.isfinite(x) for x in parts):
                    open_.discard(key)
                    continue
                g, h, like = np.array(parts[: len(w)]), np.array(parts[len(w) : -1]).reshape(len(w), len(w)), parts[-1]
                try:
                    inverse = np.linalg.inv(h)
                except np.linalg.LinAlgError:
                    open_.discard(key)
                    continue
                step = inverse @ g
                if np.linalg.cond(h) > 1e12 or like > -1e-6 * sizes[r.feature]:  # nearly parted by a threshold: no finite best
                    open_.discard(key)
                elif np.abs(step).max() < close:
                    coef, error = float(beta[key][1]), math.sqrt(max(inverse[1, 1], 0.0))
                    done[key] = (coef, min(1.0, 2 * normal_sf(abs(coef) / error)) if error else None)
                    open_.discard(key)
                elif key in before and like < before[key] - 1e-9 * abs(before[key]):
                    beta[key] = beta[key] - before[(*key, "step")] / 2  # went too far: half of it
                    before[(*key, "step")] = before[(*key, "step")] / 2
                else:
                    before[key], before[(*key, "step")] = like, step
                    beta[key] = beta[key] + step
    none = (None, None)
    found = [(f, n, *done.get((f, "raw"), none), *done.get((f, "adj"), none)) for f, n in sorted(sizes.items())]
    out = spark.createDataFrame(found, "feature string, n long, raw_coef double, raw_p double, adj_coef double, adj_p double")
    lost = F.when(F.abs("raw_coef") > 1e-9, 1 - F.try_divide("adj_coef", "raw_coef"))
    return out.withColumns({"attenuation": lost, "verdict": verdict(F.col("raw_p"), F.col("adj_p"), F.col("raw_coef"), F.col("adj_coef"))})
