"""Scorers kept as tables: the parameters of a model by task and feature, in numbered versions, and scoring that reads them alone.

A version is a folder that is written once, by one task and so as one file, as it holds a row for each task and feature, whatever the size of
the data; Spark's commit makes it visible whole. Scoring turns the rows into one expression for each task, so it is a map over the reports: nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from .coded import two_groups
from .stats import meet

#: What a stored version holds.
SCHEMA = T.StructType([T.StructField("task", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("delta", T.DoubleType()), T.StructField("mu", T.DoubleType()), T.StructField("sd", T.DoubleType())])
MOST = 20_000


def store(params: DataFrame, root: str, version: int) -> str:
    """Write (task, feature, delta, mu, sd) as ``version`` under ``root``; a version that is there is never overwritten, which is an error."""
    path = f"{root.rstrip('/')}/version={int(version)}"
    params.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMA]).repartition(1).write.mode("errorifexists").parquet(path)
    return path


def load(spark: SparkSession, root: str, version: int | None = None) -> list[tuple]:
    """The rows of a version, the newest unless one is named, in order of task and feature.

    An error, not a wrong score: no such version, columns other than those of :data:`SCHEMA`, a null name, a task's feature twice, a deviation that
    is not above 0, or more than :data:`MOST` rows. Null weights, means and deviations are allowed: such a feature adds nothing.
    """
    t = spark.read.parquet(root)  # the version comes from the folder's name
    if "version" not in t.columns:
        raise ValueError(f"{root} holds no versions")
    wrong = [f.name for f in SCHEMA if f.name not in t.columns or t.schema[f.name].dataType != f.dataType]
    if wrong:
        raise ValueError(f"the scorer's table lacks, or has of another type: {', '.join(wrong)}")
    version = t.agg(F.max("version")).first()[0] if version is None else version
    rows = [tuple(r) for r in t.filter(F.col("version") == version).select(*SCHEMA.fieldNames()).limit(MOST + 1).collect()]
    if not rows:
        raise ValueError(f"no version {version} under {root}")
    if len(rows) > MOST:
        raise ValueError(f"over {MOST} rows in version {version}")
    if any(r[0] is None or r[1] is None for r in rows) or len({r[:2] for r in rows}) < len(rows) or any(r[4] is not None and not r[4] > 0 for r in rows):
        raise ValueError(f"version {version} has nameless or repeated features, or deviations that are not above 0")
    return sorted(rows, key=lambda r: r[:2])


def scores(df: DataFrame, params: list[tuple], key: list[str], prefix: str = "score_", least: float = 1e-9) -> DataFrame:
    """(key, score_<task> for each task): the sum of delta * (value - mu) / sd over the features that ``df`` has.

    A value that is missing or NaN adds nothing, nor does a feature that ``df`` lacks or whose delta is near 0; a report without any has 0.
    Repeated reports and null keys stay as they are.
    """
    have = set(df.columns)
    by_task: dict[str, list] = {}
    for task, feature, delta, mu, sd in params:
        terms = by_task.setdefault(task, [])
        if feature in have and None not in (delta, mu, sd) and abs(delta) >= least:
            v = F.col(f"`{feature}`").cast("double")
            terms.append(F.when(v.isNotNull() & ~F.isnan(v), F.lit(delta) * (v - F.lit(mu)) / F.lit(sd)).otherwise(0.0))
    total = lambda xs: F.aggregate(F.array(*xs), F.lit(0.0), lambda a, x: a + x) if xs else F.lit(0.0)
    return df.select(*key, *[total(xs).alias(prefix + task) for task, xs in by_task.items()])


def evaluate(scored: DataFrame, truth: DataFrame, key: list[str], tasks: list[str], prefix: str = "score_") -> DataFrame:
    """(task, n_pos, n_neg, auc) of ``scored`` against ``truth`` (key, <task> as 0 or 1), over reports that both have.

    A task that either table lacks is left out; one with a single class has no auc. A missing truth is 0."""
    both = [t for t in tasks if prefix + t in scored.columns and t in truth.columns]
    t = truth.select(*key, *[F.coalesce(F.col(t).cast("int"), F.lit(0)).alias(f"_y_{t}") for t in both])
    pairs = scratch.stored(meet(scored, t, key), "evaluated")
    out = None
    for at in range(0, len(both), 6):  # a report's truths are one number
        own = both[at : at + 6]
        code = sum((F.when(F.col(f"_y_{t}") == 1, 1 << i).otherwise(0) for i, t in enumerate(own)), F.lit(0))
        sides = {t: [c >> i & 1 for c in range(1 << len(own))] for i, t in enumerate(own)}
        s = two_groups(pairs.withColumn("_code", code), [prefix + t for t in own], "_code", sides, "task").filter(F.col("feature") == F.concat(F.lit(prefix), "task"))
        s = s.select("task", F.col("n1").alias("n_pos"), F.col("n2").alias("n_neg"), F.try_divide("u", F.col("n1").cast("double") * F.col("n2")).alias("auc"))
        out = s if out is None else out.union(s)
    return out if out is not None else scored.sparkSession.createDataFrame([], "task string, n_pos bigint, n_neg bigint, auc double")
