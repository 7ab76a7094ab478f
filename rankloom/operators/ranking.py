"""Ranked results against the truth: reciprocal ranks, precision at matches, success flags and who succeeded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reciprocal_at(rank: Column, k: int) -> Column:
    """1 / rank within the first k, else 0; no rank or one of 0 is not found."""
    return F.when((rank > 0) & (rank <= k), 1.0 / rank).otherwise(0.0)


def success(df_columns: list[str], k: int, rank: str = "rank", top: str = "top@{k}", mrr: str = "mrr", detected: str = "detected") -> Column:
    """Whether the truth is in the first k, by the first of these columns that is there: rank, top@k, mrr, detected."""
    flag = f"{top}".format(k=k)
    if rank in df_columns:
        hit = (F.col(rank) > 0) & (F.col(rank) <= k)
    elif flag in df_columns:
        hit = F.col(f"`{flag}`") == 1
    elif mrr in df_columns:
        hit = (F.col(mrr) > 0) & (F.try_divide(F.lit(1.0), mrr) <= k)
    elif detected in df_columns:
        hit = F.contains(F.lower(detected), F.lit("yes"))
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def success_flags(ranks: DataFrame, key: str, tools: list[str], k: int, also: list | None = None) -> DataFrame:
    """(key, found_<tool>..., num_found) from (key, tool, rank): the best rank counts. ``also`` are further aggregates of a key's rows, in the same pass."""
    hit = success(ranks.columns, k)
    wide = ranks.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("tool") == t, hit)), F.lit(False)).alias(f"found_{t}") for t in tools], *(also or []))
    return wide.withColumn("num_found", reduce(lambda a, b: a + b, [F.col(f"found_{t}").cast("int") for t in tools]))


def membership(flags: DataFrame, tools: list[str]) -> DataFrame:
    """Add ``members``: the tools that succeeded, in order, joined by a comma; empty for none."""
    return flags.withColumn("members", F.concat_ws(",", *[F.when(F.col(f"found_{t}"), F.lit(t)) for t in tools]))


def set_sizes(flags: DataFrame, tools: list[str]) -> DataFrame:
    """(name, n): found by each tool, by it alone, by none, any, all and exactly one."""
    n = len(tools)
    conds = {f"found_{t}": F.col(f"found_{t}") for t in tools} | {f"only_{t}": F.col(f"found_{t}") & (F.col("num_found") == 1) for t in tools}
    conds |= {"none": F.col("num_found") == 0, "any": F.col("num_found") > 0, "all": F.col("num_found") == n, "exactly_one": F.col("num_found") == 1}
    wide = flags.agg(*[F.count_if(c).alias(k) for k, c in conds.items()])
    return wide.unpivot([], list(conds), "name", "n")


def unique_groups(flags: DataFrame, tools: list[str], key: str, least: int = 5) -> DataFrame:
    """(tool, key, is_first, mode): bugs that a tool alone finds, against those that the others find.

    The others are bugs that all of them find; if fewer than ``least``, that any finds; if still fewer while the tool has
    twice ``least`` of its own, that at least half of them find. A tool with fewer than ``least`` bugs of its own is left out.
    """
    others = {t: reduce(lambda a, b: a + b, [F.col(f"found_{o}").cast("int") for o in tools if o != t]) for t in tools}
    m = len(tools) - 1
    counts = flags.agg(*[e for t in tools for e in (F.count_if(F.col(f"found_{t}") & (others[t] == 0)).alias(f"u_{t}"), F.count_if(others[t] == m).alias(f"a_{t}"), F.count_if(others[t] > 0).alias(f"o_{t}"))])
    one = F.broadcast(counts)  # one row
    d = flags.crossJoin(one)
    rows = []
    for t in tools:
        u, a, o = F.col(f"u_{t}"), F.col(f"a_{t}"), F.col(f"o_{t}")
        mode = F.when(a >= least, "all").when((o < least) & (u >= 2 * least), "majority").otherwise("any")
        other = F.when(mode == "all", others[t] == m).when(mode == "majority", others[t] >= (m + 1) // 2).otherwise(others[t] > 0)
        alone = F.col(f"found_{t}") & (others[t] == 0)
        rows.append(F.when((u >= least) & (alone | other), F.struct(F.lit(t).alias("tool"), alone.alias("is_first"), mode.alias("mode"))))
    out = d.select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x"))
    return out.select("x.tool", key, "x.is_first", "x.mode")


def path_match(pred: Column, truth: Column) -> Column:
    """Whether two paths are one file: equal, or one ends with the other."""
    return (pred == truth) | F.endswith(pred, truth) | F.endswith(truth, pred)


def matched_files(files: DataFrame, truth: DataFrame, by: list[str], file: str = "file", gt: str = "gt_file") -> DataFrame:
    """Distinct (by, file) that match a truth of the same ``by`` (:func:`path_match`).

    Equality on suffixes instead of comparing all pairs: a file's suffixes of the lengths that the truths of its ``by`` have meet
    those truths, and the truths' suffixes of the files' lengths meet the files. A report of very many files and truths so makes
    rows in proportion to both, dealt by the suffix.
    """
    p = files.select(*by, F.col(file).alias("_f")).filter("_f is not null").distinct()
    t = truth.select(*by, F.col(gt).alias("_t")).filter("_t is not null").distinct()
    lengths = lambda d, c: d.groupBy(*by).agg(F.collect_set(F.length(c)).alias("_n"))
    cut = lambda d, c: d.withColumn("_n", F.explode(F.filter("_n", lambda n: n <= F.length(c)))).withColumn("_s", F.right(F.col(c), F.col("_n")))
    longer = cut(p.join(lengths(t, "_t"), by), "_f").join(t.withColumnRenamed("_t", "_s"), [*by, "_s"], "left_semi").select(*by, "_f")
    shorter = cut(t.join(lengths(p, "_f"), by), "_t").select(*by, F.col("_s").alias("_f")).distinct().join(p, [*by, "_f"], "left_semi")
    return longer.unionByName(shorter).distinct().withColumnRenamed("_f", file)


def matched_ranks(predictions: DataFrame, truth: DataFrame, by: list[str], file: str = "file", gt: str = "gt_file") -> DataFrame:
    """Predictions (by, tool, file, rank) that match a truth of the same ``by``; each counts once."""
    return predictions.join(matched_files(predictions, truth, by, file, gt), [*by, file], "left_semi")


def map_at_k(predictions: DataFrame, truth: DataFrame, by: list[str], ks: list[int], file: str = "file", gt: str = "gt_file") -> DataFrame:
    """(by, tool, best_rank, mrr@k..., map@k...) for every group of predictions whose ``by`` has a truth.

    Matches within k, by rank, score their number so far over their rank; the sum is over the number of truths, so several
    predictions of one truth may lift it above 1. Without a match all are 0 and best_rank is null.
    """
    n_truth = truth.groupBy(*by).agg(F.count("*").alias("n_truth"))
    groups = predictions.select(*by, "tool").distinct().join(n_truth, by)
    hits = matched_ranks(predictions, truth, by, file, gt).filter(F.col("rank") > 0)
    w = W.partitionBy(*by, "tool").orderBy("rank", file)
    hits = hits.withColumn("_i", F.row_number().over(w))
    sums = hits.groupBy(*by, "tool").agg(F.min("rank").alias("best_rank"), *[F.sum(F.when(F.col("rank") <= k, F.col("_i") / F.col("rank"))).alias(f"_s{k}") for k in ks])
    out = groups.join(sums, [*by, "tool"], "left")
    cols = [reciprocal_at(F.col("best_rank"), k).alias(f"mrr_{k}") for k in ks] + [F.coalesce(F.col(f"_s{k}") / F.col("n_truth"), F.lit(0.0)).alias(f"map_{k}") for k in ks]
    return out.select(*by, "tool", "n_truth", "best_rank", *cols)


def rates_by_tool(ranks: DataFrame, ks: list[int], project: str | None = None) -> DataFrame:
    """Mean reciprocal rank at each k and counts per tool with the overall row (tool null), and per project too if named."""
    cols = [F.avg(reciprocal_at(F.col("rank"), k)).alias(f"mrr_{k}") for k in ks] + [F.count("*").alias("n")]
    if project is None:
        return ranks.rollup("tool").agg(*cols)
    return ranks.groupingSets([("tool",), (project, "tool")], project, "tool").agg(*cols)


def failure_kind(ranks: DataFrame, key: str, k: int, detected: str = "detected") -> DataFrame:
    """(key, kind): localised if any tool succeeds within k, else soft if any detected it, else hard."""
    g = ranks.groupBy(key).agg(F.max(success(["rank"], k)).alias("_hit"), F.coalesce(F.max(F.col(detected)), F.lit(False)).alias("_seen"))
    return g.select(key, F.when(F.col("_hit"), "localised").when(F.col("_seen"), "soft").otherwise("hard").alias("kind"))


def rank_bucket(rank: Column, edges: tuple[int, ...] = (1, 5, 10, 20, 50)) -> Column:
    """Right-closed bucket of a rank, "not_found" for none, ">last" beyond."""
    e = F.when(rank.isNull() | (rank <= 0), "not_found")
    low = 0
    for x in edges:
        e = e.when(rank <= x, f"{low + 1}-{x}")
        low = x
    return e.otherwise(f">{low}")


def closest_tool(ranks: DataFrame, key: str) -> DataFrame:
    """(key, tool, rank) of the smallest rank of each key, the first tool on ties."""
    r = ranks.filter(F.col("rank").isNotNull()).groupBy(key).agg(F.min(F.struct("rank", "tool")).alias("b"))
    return r.select(key, F.col("b.tool").alias("tool"), F.col("b.rank").alias("rank"))
