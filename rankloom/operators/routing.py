"""Cascades of tool tiers: routing by score percentiles, random routing of the same sizes, energy and operating points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import scratch
from .scoring import spread_key
from .stats import meet, quantiles


def tier_best_rank(wide: DataFrame, tiers: list[list[str]], prefix: str = "rank_") -> DataFrame:
    """Add best_1, best_2, ...: the smallest rank of a tier's tools; 0 or less is no rank."""
    clean = lambda t: F.when(F.col(prefix + t) > 0, F.col(prefix + t))
    best = {f"best_{i + 1}": F.least(*[clean(t) for t in tools]) if len(tools) > 1 else clean(tools[0]) for i, tools in enumerate(tiers)}
    return wide.withColumns(best)


def cutoffs(train_scores: DataFrame, by: list[str], splits: list[tuple[int, int]], score: str = "score") -> DataFrame:
    """(by, split, tier1, tier3, high, low): percentiles of training scores for each split (percent to tier 1, percent to tier 3).

    All of tier 1 at 100 and none of tier 3 at 0 are infinite cutoffs."""
    wanted = sorted({1 - a / 100 for a, _ in splits} | {b / 100 for _, b in splits})
    p = quantiles(train_scores, by, score, {f"_{i}": q for i, q in enumerate(wanted)})
    at = lambda q: F.col(f"_{wanted.index(q)}")
    rows = [F.struct(F.lit(f"{a}/{b}").alias("split"), F.lit(a).alias("tier1"), F.lit(b).alias("tier3"), (F.lit(float("-inf")) if a == 100 else at(1 - a / 100)).alias("high"), (F.lit(float("-inf")) if b == 0 else at(b / 100)).alias("low")) for a, b in splits]
    return p.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.*")


def route(scores: DataFrame, cuts: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Add ``tier``: 1 from the high cutoff on, 3 below the low one, else 2, and a row for each split. ``cuts`` is a few rows for each model: join what else is wanted of a report before."""
    tier = F.when(F.col(score) >= F.col("high"), 1).when(F.col(score) < F.col("low"), 3).otherwise(2)
    return scores.join(F.broadcast(cuts), by).withColumn("tier", tier)


def placed(rows: DataFrame, by: list[str], key: str, seed: int = 7, prefixes: int = 256) -> DataFrame:
    """Add ``place``: where a row is in its group of ``by``, from 1, in the order of a hash of the key, ties by the key. ``rows`` is a written table, as it is read twice.

    Rows are counted by the hash's prefix, which gives the places before each prefix, so windows see a prefix, not a group.
    """
    h = spread_key(F.col(key), seed)
    rows = rows.withColumns({"_h": h, "_p": F.floor(h / (4294967296 / prefixes)).cast("int")})
    lower = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    n = rows.groupBy(*by, "_p").agg(F.count("*").alias("_c")).select(*by, "_p", F.coalesce(F.sum("_c").over(lower), F.lit(0)).alias("_from"))
    i = F.col("_from") + F.row_number().over(W.partitionBy(*by, "_p").orderBy("_h", key))
    return meet(rows, n, [*by, "_p"], few=True).withColumn("place", i).drop("_h", "_p", "_from")


def sizes(routed: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_1, n_2): how many of each group are in tiers 1 and 2."""
    return routed.groupBy(*by).agg(F.count_if(F.col("tier") == 1).alias("n_1"), F.count_if(F.col("tier") == 2).alias("n_2"))


def deal(routed: DataFrame, of: DataFrame, by: list[str]) -> DataFrame:
    """Add ``random_tier`` by ``place``: as many of each tier as :func:`sizes` says in ``of``, a few rows. A map, whatever rows :func:`route` made of a placed one."""
    i, first = F.col("place"), F.col("n_1")
    return meet(routed, of, by, few=True).withColumn("random_tier", F.when(i <= first, 1).when(i <= first + F.col("n_2"), 2).otherwise(3)).drop("n_1", "n_2")


def random_route(routed: DataFrame, by: list[str], key: str, seed: int = 7, prefixes: int = 256) -> DataFrame:
    """Tiers of the same sizes for each group of ``by``, dealt in the order of a hash of the key, ties by the key. ``routed`` is written once, as it is read again.

    Where all groups of a report share one order, as the splits of a model do, place the reports before they are routed and :func:`deal` then: no row for each split is written or shuffled.
    """
    rows = scratch.stored(routed, "routed")
    return deal(placed(rows, by, key, seed, prefixes), sizes(rows, by), by).drop("place")


def rank_of_tier(tier: Column) -> Column:
    return F.when(tier == 1, F.col("best_1")).when(tier == 2, F.col("best_2")).otherwise(F.col("best_3"))


def quality(rank: Column, k: int) -> dict[str, Column]:
    """Hit rate within k, mean reciprocal rank with misses as 0, and mean over hits alone."""
    hit = F.coalesce(rank <= k, F.lit(False))
    return {"hr": F.avg(hit.cast("double")), "mrr": F.avg(F.when(hit, 1 / rank).otherwise(0.0)), "map": F.avg(F.when(hit, 1 / rank))}


def sweep(routed: DataFrame, by: list[str], k: int = 5, costs: tuple[float, float, float] | None = None, tier: str = "tier") -> DataFrame:
    """Quality, shares of the tiers and the mean cost of what was routed, for each group of ``by``."""
    t = F.col(tier)
    cols = {**quality(rank_of_tier(t), k), **{f"frac_{i}": F.avg((t == i).cast("double")) for i in (1, 2, 3)}}
    if costs:
        cost = F.when(t == 1, costs[0]).when(t == 2, costs[1]).otherwise(costs[2])
        cols |= {"cost": F.avg(cost), "saved": 1 - F.avg(cost) / costs[2]}
    return routed.groupBy(*by).agg(F.count("*").alias("n"), *[c.alias(name) for name, c in cols.items()])


def over_folds(swept: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and population deviation over folds."""
    return swept.groupBy(*by).agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def best_points(swept: DataFrame, budgets: list[float], spent: str, gain: str, name: str, slack: float = 0.02) -> DataFrame:
    """For each budget the row of most ``gain`` among those that spend at most it plus ``slack``; the first by name on ties."""
    b = swept.withColumn("budget", F.explode(F.array(*[F.lit(float(x)) for x in budgets]))).filter(F.col(spent) <= F.col("budget") + slack)
    w = W.partitionBy("budget").orderBy(F.desc(gain), name)
    return b.withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def energy(log: DataFrame, bug: str, amount: str) -> DataFrame:
    """Mean over bugs of a bug's total."""
    return log.groupBy(bug).agg(F.sum(amount).alias("e")).agg(F.avg("e").alias("per_bug"), F.count("*").alias("n"))


def baselines(wide: DataFrame, ranks: dict[str, str], ks: tuple[int, ...] = (1, 5, 10), cutoff: int = 5) -> DataFrame:
    """(name, n, hr_<k> for each k, mrr, map) of policies that send every report to one place: ``ranks`` names a column of ranks for each. One pass."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.when(F.col(c) > 0, F.col(c)).alias("rank")) for n, c in ranks.items()])).alias("x")
    q = quality(F.col("rank"), cutoff)
    return wide.select(rows).select("x.*").groupBy("name").agg(F.count("*").alias("n"), *[quality(F.col("rank"), k)["hr"].alias(f"hr_{k}") for k in ks], q["mrr"].alias("mrr"), q["map"].alias("map"))


def with_energy(df: DataFrame, key: str, first: DataFrame, second: DataFrame, third: DataFrame, amounts: list[str]) -> DataFrame:
    """Add {amount}_1, _2, _3 (what each tier costs a report) and {amount}_full (the mean cost of all three).

    ``first`` and ``third`` are logs (key, amounts) with any number of rows for a report, whose total is its cost; a report that a log lacks costs the mean of
    those that it has. ``second`` is a log of stages of the whole run, whose total is dealt evenly to the rows of ``df``. Three rows of means are broadcast.
    """
    out = df
    n = df.agg(F.count("*").alias("_n"))
    for i, log in ((1, first), (3, third)):
        each = log.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(a).alias(f"_{a}_{i}") for a in amounts])
        mean = each.agg(*[F.avg(f"_{a}_{i}").alias(f"_m_{a}_{i}") for a in amounts])
        out = out.join(each, key, "left").crossJoin(F.broadcast(mean))
    run = second.agg(*[F.sum(a).alias(f"_t_{a}") for a in amounts]).crossJoin(n)
    out = out.crossJoin(F.broadcast(run.select(*[F.coalesce(F.try_divide(f"_t_{a}", "_n"), F.lit(0.0)).alias(f"_s_{a}") for a in amounts])))
    cols = []
    for a in amounts:
        m = {i: F.coalesce(F.col(f"_m_{a}_{i}"), F.lit(0.0)) for i in (1, 3)}
        cols += [F.coalesce(F.col(f"_{a}_{i}"), m[i]).alias(f"{a}_{i}") for i in (1, 3)]
        cols += [F.col(f"_s_{a}").alias(f"{a}_2"), (m[1] + F.col(f"_s_{a}") + m[3]).alias(f"{a}_full")]
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *cols)


def energy_of_routes(routed: DataFrame, by: list[str], amounts: list[str], tier: str = "tier") -> DataFrame:
    """(by, n, escalated, amounts, {amount}_saved_pct): what the reports of each group cost by the tiers they got, on average, and what that saves.

    All pay for the first tier, those of tiers 2 and 3 for the second, and those of tier 3 for the third; the saving is against all going through all three."""
    t = F.col(tier)
    paid = lambda a: F.avg(F.col(f"{a}_1") + F.when(t > 1, F.col(f"{a}_2")).otherwise(0.0) + F.when(t == 3, F.col(f"{a}_3")).otherwise(0.0))
    out = routed.groupBy(*by).agg(F.count("*").alias("n"), F.avg((t > 1).cast("double")).alias("escalated"), *[paid(a).alias(a) for a in amounts], *[F.max(f"{a}_full").alias(f"_full_{a}") for a in amounts])
    return out.select(*by, "n", "escalated", *amounts, *[(100 * (1 - F.try_divide(a, f"_full_{a}"))).alias(f"{a}_saved_pct") for a in amounts])
