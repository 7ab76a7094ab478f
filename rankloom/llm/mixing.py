"""Mixing sources to target weights, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small, stored, text_of

WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str = "text") -> Column:
    """Number of runs without white space; 0 for a null text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weight: Column, share: float, cap: float) -> DataFrame:
    """Add ``target`` to one row per source (source, source_size, weight given as an expression on them).

    The sources share ``share`` times all sizes by weight, none above ``cap`` times its own size; what is above is shared
    again by weight until none is. The fixed point is a water level: sources in order of the level at which they fill up,
    each full one taking its cap, and the rest the level that remains times their weight. The windows run over one row
    for each source that has a weight.
    """
    t = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = W.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    whole = W.partitionBy()
    t = t.select(
        "*",
        F.row_number().over(by).alias("place"),
        F.coalesce(F.sum("most").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("full"),
        F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)).alias("open"),
        (F.sum("source_size").over(whole) * F.lit(float(share))).alias("total"),
    )
    t = t.withColumn("level", (F.col("total") - F.col("full")) / F.col("open"))
    t = t.withColumn("is_full", F.col("most") <= F.col("level") * F.col("weight"))
    first = F.min(F.when(~F.col("is_full"), F.struct("place", "level"))).over(whole)["level"]
    t = t.withColumn("last_level", first)
    target = F.when(F.col("is_full"), F.col("most")).otherwise(F.least(F.col("most"), F.col("last_level") * F.col("weight")))
    return t.select("source", "source_size", target.alias("target"))


def cyclic_weight(weights: tuple[float, ...]) -> Column:
    """Sources in order of their code points, null last, weigh ``weights``, repeating."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((place - 1) % len(weights) + 1).cast("int"))


def chance(seed: str, doc_id: str, text: str) -> Column:
    """A number from 0 up to 1 that depends on the seed, the document's id and its text alone."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of(text)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def plan_mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: str = "mix", doc_id: str = "doc_id", text: str = "text", source: str = "source", prefix: str = "mix_") -> DataFrame:
    """``df`` with mix_size, mix_source_size, mix_target and mix_copies, or another ``prefix`` than mix_.

    Each document is to be emitted floor(rate) times, and once more with the rate's fraction as probability, where rate is
    its source's target over its source's size. A null source is a source of its own, the last one. A null or empty text has
    size 0; a source of size 0 has rate 0. Rows that repeat id and text draw alike. An empty table stays empty. Columns
    of ``df`` with these names are replaced.
    """
    sizes = df.select(F.col(source).alias("source"), words_of(text).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = stored(source_targets(sizes, cyclic_weight(weights), share, cap), "mix-targets")
    of, total, target, size, copies = (prefix + x for x in ("source", "source_size", "target", "size", "copies"))
    t = small(targets.select(F.col("source").alias(of), F.col("source_size").alias(total), F.col("target").alias(target)))
    out = df.drop(of, total, target, size, copies).join(t, F.col(source).eqNullSafe(F.col(of))).drop(of)
    rate = F.coalesce(F.try_divide(target, total), F.lit(0.0))
    times = F.floor(rate) + (chance(seed, doc_id, text) < rate - F.floor(rate)).cast("long")
    return out.withColumns({size: words_of(text), copies: times})


def mix(df: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows and columns of ``df``, whatever these are named, each row as many times as :func:`plan_mix` says."""
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    out = plan_mix(df, prefix=prefix, **how)
    return out.withColumn(prefix + "copies", F.explode(F.array_repeat(F.lit(0), F.col(prefix + "copies").cast("int")))).select(*df.columns)


MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS k FROM d GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM s),
p AS (SELECT *, row_number() OVER o AS place,
             coalesce(sum(most) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)::DOUBLE AS filled,
             (sum(weight) OVER (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS still,
             (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
      FROM w WINDOW o AS (ORDER BY most / weight, source IS NULL, source)),
l AS (SELECT *, (total - filled) / still AS level, most <= (total - filled) / still * weight AS is_full FROM p),
f AS (SELECT arg_min(level, place) FILTER (WHERE NOT is_full) AS last_level FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN most ELSE least(most, last_level * weight) END AS target FROM l, f),
r AS (SELECT d.doc_id, d.size, t.source_size::BIGINT AS source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0)::DOUBLE AS rate,
             ('0x' || substr(md5(concat('mix|', coalesce(d.doc_id::VARCHAR, ''), '|', md5(d.text))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""
