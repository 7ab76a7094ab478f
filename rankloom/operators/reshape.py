"""Pivots, indicator columns, joins of feature blocks, scaling and filling."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_tools(df: DataFrame, keys: list[str], tools: list[str], metrics: dict[str, str], fill: float | None = None) -> DataFrame:
    """One {metric}_{tool} column each. ``metrics`` names the aggregate: min or max, which don't depend on order."""
    agg = {"min": F.min, "max": F.max}
    cols = []
    for m, how in metrics.items():
        for t in tools:
            e = agg[how](F.when(F.col("tool") == t, F.col(f"`{m}`")))
            cols.append((F.coalesce(e, F.lit(fill)) if fill is not None else e).alias(f"{m.replace('@', '_')}_{t}"))
    return df.groupBy(*keys).agg(*cols)


def frequent_values(df: DataFrame, column: str, least: int, most: int | None = None) -> list:
    """Values of at least ``least`` rows, most frequent first: a vocabulary for columns, of at most ``most`` where that is given."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    n = n.orderBy(F.desc("n"), column)
    return [r[0] for r in (n if most is None else n.limit(most)).collect()]


def clean_name(value, most: int = 60) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", str(value)).strip("_").lower()[:most]


def columns_of(df: DataFrame, column: str, least: int, most: int = 2000) -> list:
    """Values of at least ``least`` rows, in order, for columns. More than ``most`` are an error, as no table holds so many: none is left out."""
    found = frequent_values(df, column, least, most + 1)
    if len(found) > most:
        raise ValueError(f"{column} has over {most} values of {least} rows or more; raise the least number of rows")
    return sorted(found)


def _by_name(values: list, name) -> dict[str, list]:
    """Values by their column's name: values with one name share a column."""
    out: dict[str, list] = {}
    for v in values:
        out.setdefault(name(v), []).append(v)
    return out


def one_hot_from(df: DataFrame, column: str, prefix: str, least: int = 20) -> DataFrame:
    """0/1 columns {prefix}_{value} for values that ``least`` rows have, {prefix}___other__ and {prefix}___missing__ (each where there are such), and {prefix}_is_missing.

    Values are compared without blanks around them; a missing or blank one is missing. The vocabulary is one count by value, of bounded size.
    """
    v = F.coalesce(F.trim(F.col(column).cast("string")), F.lit(""))
    blank = v == ""
    keep = columns_of(df.select(F.when(~blank, v).alias("_v")), "_v", least)
    label = F.when(blank, "__missing__").when(v.isin(*keep), v).otherwise("__other__") if keep else F.when(blank, "__missing__").otherwise("__other__")
    there = df.agg(F.count_if(blank).alias("m"), F.count_if(label == "__other__").alias("o")).first()
    names = keep + ["__missing__"] * bool(there.m) + ["__other__"] * bool(there.o)
    return df.select("*", *[(label == n).cast("int").alias(f"{prefix}_{n}") for n in names], blank.cast("int").alias(f"{prefix}_is_missing"))


def multi_hot_from(df: DataFrame, items: str, prefix: str, least: int = 30) -> DataFrame:
    """{prefix}_num_concepts, {prefix}_is_missing and 0/1 columns {prefix}__{item} for items that ``least`` rows hold.

    Names keep small letters, digits and underscores and end at 60; items that share a name share a column. A null array is an empty one.
    """
    xs = F.coalesce(F.array_compact(items), F.array().cast(df.schema[items].dataType))
    keep = columns_of(df.select(F.explode(F.array_distinct(xs)).alias("_v")), "_v", least)
    groups = _by_name(keep, lambda x: re.sub(r"[^a-z0-9_]+", "_", str(x))[:60])
    cols = [F.arrays_overlap(xs, F.array(*[F.lit(x) for x in same])).cast("int").alias(f"{prefix}__{n}") for n, same in groups.items()]
    return df.select("*", F.size(xs).alias(f"{prefix}_num_concepts"), (F.size(xs) == 0).cast("int").alias(f"{prefix}_is_missing"), *cols)


def column_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): the sum of each column, from one pass."""
    one = df.agg(*[F.coalesce(F.sum(f"`{c}`"), F.lit(0)).cast("long").alias(f"_{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def one_hot(df: DataFrame, column: str, values: list, prefix: str) -> DataFrame:
    """0/1 columns for ``values``, for other values and for missing ones."""
    blank = F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")
    cols = [(F.coalesce(F.col(column) == v, F.lit(False))).cast("int").alias(f"{prefix}_{clean_name(v)}") for v in values]
    other = (~blank & ~F.coalesce(F.col(column).isin(*values), F.lit(False))).cast("int").alias(f"{prefix}__other__")
    return df.select("*", *cols, other, blank.cast("int").alias(f"{prefix}_is_missing"))


def multi_hot(df: DataFrame, items: str, values: list[str], prefix: str) -> DataFrame:
    """0/1 columns for ``values`` in an array, with the array's size and whether it is empty."""
    cols = [F.array_contains(items, v).cast("int").alias(f"{prefix}_{clean_name(v)}") for v in values]
    return df.select("*", *cols, F.size(items).alias(f"{prefix}_count"), (F.size(items) == 0).cast("int").alias(f"{prefix}_is_missing"))


def vocabulary(df: DataFrame, items: str, least: int, most: int | None = None) -> list[str]:
    """Items that at least ``least`` rows hold."""
    return frequent_values(df.select(F.explode(F.array_distinct(items)).alias("item")), "item", least, most)


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}__is_missing") for c in columns])


def row_stats(columns: list[str]) -> tuple[Column, Column]:
    """Mean and sample deviation of a row's columns, nulls apart."""
    xs = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    n = F.size(xs)
    total = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    mean = F.try_divide(total, n)
    square = F.aggregate(F.transform(xs, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return mean, F.sqrt(F.when(n > 1, square / (n - 1)))


#: Ratings of which three must be there for any of :data:`RATING_SPEC`.
SIX_RATINGS = ("actionability", "clarity", "specificity", "technical_depth", "expected_observed_alignment", "causal_reasoning_quality")
#: name: (columns that it needs, columns that it takes where they are there, SQL over them; one that isn't there counts 0).
RATING_SPEC = {
    "clarity_specificity_gap": (("clarity", "specificity"), (), "clarity - specificity"),
    "clarity_specificity_ratio": (("clarity", "specificity"), (), "clarity / (specificity + 0.1D)"),
    "actionability_depth_product": (("actionability", "technical_depth"), (), "actionability * technical_depth"),
    "actionability_depth_ratio": (("actionability", "technical_depth"), (), "actionability / (technical_depth + 0.1D)"),
    "technical_completeness": (("technical_depth", "expected_observed_alignment"), (), "(technical_depth + expected_observed_alignment) / 2"),
    "reasoning_composite": (("causal_reasoning_quality",), ("hidden_s2r_present",), "(causal_reasoning_quality + hidden_s2r_present * 2) / 7"),
    "clarity_minus_contradiction": (("contradiction_present", "clarity"), (), "clarity - contradiction_present * 2"),
}
#: name: (rating of 0 to 5, signs in the text that should go with it, how many of them make a full one).
CONSISTENCY_SPEC = {
    "technical_depth_consistency": ("technical_depth", ("has_code", "has_stacktrace", "has_version_info"), 3),
    "causal_reasoning_consistency": ("causal_reasoning_quality", ("num_causal_markers",), 5),
}


def from_spec(df: DataFrame, spec: dict) -> dict[str, Column]:
    """Columns of a spec like :data:`RATING_SPEC` that ``df`` has what they need for; all values count as doubles."""
    out = {}
    for name, (needs, takes, sql) in spec.items():
        if set(needs) <= set(df.columns):
            value = {c: f"CAST(`{c}` AS DOUBLE)" if c in df.columns else "0D" for c in (*needs, *takes)}
            out[name] = F.expr(re.sub("|".join(rf"\b{c}\b" for c in value), lambda m: value[m[0]], sql))
    return out


def rating_interactions(df: DataFrame, spec: dict = RATING_SPEC) -> DataFrame:
    """Differences, ratios and composites of ratings, each where its columns are there; none without three of :data:`SIX_RATINGS`."""
    if len(set(SIX_RATINGS) & set(df.columns)) < 3:
        return df
    out = from_spec(df, spec)
    quality = [q for q in SIX_RATINGS[:3] if q in df.columns]
    if len(quality) > 1:
        out["quality_composite"], out["quality_std"] = row_stats(quality)
    return df.withColumns(out)


def consistency(df: DataFrame, spec: dict = CONSISTENCY_SPEC) -> DataFrame:
    """How well ratings agree with what the text holds, 1 being full agreement, and their mean as consistency_composite."""
    out = {}
    for name, (rating, signs, full) in spec.items():
        held = [F.col(s).cast("double") for s in signs if s in df.columns]
        if rating in df.columns and held:
            share = F.least(reduce(lambda a, b: a + b, held) / full, F.lit(1.0))  # null if a sign is: what isn't known doesn't agree
            out[name] = 1 - F.abs(share - F.col(rating).cast("double") / 5)
    if not out:
        return df
    df = df.withColumns(out)
    return df.withColumn("consistency_composite", row_stats(list(out))[0])


#: name: (columns, how they combine); "sum" adds all but the last, which is taken away.
INTERACTIONS = {
    "complexity_reasoning": (("z_repair_readiness", "z_reasoning_quality"), "product"),
    "complexity_description": (("z_repair_readiness", "txt_description_line_count"), "product"),
    "complexity_readability": (("z_repair_readiness", "ari"), "product"),
    "reasoning_clarity": (("z_reasoning_quality", "z_clarity"), "product"),
    "structure_actionability": (("txt_description_line_count", "z_actionability"), "product"),
    "readability_combo": (("ari", "fog", "flesch"), "sum"),
    "ambiguity_reasoning": (("z_ambiguity", "z_reasoning_quality"), "product"),
}


def interactions(df: DataFrame, spec: dict = INTERACTIONS) -> DataFrame:
    """Products and sums of columns, each where all its columns are there."""
    out = {}
    for name, (cols, how) in spec.items():
        if set(cols) <= set(df.columns):
            xs = [F.col(x).cast("double") for x in cols]
            out[name] = reduce(lambda a, b: a * b, xs) if how == "product" else reduce(lambda a, b: a + b, xs[:-1]) - xs[-1]
    return df.withColumns(out) if out else df


def scaling_params(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std, min, max, n_missing) with the population deviation."""
    parts = [e for i, c in enumerate(columns) for e in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"), F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"z{i}"), F.count_if(F.col(c).isNull()).alias(f"n{i}"))]
    one = df.agg(*parts)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"), F.col(f"a{i}").alias("min"), F.col(f"z{i}").alias("max"), F.col(f"n{i}").alias("n_missing")) for i, c in enumerate(columns)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def standard_scale(df: DataFrame, columns: list[str], keep: bool = True) -> DataFrame:
    """Columns less their mean over their population deviation (1 if that is 0), what they were in {c}__orig. One row of parameters is broadcast."""
    parts = [e for c in columns for e in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))]
    d = df.crossJoin(F.broadcast(df.agg(*parts)))
    scaled = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    kept = [F.col(c).alias(f"{c}__orig") for c in columns] if keep else []
    return d.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns], *kept)


def fill_missing(df: DataFrame, by_median: list[str], by_zero: list[str]) -> DataFrame:
    """Nulls as the column's median (0 if it has no value), or as 0."""
    from .stats import long_form, quantiles

    med = None
    if by_median:
        each = quantiles(long_form(df, [], by_median), ["feature"], "value", {"m": 0.5})
        med = each.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(f"__f_{c}") for c in by_median])  # one row
    d = df.crossJoin(F.broadcast(med)) if med is not None else df
    fill = {c: F.coalesce(F.col(c), F.col(f"__f_{c}"), F.lit(0.0)) for c in by_median} | {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in by_zero}
    return d.select(*[fill[c].alias(c) if c in fill else F.col(c) for c in df.columns])
