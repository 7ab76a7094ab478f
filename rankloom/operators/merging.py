"""Several tables about the same reports as one wide table: outcomes pivoted by tool, left joins in turn, copies dropped, categories encoded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as C
from .ranking import reciprocal_at
from .reshape import pivot_tools


def wide_metrics(results: DataFrame, keys: list[str], tools: list[str], tops: tuple[int, ...] = (1, 5), map_: str | None = None) -> DataFrame:
    """One row for each report: rank_, mrr_ and top_<k>_ of each tool, from (keys, tool, rank).

    Where a tool has several rows for a report the best rank counts, so that order doesn't matter. A tool without a row has nulls; one
    whose rank is missing or below 1 has mrr 0 and no top. ``map_`` names a stored average precision, which is pivoted beside them (its largest).
    """
    found = F.col("rank") > 0
    d = results.withColumns({"rank": F.when(found, F.col("rank")), "mrr": F.when(found, 1 / F.col("rank")).otherwise(0.0), **{f"top@{k}": F.coalesce(found & (F.col("rank") <= k), F.lit(False)).cast("int") for k in tops}})
    metrics = {"rank": "min", "mrr": "max", **{f"top@{k}": "max" for k in tops}, **({map_: "max"} if map_ else {})}
    return pivot_tools(d, keys, tools, metrics)


@dataclass
class Source:
    """A table to merge: its keys, the suffix for names that are taken, columns that stay out, and what to do to the whole right after its join."""

    table: DataFrame
    on: list[str]
    suffix: str
    drop: tuple[str, ...] = ()
    after: Callable[[DataFrame], DataFrame] | None = None


def merge_sources(base: DataFrame, sources: list[Source], keys: tuple[str, ...] = ("project", "bug_id", "id")) -> DataFrame:
    """``base`` with every source on its left join, in turn; then columns under a join's suffix go where their base is there, but for keys.

    All rows of ``base`` stay; a key that a source repeats repeats the row. Joins run on the given keys alone, so sources that share them share one
    partitioning of the base. A source may have any columns; only names that are taken get the suffix.
    """
    out = base
    for s in sources:
        out = C.join_suffixed(out, s.table.drop(*s.drop), s.on, s.suffix)
        out = s.after(out) if s.after else out
    kept = C.drop_suffixed_copies(out.columns, tuple(s.suffix for s in sources), keys)
    return out.select(*[F.col(f"`{c}`") for c in kept])


def map_within(rank: str, k: int, columns: list[str], stored: str = "map"):
    """The stored average precision of what is found within ``k``, else 0; the reciprocal rank within ``k`` where no such column is stored."""
    if stored not in columns:
        return reciprocal_at(F.col(rank), k)
    return F.when((F.col(rank) > 0) & (F.col(rank) <= k), F.col(stored)).otherwise(0.0)
