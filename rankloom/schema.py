"""Column roles, keys and names: work on schemas, without reading data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

#: Columns that would leak an outcome into features.
LEAK_PREFIXES, LEAK_SUBSTRINGS = ("mrr", "rank_", "map"), ("top@",)
#: A feature's category: the first whose substring is in its name.
CATEGORIES = (("embedding", "semantic"), ("semantic", "semantic"), ("txt_", "text"), ("exc_", "exception"), ("exception", "exception"), ("stacktrace", "exception"), ("has_", "structure"), ("num_", "counts"), ("z_", "rating"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as NULL in every floating-point column, so that aggregates skip it."""
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`") for f in df.schema])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def without_leaks(columns: list[str]) -> list[str]:
    return [c for c in columns if not c.startswith(LEAK_PREFIXES) and not any(s in c for s in LEAK_SUBSTRINGS)]


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", contains: str = "") -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and contains in c)


def tools_of(columns: list[str], prefix: str) -> list[str]:
    """Tool names in ``prefix``_<tool> columns, missingness flags apart."""
    return sorted(c[len(prefix) + 1 :] for c in columns if c.startswith(prefix + "_") and not c.endswith("_is_missing"))


def category_of(name: str, rules: tuple = CATEGORIES) -> str:
    return next((c for s, c in rules if s in name), "other")


def prefer(columns: list[str], family: list[str]) -> str | None:
    """The first of ``family`` that is there."""
    return next((c for c in family if c in columns), None)


def one_per_length_family(columns: list[str]) -> list[str]:
    """Of the columns that all say how long a text is, the first in order of priority stays."""
    family = ["description_length", "description_chars", "txt_description_char_len", "txt_description_word_count"]
    stay = prefer(columns, family)
    return [c for c in columns if c not in family or c == stay]


def drop_suffixed_copies(columns: list[str], suffixes: tuple[str, ...] = ("_ratings", "_categ", "_fine_grained", "_bee"), keys: tuple[str, ...] = ("project", "bug_id", "id")) -> list[str]:
    """Columns without those that repeat another one under a join's suffix. The base ends at the last underscore, so a suffix of two words stays."""
    return [c for c in columns if not (c.endswith(suffixes) and c.rsplit("_", 1)[0] in columns and c.rsplit("_", 1)[0] not in keys)]


def split_id(id_col: str | Column = "id") -> tuple[Column, Column]:
    """(project, bug_id) of "Project-N", cut at the first hyphen; no number: null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    parts = F.split(c, "-", 2)
    return F.get(parts, F.lit(0)).alias("project"), F.get(parts, F.lit(1)).try_cast("bigint").alias("bug_id")


def repair_keys(project: str, bug_id: str) -> tuple[Column, Column]:
    """Keys of rows whose bug_id is itself "Project-N"; both columns come from it then."""
    joint = F.contains(F.col(bug_id), F.lit("-"))
    parts = F.split(F.col(bug_id), "-", 2)
    return F.when(joint, parts[0]).otherwise(F.col(project)).alias(project), F.when(joint, F.get(parts, F.lit(1))).otherwise(F.col(bug_id)).try_cast("bigint").alias(bug_id)


def last_token(bug_id: str) -> Column:
    """What follows the last hyphen."""
    return F.element_at(F.split(F.col(bug_id), "-"), -1).alias(bug_id)


def normal_id(c: str) -> Column:
    """An id as text without a trailing ".0"; null is empty."""
    return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"\.0$", ""), F.lit(""))


def join_suffixed(left: DataFrame, right: DataFrame, on: list[str], suffix: str, how: str = "left", left_suffix: str = "") -> DataFrame:
    """Join, with ``suffix`` on columns of ``right`` whose names ``left`` has too, and ``left_suffix`` on those of ``left``."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    names = lambda df, s: [F.col(f"`{c}`").alias(c + s if c in both else c) for c in df.columns]
    return (left.select(*names(left, left_suffix)) if left_suffix else left).join(right.select(*names(right, suffix)), on, how)


def display_name(c: Column) -> Column:
    """A feature's name for reports: no z_ in front, words capitalised."""
    return F.initcap(F.replace(F.regexp_replace(c, "^z_", ""), F.lit("_"), F.lit(" ")))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def latex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([&%$#_{}])", r"\\$1")
