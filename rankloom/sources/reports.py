"""Reports from XML, JSON and JSON lines, keyed by their files' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUG = "STRUCT<_id: STRING, _opendate: STRING, _fixdate: STRING, _resolution: STRING, buginformation: STRUCT<summary: STRING, description: STRING>, fixedFiles: STRUCT<file: ARRAY<STRING>>>"
#: A root of each kind, with what didn't parse.
ONE, MANY = BUG[:-1] + ", _bad: STRING>", f"STRUCT<bug: ARRAY<{BUG}>, _bad: STRING>"
ROOT = r"^\x{FEFF}?(?:\s+|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\]\s*)?>)*<([A-Za-z_][\w.:-]*)"
REPORTS = "id STRING, title STRING, description STRING, opendate STRING, fixdate STRING, resolution STRING, files ARRAY<STRING>, path STRING"


def id_from_name(name: Column, own: Column | None = None) -> Column:
    """"Project_N.xml" is Project-N, cut at the last underscore; another stem gets the report's own id behind a hyphen, if it has one."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    cut = F.regexp_replace(stem, r"^(.*)_([^_]*)$", "$1-$2")
    alone = stem if own is None else F.when(own.isNotNull(), F.concat(stem, F.lit("-"), own.cast("string"))).otherwise(stem)
    return F.when(F.contains(stem, F.lit("_")), cut).otherwise(alone)


def unescaped(c: Column) -> Column:
    """Entities that were escaped twice; & comes last."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.trim(c)


def clean_bytes(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as Latin-1, without control characters."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x0C\x0E-\x1F]", "")


def parse_xml(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """(path, root, bad, bugs): whole documents by Spark's XML parser. The root's name says what they are: a ``bug``, a ``bugRepository`` whose children are
    the bugs, or nothing that is known. ``bad`` is the text of a document that isn't well-formed, which has no bugs.

    The parser, not a pattern, finds elements, so that tags in CDATA, comments or other roots are text.
    """
    d = files.select(F.col(name).alias("path"), clean_bytes(F.col(content)).alias("xml")).withColumn("root", F.regexp_extract("xml", "(?s)" + ROOT, 1))
    how = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    d = d.withColumns({"one": F.when(F.col("root") == "bug", F.from_xml("xml", ONE, how)), "many": F.when(F.col("root") == "bugRepository", F.from_xml("xml", MANY, how))})
    unknown = ~F.col("root").isin("bug", "bugRepository")
    bad = F.coalesce("one._bad", "many._bad", F.when(unknown & (F.col("root") == ""), F.col("xml")))
    alone = F.struct(*[F.col(f"one.{c}").alias(c) for c in ("_id", "_opendate", "_fixdate", "_resolution", "buginformation", "fixedFiles")])
    bugs = F.when(F.col("root") == "bug", F.array(alone)).otherwise(F.col("many.bug"))
    return d.select("path", "root", bad.alias("bad"), F.when(bad.isNull(), bugs).alias("bugs"))


def _xml_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return parse_xml(files.select(F.element_at(F.split("path", "/"), -1).alias("path"), "content"))


def broken_xml(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of XML files that give no reports: "malformed", or "root" where the root is neither a bug nor holds bugs."""
    d = _xml_files(spark, path)
    reason = F.when(F.col("bad").isNotNull(), "malformed").when(~F.col("root").isin("bug", "bugRepository"), "root")
    return d.select("path", reason.alias("reason")).filter("reason is not null")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """Reports of XML files, each with a root <bug> or a root <bugRepository> that holds some; :func:`broken_xml` has the files that give none.

    Files come as bytes, so that bad encodings and control characters don't lose a report. Entities are undone once more.
    """
    parsed = _xml_files(spark, path).select("path", F.explode("bugs").alias("b")).filter("b.buginformation is not null")
    info = F.col("b.buginformation")
    out = parsed.select(
        id_from_name(F.col("path"), F.col("b._id")).alias("id"),
        unescaped(F.coalesce(info["summary"], F.lit(""))).alias("title"),
        unescaped(F.coalesce(info["description"], F.lit(""))).alias("description"),
        F.col("b._opendate").alias("opendate"),
        F.col("b._fixdate").alias("fixdate"),
        F.col("b._resolution").alias("resolution"),
        F.coalesce(F.col("b.fixedFiles.file"), F.array().cast("array<string>")).alias("files"),
        "path",
    )
    return valid(out)


def read_json(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Reports of JSON lines, or of files that hold an array: title or summary, id or bug_id, else the file's name."""
    raw = spark.read.schema("id STRING, bug_id STRING, issue_id STRING, title STRING, summary STRING, description STRING").option("multiLine", array).option("recursiveFileLookup", True).json(path)
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    out = raw.select(F.coalesce(blank("id"), blank("bug_id"), blank("issue_id"), name).alias("id"), F.coalesce(blank("title"), blank("summary"), F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"))
    return valid(out)


def valid(reports: DataFrame) -> DataFrame:
    """Reports that have a title or a description."""
    return reports.filter((F.trim("title") != "") | (F.trim("description") != ""))


def rating_input(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """(bug_id, project, summary, description) of an array of issues; the project is what stands before the first hyphen."""
    r = read_json(spark, path, array)
    return r.select(F.col("id").alias("bug_id"), F.split("id", "-")[0].alias("project"), F.col("title").alias("summary"), "description")
