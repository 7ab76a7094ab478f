"""Result tables, optional tables, statements about reports, listings, published tables, and what is written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATEMENTS = "bug_id STRING, stats STRUCT<has_OB: BOOLEAN, has_EB: BOOLEAN, has_S2R: BOOLEAN, missing_OB: BOOLEAN, missing_EB: BOOLEAN, missing_S2R: BOOLEAN, num_OB: INT, num_EB: INT, num_S2R: INT>"
RESULTS = "project STRING, bug_id STRING, tool STRING, detected STRING, rank DOUBLE, mrr DOUBLE, map DOUBLE, `top@1` INT, `top@5` INT, `top@10` INT"


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def optional(read, spark: SparkSession, schema: str) -> DataFrame:
    """``read()``, or an empty table of ``schema`` where its path isn't there."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Observed, expected and reproduction statements by report from JSON lines; lines that don't parse, have no id or no figures are left out."""
    d = spark.read.schema(STATEMENTS).option("mode", "DROPMALFORMED").json(path)
    return d.filter("bug_id is not null and stats is not null").select("bug_id", "stats.*")


def keys_of_names(names: DataFrame, name: str, pattern: str, columns: tuple[str, ...]) -> DataFrame:
    """File names as keys by a pattern's groups; names that don't match have null keys and status "skipped"."""
    ok = F.rlike(F.col(name), F.lit(pattern))
    keys = [F.when(ok, F.regexp_extract(name, pattern, i + 1)).alias(c) for i, c in enumerate(columns)]
    return names.select(name, *keys, F.when(ok, "processed").otherwise("skipped").alias("status"))


HTML_NAME = r"^defects4j-([^-]+)-(\d+)\.html$"
SUSPICION_NAME = r"^([A-Za-z]+)-(\d+)_method-susps\.csv$"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a folder's files, by Spark's own listing."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))


def latex_text(c: Column) -> Column:
    """A cell as plain text: no math signs, daggers and emphasis, escapes undone, white space as single spaces."""
    for pattern, by in ((r"(?<!\\)\$", ""), (r"\^?\{?\s*\\d?dagger(?:\s*\})?", ""), (r"\\(?:textbf|textit|emph|texttt)\{((?:[^{}\\]|\\.)*)\}", "$1"), (r"\\([&%$#_{}])", "$1"), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, by)
    return F.trim(c)


#: Rules and comments that stand between a table's rows, the table's body, and a row that is one wide or emphasised cell.
RULE, COMMENT = r"\\(?:toprule|midrule|bottomrule|hline|cline\{[^}]*\}|cmidrule(?:\([^)]*\))?\{[^}]*\})", r"(?<!\\)%[^\n]*"
BODY = r"(?s)\\begin\{tabular[*xy]?\}(?:\{[^}]*\})*(.*?)\\end\{tabular[*xy]?\}"
WIDE = r"(?s)^\s*(?:\\multicolumn\{\d+\}\{[^}]*\}\{(.*)\}|(\\text(?:bf|it)\{(?:[^{}\\]|\\.)*\}))\s*$"


def read_latex_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, group, cells) of the LaTeX tables in files: rows end at a double backslash, cells at a bare &; a row that is one wide cell,
    or one emphasised one, is the group of the rows below it.

    Order matters within a file, which a table in print is small enough for: one file is one window.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", COMMENT, "").alias("text"))
    body = F.regexp_extract("text", BODY, 1)
    body = F.regexp_replace(F.when(body != "", body).otherwise(F.col("text")), RULE, "")
    rows = whole.select("file", F.posexplode(F.split(body, r"\\\\(?:\[[^\]]*\])?")).alias("i", "row")).filter(F.trim(F.regexp_replace("row", r"\s+", " ")) != "")
    wide = F.rlike("row", F.lit(WIDE)) & ~F.rlike("row", F.lit(r"(?<!\\)&"))
    name = F.when(wide, latex_text(F.concat(F.regexp_extract("row", WIDE, 1), F.regexp_extract("row", WIDE, 2))))
    group = F.last(name, ignorenulls=True).over(W.partitionBy("file").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    out = rows.select("file", "i", group.alias("group"), F.transform(F.split("row", r"(?<!\\)&"), latex_text).alias("cells"), wide.alias("wide"))
    return out.filter("not wide").drop("wide")


def read_latex_stats(spark: SparkSession, path: str) -> DataFrame:
    """(group, feature, mean, std, min, max): the rows of LaTeX tables that are a name and four numbers."""
    num = [F.get("cells", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(("mean", "std", "min", "max"), 1)]
    d = read_latex_rows(spark, path).filter(F.size("cells") == 5).select("group", F.col("cells")[0].alias("feature"), *num)
    return d.filter("mean is not null and std is not null and min is not null and max is not null")


def _latex_cell(df: DataFrame, c: str, digits: int, math: bool) -> Column:
    from ..schema import latex_escape

    numeric = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    text = F.format_string(f"%.{digits}f", F.col(c).cast("double")) if numeric else latex_escape(F.col(c).cast("string"))
    text = F.concat(F.lit("$"), text, F.lit("$")) if numeric and math else text
    return F.coalesce(F.when(F.col(c).isNotNull(), text), F.lit("--"))


def latex_rows(df: DataFrame, columns: list[str], digits: int = 2, math: bool = False) -> DataFrame:
    """(line): each row as a line of a LaTeX table, numbers with ``digits`` (in math signs, if asked for), nulls as dashes, text escaped."""
    return df.select(F.concat(F.concat_ws(" & ", *[_latex_cell(df, c, digits, math) for c in columns]), F.lit(r" \\")).alias("line"))


def latex_table(df: DataFrame, columns: list[str], header: list[str], group: str | None = None, order: str | None = None, digits: int = 2, caption: str = "") -> DataFrame:
    """(place, line) of a whole LaTeX table: head, the groups in alphabetical order with a row of their own each, their rows by ``order``, and end.

    What is emphasised in the row of a group is its name; numbers stand in math signs, as :func:`read_latex_rows` reads them.
    """
    key = F.col(group) if group else F.lit("")
    place = lambda part, name, kind, last: F.struct(F.lit(part).alias("part"), name.alias("name"), F.lit(kind).alias("kind"), last.alias("last")).alias("place")
    fixed = lambda part, *lines: df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select(place(part, F.lit(""), 0, F.format_string("%04d", "i")), "line")
    from ..schema import latex_escape

    rows = df.select(place(1, key, 2, F.col(order or columns[0]).cast("string")), F.concat(F.concat_ws(" & ", *[_latex_cell(df, c, digits, True) for c in columns]), F.lit(r" \\")).alias("line"))
    out = fixed(0, r"\begin{table}[h]", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\toprule", " & ".join(rf"\textbf{{{h}}}" for h in header) + r" \\").unionByName(rows)
    if group:
        head = F.concat(F.lit("\\midrule\n" + rf"\multicolumn{{{len(columns)}}}{{l}}{{\textit{{"), latex_escape(key), F.lit(r"}} \\"))
        out = out.unionByName(df.select(group).distinct().select(place(1, key, 1, F.lit("")), head.alias("line")))
    return out.unionByName(fixed(2, r"\bottomrule", r"\end{tabular}", r"\end{table}"))


def write_latex(lines: DataFrame, path: str) -> None:
    """Write the lines of :func:`latex_table` in their order as one file; a table in print is small."""
    lines.repartition(1).sortWithinPartitions("place").select("line").write.mode("overwrite").text(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a Parquet table, arrays and maps as JSON."""
    nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("append").parquet(path)


def append_once(df: DataFrame, path: str, run: str, batch: int, counters: dict[str, Column] | None = None, log: str | None = None) -> dict[str, int]:
    """Write ``df`` as batch ``batch`` of ``run``, in the place of what an earlier try of it left, so a retry adds nothing twice.

    ``counters`` are aggregates that Spark observes in the pass that writes; they are returned and, with ``log``, written as the row of this
    run and batch, again in the place of an earlier one. The table reads without the columns ``run`` and ``batch`` through :func:`read_batches`.
    """
    seen = Observation() if counters else None
    if seen is not None:
        df = df.observe(seen, *[e.alias(n) for n, e in counters.items()])
    at = f"run={run}/batch={batch}"
    df.write.mode("overwrite").parquet(f"{path}/{at}")
    counts = {n: int(v or 0) for n, v in seen.get.items()} if seen is not None else {}
    if log is not None and counts:
        df.sparkSession.createDataFrame([tuple(counts.values())], ", ".join(f"{n} long" for n in counts)).coalesce(1).write.mode("overwrite").parquet(f"{log}/{at}")
    return counts


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`append_once` has written, without its run and batch."""
    return spark.read.parquet(path).drop("run", "batch")


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)
