"""Shared helpers: scratch tables in the folder that the whole cluster sees, and broadcasts behind a check of their size.

Python operators get Arrow batches that Spark bounds by bytes and by rows, so that many long texts never sit in one batch: 8 MB
while a scratch table is written, and what ``spark.sql.execution.arrow.maxBytesPerBatch`` says, or Spark's 64 MB, otherwise.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that a table may have for it to be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which all executors must share; on a single machine one of our own if that is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20):
    """Meanwhile Arrow batches have about ``most`` bytes, unless the session says something else."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name, None) is None
    if own:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(name)


def stored(df: DataFrame, name: str, compression: str = "uncompressed") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lineage ends here, and a lost executor loses nothing.

    Most of what is stored is hashes, which don't shrink; without a codec an executor that reads and writes very many small
    files holds no native buffers for each. Texts are worth ``compression``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def numbered(df: DataFrame, order: list, at: str, name: str) -> tuple[DataFrame, int]:
    """``df`` sorted by ``order`` as a stored table with each row's place from 0 in column ``at``, and the number of rows.

    The sort's partitions are counted; a row's place is its place in its partition behind the rows of the partitions before.
    """
    placed = stored(df.sort(*order).withColumn(at, F.monotonically_increasing_id()), name, compression="zstd")
    part = F.shiftright(at, 33).cast("int")
    counts = {r.part: r.n for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    out = placed.withColumn(at, F.get(F.array(*map(F.lit, before or [0])), part) + F.col(at).bitwiseAND((1 << 33) - 1))
    out._scratch = placed._scratch
    return out, total


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` made, once all that was read from them is stored in turn."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame, rows: int | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is, to be joined by shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def parts_of(df: DataFrame, each: int = 32_000_000) -> int:
    """Partitions for a shuffle of ``df``'s rows: ``spark.sql.shuffle.partitions``, and more where its files are so large that one would hold over ``each`` of their (compressed) bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, -(-size // each)) if size < 1 << 55 else own  # beyond, the size isn't known


def tidy(rows):
    """``rows`` for mapInArrow, after which its worker gives freed memory back: workers live on and serve other stages, whose tasks need it."""

    def run(batches):
        try:
            yield from rows(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return run


def free(df: DataFrame, name: str) -> str:
    """A column name that begins with ``name`` and that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
