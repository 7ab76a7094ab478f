"""Copy-on-write upsert of keyed rows into a folder of sorted Parquet files.

:func:`write_sorted` writes a table as files of a fixed number of rows, sorted by its key. :func:`upsert` replays changes on it:
every id has a home, the last file that begins at or below it, or the first file. Rows and changes go as an RDD of (home, id, tag,
seq, change_id) through ``repartitionAndSortWithinPartitions`` with a partitioner of ranges, so that a home with very many new ids
spreads over several partitions, in order. Before that every partition keeps the newest change of each id alone, so an id
with a third of all changes sends a row for each partition. A streaming generator then folds the replay of one id after the other,
holding one change and one row, and spools what is left to a table in the shared folder; when the number of rows of each home is
known, rewritten homes are cut into balanced files, one written by each task. Homes that no change names aren't read.

What the driver holds is a row for each file and partition (first id, path, number of rows), never a row for each id.

Defined results: a row or change without an id takes no part; a null ``seq`` or ``change_id`` is below all others; changes that tie
in both go by the order of their text form, so reruns agree; an id that the table repeats has each of its rows in its home set or
deleted, and rows of it that stand in a file before its home stay as they are; other columns of the changes aren't read, and columns of
any name may stand beside the key; a table without rows has no files and no home, and changes to it do nothing.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, free, numbered, parts_of, scratch_path, small, stored, tidy

#: Ids whose newest change a task holds before the shuffle; beyond, what it holds goes out and is folded again behind it.
KEPT = 50_000
IGNORE, DELETE, SET = 0, 1, 2


def _order(df: DataFrame, key: str) -> list[str]:
    """The key, then all other columns that have an order, so that rows that share a key have one too."""
    return [f"`{c}`" for c in (key, *(n for n, t in df.dtypes if n != key and not re.search("map|variant|interval", t)))]


def _write_files(df: DataFrame, file: str, n: int, order: list[str], columns: list[str], folder: str) -> None:
    """Add a file for each value 0 to n - 1 of ``file``, each written by one task, row by row."""
    df.repartitionById(n, F.col(file)).sortWithinPartitions(*order).select(*[f"`{c}`" for c in columns]).write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)


def write_sorted(df: DataFrame, key: str, folder: str, rows: int) -> None:
    """Write ``df``, sorted by ``key``, as files of ``rows`` rows, the last with the rest; rows with a null key are left out."""
    order, at = _order(df, key), free(df, "at")
    placed, total = numbered(df.filter(F.col(f"`{key}`").isNotNull()), order, at, "sorted")
    if total:
        file = free(placed, "file")
        _write_files(placed.withColumn(file, F.floor(F.col(at) / rows).cast("int")), file, -(-total // rows), order, df.columns, folder)
    dropped(placed)


def _by_file(df: DataFrame, name: str) -> DataFrame:
    """``df``, read from files, with the path of each row's file."""
    return df.withColumn(name, df.metadataColumn("_metadata").getField("file_path"))


def files_of(df: DataFrame, key: str) -> list[tuple]:
    """(first id, path, rows) of the files that ``df`` is read from, in their order."""
    found = _by_file(df.select(f"`{key}`"), "path ").groupBy("path ").agg(F.min(f"`{key}`"), F.count("*")).collect()
    return sorted((first, path, n) for path, first, n in found)


class HomeRanges:
    """Partitions as ranges of (home, id): the number of split points at or below a key."""

    def __init__(self, splits: list[tuple]):
        self.splits = splits

    def __call__(self, key: tuple) -> int:
        return bisect_right(self.splits, key[:2])


def home_of(starts: list, id) -> int:
    return max(0, bisect_right(starts, id) - 1)


def _rank(x) -> tuple:
    return (x is not None, 0 if x is None else x)


def newest(pairs, kept: int = KEPT):
    """Of (key, change) the newest of each id so far; when ``kept`` ids are held all go out."""
    held: dict = {}
    for key, change in pairs:
        one = held.get(key[1])
        if one is None or (key, repr(change)) > (one[0], repr(one[1])):
            held[key[1]] = (key, change)
        if len(held) >= kept:
            yield from held.values()
            held.clear()
    yield from held.values()


def _same(a, b) -> bool:
    return a == b or (a is None and b is None) or (isinstance(a, float) and isinstance(b, float) and a != a and b != b)


def replay(sorted_pairs, part: int, starts: list, columns: list[str], key: str, sets: list[str], action):
    """Fold one id after the other: yield (home, part, place in the home's share of this partition, differs, alive, *row).

    An id's changes (tag 0) come in ascending order and before its rows (tag 1), so the last change stands alone when rows pass.
    """
    at = [columns.index(c) for c in sets]
    gone = (None,) * len(columns)
    place, last_home = 0, None
    for (home, id), pairs in groupby(sorted_pairs, key=lambda p: p[0][:2]):
        if home != last_home:
            place, last_home = 0, home
        won, won_key, does, seen = None, None, IGNORE, False
        for k, value in pairs:
            if k[2] == 0:
                if won is None or (k, repr(value)) > (won_key, repr(won)):
                    won, won_key = value, k
                continue
            if not seen:
                seen, does = True, IGNORE if won is None else action(starts[home], won[0], won[1])
            if does == DELETE:
                yield (home, part, place, True, False, *gone)
                continue
            differs = False
            if does == SET:
                differs = not all(_same(value[i], x) for i, x in zip(at, won[2:], strict=True))
                if differs:
                    value = list(value)
                    for i, x in zip(at, won[2:], strict=True):
                        value[i] = x
            yield (home, part, place, differs, True, *value)
            place += 1
        if not seen and won is not None and action(starts[home], won[0], won[1]) == SET:
            row = dict(zip(sets, won[2:], strict=True))
            row[key] = id
            yield (home, part, place, True, True, *(row.get(c) for c in columns))
            place += 1


def cut(n: int, most: int) -> list[int]:
    """Sizes of the fewest files of at most ``most`` rows, at most one apart, larger first."""
    k = -(-n // most)
    return [n // k + (i < n % k) for i in range(k)]


def plan(homes: int, sizes: dict[int, int], changed: set[int], most: int) -> tuple[dict[int, list[int]], int]:
    """The file number of each cut of each changed home, and the number of new files, once neighbours have joined.

    ``sizes`` has the rows of changed homes. Files that stay as they are part their neighbours; a home without rows doesn't.
    """
    numbers: dict[int, list[int]] = {}
    files, left = 0, None  # left: rows of the remaining left neighbour, if it is a new file
    for h in range(homes):
        if h not in changed:
            left = None
            continue
        numbers[h] = []
        for n in cut(sizes[h], most) if sizes[h] else []:
            if left is not None and left + n <= most:
                left += n
            else:
                left = n
                files += 1
            numbers[h].append(files - 1)
    return numbers, files


def _touched(changes: DataFrame, key: str, starts: list) -> list[int]:
    """Homes that a change names, from a scan of the ids alone."""

    def run(batches):
        seen: set = set()
        for b in batches:
            seen.update(home_of(starts, x) for x in b.column(0).unique().to_pylist() if x is not None)
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["home"])

    return [r.home for r in changes.select(f"`{key}`").mapInArrow(tidy(run), "home int").distinct().collect()]


def upsert(folder: str, schema: T.StructType, changes: DataFrame, key: str, seq: str, change_id: str, op: str, sets: list[str], most: int, action) -> set[str]:
    """Replay ``changes`` on the sorted files of ``folder``; return the paths of the files that stay from before.

    ``action(first id of the home, change_id, op)`` says what an id's newest change does: ``IGNORE``, ``DELETE`` or ``SET`` (the columns
    ``sets``, or a new row that has these alone). Only files whose rows then differ are rewritten, at most ``most`` rows each; the new
    ones are committed together by Spark before the old ones go.
    """
    spark = changes.sparkSession
    columns = schema.names
    read = spark.read.schema(schema).parquet(folder)
    files = files_of(read, key)
    starts = [f[0] for f in files]
    kinds = {f.name: f.dataType for f in schema}
    cols = lambda df, names: [df[f"`{n}`"] for n in names]
    # ids as the table has them; casting a double id to a long could make two ids one, so both sides meet in the table's type only
    changes = changes.select(changes[f"`{key}`"].cast(kinds[key]), *cols(changes, [seq, change_id, op]), *[changes[f"`{c}`"].cast(kinds[c]) for c in sets]).toDF("i", "s", "c", "o", *[f"v{k}" for k in range(len(sets))]).filter("i is not null")
    touched = _touched(changes.withColumnRenamed("i", key).select(f"`{key}`"), key, starts) if files else []
    if not touched:
        return {f[1] for f in files}

    paths = spark.createDataFrame([(files[h][1], h) for h in touched], "path_ string, home_ int")
    base = spark.read.schema(schema).parquet(*[files[h][1] for h in touched])
    base = base.select(base.metadataColumn("_metadata").getField("file_path"), *cols(base, columns)).toDF("path_", *[f"b{k}" for k in range(len(columns))])
    base = base.join(small(paths, len(touched)), "path_").select("home_", *[f"b{k}" for k in range(len(columns))])
    place = columns.index(key)
    rows = base.rdd.map(lambda r: ((r[0], r[1 + place], 1, (), ()), tuple(r[1:])))
    news = changes.rdd.map(lambda r: ((home_of(starts, r[0]), r[0], 0, _rank(r[1]), _rank(r[2])), tuple(r[2:]))).mapPartitions(newest)

    parts = parts_of(base) + parts_of(changes)
    share = min(1.0, 64 * parts / max(1, changes.count()))  # split points come from so many ids at most, on average, and the files' first ids
    ids = {r.i for r in changes.select("i").sample(share, seed=13).collect()} | {starts[h] for h in touched}
    marks = sorted({(home_of(starts, i), i) for i in ids})
    splits = sorted({marks[len(marks) * k // parts] for k in range(1, parts)} - {marks[0]})
    ordered = rows.union(news).repartitionAndSortWithinPartitions(len(splits) + 1, HomeRanges(splits))
    folded = ordered.mapPartitionsWithIndex(lambda p, pairs: replay(pairs, p, starts, columns, key, sets, action))
    fields = [T.StructField(n, t) for n, t in (("home_", T.IntegerType()), ("part_", T.IntegerType()), ("place_", T.LongType()), ("differs_", T.BooleanType()), ("alive_", T.BooleanType()))]
    spool = T.StructType([*fields, *[T.StructField(f"b{k}", kinds[c]) for k, c in enumerate(columns)]])
    spooled = stored(spark.createDataFrame(folded, spool, verifySchema=False), "spool", compression="zstd")

    counts = spooled.groupBy("home_", "part_").agg(F.count(F.when(F.col("alive_"), 1)).alias("n"), F.max("differs_").alias("differs")).collect()
    sizes: dict[int, int] = {}
    offset = {}
    for r in sorted(counts):
        offset[r.home_, r.part_] = sizes.get(r.home_, 0)
        sizes[r.home_] = sizes.get(r.home_, 0) + r.n
    changed = {r.home_ for r in counts if r.differs}
    numbers, n = plan(len(files), sizes, changed, most)
    if n:
        where = [(h, p, off, len(numbers[h]), sizes[h]) for (h, p), off in offset.items() if h in changed and numbers[h]]
        where = small(spark.createDataFrame(where, "home_ int, part_ int, off_ long, cuts_ int, n_ long"), len(where))
        which = [(h, i, f) for h, fs in numbers.items() for i, f in enumerate(fs)]
        which = small(spark.createDataFrame(which, "home_ int, cut_ int, file_ int"), len(which))
        at, q, r = F.col("off_") + F.col("place_"), F.expr("n_ div cuts_"), F.expr("n_ % cuts_")
        cut_ = F.when(at < r * (q + 1), F.floor(at / (q + 1))).otherwise(r + F.floor((at - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("int")
        out = spooled.filter("alive_").join(where, ["home_", "part_"]).withColumn("cut_", cut_).join(which, ["home_", "cut_"])
        out = out.select("file_", *[f"b{k}" for k in range(len(columns))])
        order = [f"`b{columns.index(o[1:-1])}`" for o in _order(read, key)]
        named = out.repartitionById(n, F.col("file_")).sortWithinPartitions(*order).drop("file_").toDF(*columns)
        named.write.option("maxRecordsPerFile", 0).mode("append").parquet(folder)
    old = [files[h][1] for h in changed]
    for path in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)
    dropped(spooled)
    return {f[1] for f in files} - set(old)


DIGEST = "first_id long, n_rows long, cents long, rows_crc long, ids_sha256 string, columns string, path string, rewritten boolean"


def digest(spark: SparkSession, folder: str, schema: T.StructType, key: str, money: str, texts: list[str], stay: set[str]) -> DataFrame:
    """A row for each file, read back: its first id, rows, cents of ``money``, checksums of ``texts`` and of its ids, and column names."""
    df = spark.read.parquet(folder)
    names = ",".join(df.columns)
    if [f.name for f in schema] != df.columns:
        raise ValueError(f"{folder} has the columns {names}")
    cents = F.coalesce(F.floor(100 * F.col(f"`{money}`") + 0.5).try_cast("long"), F.lit(0))
    crc = F.crc32(F.concat_ws("|", *[F.coalesce(F.col(f"`{t}`").cast("string"), F.lit("")) for t in texts]).cast("binary"))
    each = df.select(df.metadataColumn("_metadata").getField("file_path").alias("path"), F.col(f"`{key}`").cast("long").alias("id"), cents.alias("cents"), crc.alias("crc"))

    def run(batches):
        now, first, n, c, x, sha = None, 0, 0, 0, 0, None
        row = lambda: pa.RecordBatch.from_pylist([{"first_id": first, "n_rows": n, "cents": c, "rows_crc": x, "ids_sha256": sha.hexdigest(), "columns": names, "path": now, "rewritten": now not in stay}], schema=wanted)
        for b in batches:
            start, paths = 0, b.column(0).to_pylist()
            ids, money_, crcs = (b.column(k).to_pylist() for k in (1, 2, 3))
            while start < len(paths):
                end = bisect_right(paths, paths[start], start)
                if paths[start] != now:
                    if now is not None:
                        yield row()
                    now, first, n, c, x, sha = paths[start], ids[start], 0, 0, 0, hashlib.sha256()
                sha.update((("," if n else "") + ",".join(map(str, ids[start:end]))).encode())
                n, c, x = n + end - start, c + sum(money_[start:end]), x + sum(crcs[start:end])
                start = end
        if now is not None:
            yield row()

    wanted = pa.schema([("first_id", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string()), ("columns", pa.string()), ("path", pa.string()), ("rewritten", pa.bool_())])
    return each.repartition("path").sortWithinPartitions("path", "id").mapInArrow(tidy(run), DIGEST)


def crc(x) -> int:
    return zlib.crc32(("" if x is None else str(x)).encode())


def by_checksum(first_id, change_id, op) -> int:
    """The rule of the registered query: ignored where the home's checksum says so, a deletion by ``op`` or by the change's checksum."""
    h = crc(first_id) % 10
    return IGNORE if h > 7 else DELETE if op == "D" or crc(change_id) % 8 < h else SET


def upsert_clients(clients: DataFrame, changes: DataFrame, files: int = 1500) -> DataFrame:
    """Write a share of ``clients`` as sorted files in a new folder, replay ``changes`` on them and describe every file that is there."""
    spark = clients.sparkSession
    folder = scratch_path(spark, "clients")
    most = 1 + clients.count() // files
    some = clients.filter(F.crc32(F.col("client_id").cast("string").cast("binary")) % 7 > 3)
    write_sorted(some, "client_id", folder, most)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in clients.schema])
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], DIGEST)
    stay = upsert(folder, schema, changes, "client_id", "seq", "change_id", "op", ["source", "segment", "city", "balance"], most, by_checksum)
    left = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    if not any(s.getPath().getName().endswith(".parquet") for s in left):
        return spark.createDataFrame([], DIGEST)
    return digest(spark, folder, schema, "client_id", "balance", ["source", "segment", "city"], stay)
