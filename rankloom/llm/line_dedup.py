"""Line dedup by hashes in order: text stays where it is, decisions travel as compressed bitmaps.

Lines become (hash, document, position), dealt by ranges of all three, so that a line that every document shares is spread
over many tasks, and sorted. Each task streams over its part in bounded memory. Only a task's first and last run can go on
in a neighbour: each task reports at most two such pieces, and one more for each HELD lines of an undecided run, and these
few rows are put together on the driver. What is decided is gathered for each document as a zlib-compressed bitmap of the lines that stay.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, parts_of, small, stored, text_of, tidy

BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 63)
_DROP, _OPEN, _PIECE = 0, 1, 2
#: Rows of an undecided run that a task holds; beyond, they wait as rows of their own.
HELD = 100_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


def _rows(doc_id: str, text: str, df: DataFrame) -> DataFrame:
    """Documents with the key that stands for them: their id and their text's hash."""
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("d"), F.xxhash64(text_of(text)).alias("r"), text_of(text).alias("text"))


def _stream(at_least: int | None):
    """Decide runs of equal hashes in a sorted part. ``at_least``: documents from which on a run goes; None: all but its first line go."""
    names = ["kind", "d", "r", "pos", "lines", "h1", "h2", "docs", "d2", "r2", "part"]

    def out(kind, rows, part, docs=0, end=None):
        h1, h2, d, r, pos, lines = rows
        n = len(h1)
        d2, r2 = (end if end else (0, 0))
        cols = [np.full(n, kind, np.int8), d, r, pos, lines, h1, h2, np.full(n, docs, np.int64), np.full(n, d2, np.int64), np.full(n, r2, np.int64), np.full(n, part, np.int32)]
        return pa.record_batch([pa.array(c) for c in cols], names)

    def decide(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first = True  # no run has been closed yet
        run = None  # the open run: hash, documents, last document, its first row, rows kept back, decided
        cut = lambda rows, m: tuple(x[m] for x in rows)
        join = lambda parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        def close(run, edge):
            if edge or run["waiting"]:
                yield out(_PIECE, run["head"], part, run["docs"], run["last"])
                if run["kept"]:
                    yield out(_OPEN, join(run["kept"]), part)

        for batch in batches:
            cols = [batch.column(i).to_numpy() for i in range(6)]  # h1 h2 d r pos lines
            h1, h2, d, r = cols[:4]
            if not len(h1):
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            fresh = np.ones(len(h1), bool)
            fresh[1:] = new[1:] | (d[1:] != d[:-1]) | (r[1:] != r[:-1])
            goes_on = run is not None and run["hash"] == (h1[0], h2[0])
            if goes_on and run["last"] == (d[0], r[0]):
                fresh[0] = False
            begins = np.flatnonzero(new)
            ends = np.append(begins[1:], len(h1))
            docs = np.add.reduceat(fresh.astype(np.int64), begins)
            if run is not None and not goes_on:
                yield from close(run, first)
                first, run = False, None
            # whole runs inside the batch, which are neither its first nor its last
            if len(begins) > 2:
                a, b = begins[1], begins[-1]
                each = np.repeat(docs[1:-1], np.diff(begins[1:]))
                gone = each >= at_least if at_least is not None else ~new[a:b]
                if gone.any():
                    yield out(_DROP, cut(cut(cols, slice(a, b)), gone), part)
            for k in dict.fromkeys((0, len(begins) - 1)):
                rows = cut(cols, slice(begins[k], ends[k]))
                if run is not None and k:
                    yield from close(run, first)
                    first, run = False, None
                if run is None:
                    run = {"hash": (h1[begins[k]], h2[begins[k]]), "docs": 0, "head": cut(rows, slice(0, 1)), "kept": [], "held": 0, "waiting": False}
                    if at_least is None:
                        run["kept"], rest = [run["head"]], cut(rows, slice(1, None))
                        if len(rest[0]):
                            yield out(_DROP, rest, part)
                        rows = None
                run["docs"] += int(docs[k])
                run["last"] = (d[ends[k] - 1], r[ends[k] - 1])
                if at_least is None:
                    if rows is not None:
                        yield out(_DROP, rows, part)
                elif run["docs"] >= at_least:
                    yield out(_DROP, join([*run["kept"], rows]), part)
                    run["kept"] = []
                else:
                    run["kept"].append(rows)
                    run["held"] += len(rows[0])
                    if run["held"] > HELD:
                        yield out(_OPEN, join(run["kept"]), part)
                        run["kept"], run["held"], run["waiting"] = [], 0, True
        if run is not None:
            yield from close(run, True)

    return decide


def _settle(pieces: list, at_least: int | None) -> list[tuple]:
    """Of runs that task borders cut, (h1, h2, part) of those whose rows held back go."""
    runs: dict = {}
    for p in sorted(pieces, key=lambda p: p.part):
        runs.setdefault((p.h1, p.h2), []).append(p)
    gone = []
    for (h1, h2), ps in runs.items():
        if at_least is None:
            gone += [(h1, h2, p.part) for p in ps[1:]]
        else:
            docs = sum(p.docs for p in ps) - sum((a.d2, a.r2) == (b.d, b.r) for a, b in zip(ps, ps[1:], strict=False))
            gone += [(h1, h2, p.part) for p in ps] if docs >= at_least else []
    return gone


def keep_bitmaps(df: DataFrame, at_least: int | None = 10, shortest: int = 1, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Return (d, r, n_lines, n_dropped, keep) for each document that loses a line.

    Texts split at newlines; a line's key is :func:`line_key`. With ``at_least``, keys in that many documents lose all their
    lines; with None, all but the first line in order of document and position. Keys of under ``shortest`` code points stay.
    d is the id (the least long for null) and r the text's 64-bit hash; rows that repeat both are one document. ``keep``
    holds one bit for each line, first line first, most significant bit first, compressed with zlib. Ids must be whole numbers
    above the least long; another type that casts to them will do, and others raise.
    """
    spark = df.sparkSession
    n = partitions or parts_of(df)
    lines = _rows(doc_id, text, df).select("d", "r", F.split("text", "\n").alias("ls"))
    lines = lines.select("d", "r", F.size("ls").alias("lines"), F.posexplode("ls").alias("pos", "line"))
    lines = lines.select("d", "r", "pos", "lines", line_key(F.col("line")).alias("key")).filter(F.length("key") >= shortest)
    lines = lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "d", "r", "pos", "lines")
    lines = stored(lines, "line-hashes")  # dealing by ranges reads them twice
    order = ["h1", "h2", "d", "r", "pos"]
    schema = "kind byte, d long, r long, pos int, lines int, h1 long, h2 long, docs long, d2 long, r2 long, part int"
    rows = stored(lines.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(tidy(_stream(at_least)), schema), "line-decisions")
    pieces = rows.filter(F.col("kind") == _PIECE).select("h1", "h2", "docs", "d", "r", "d2", "r2", "part").collect()  # two for each partition, and one for each HELD lines
    dropped(lines)
    gone = spark.createDataFrame(_settle(pieces, at_least), "h1 long, h2 long, part int")
    late = rows.filter(F.col("kind") == _OPEN).join(small(gone, gone.count()), ["h1", "h2", "part"], "left_semi")
    cols = ["d", "r", "pos", "lines"]
    leave = rows.filter(F.col("kind") == _DROP).select(cols).union(late.select(cols))
    each = leave.groupBy("d", "r").agg(F.max("lines").alias("n_lines"), F.collect_set("pos").alias("gone"))

    def bits(batches):
        for b in batches:
            keeps, counts = [], []
            for lines, gone in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                keep = np.ones(lines, np.uint8)
                keep[gone] = 0
                keeps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
                counts.append(len(gone))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(b.column(2).to_numpy().astype(np.int64)), pa.array(counts, pa.int64()), pa.array(keeps, pa.binary())], ["d", "r", "n_lines", "n_dropped", "keep"])

    return each.mapInArrow(tidy(bits), "d long, r long, n_lines long, n_dropped long, keep binary")


def _kept_lines(text: str, keep: bytes | None) -> tuple[str, int, int]:
    lines = text.split("\n")
    if keep is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    stay = [x for x, b in zip(lines, bits.tolist(), strict=True) if b]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def drop_lines(df: DataFrame, digest: bool = False, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Apply :func:`keep_bitmaps`: return (doc_id, n_lines, n_dropped) and the text that stays, or its sha256 with ``digest``.

    One row for each row of ``df``; other columns are ignored. A null or empty text is one empty line, which stays. A text
    that loses all lines is empty. A null id stays null. An empty table gives none.
    """
    maps = keep_bitmaps(df, doc_id=doc_id, text=text, **how).select("d", "r", "keep")
    last = "kept_sha256" if digest else "text"

    def rows(batches):
        for b in batches:
            done = [_kept_lines(t, k) for t, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            texts = [hashlib.sha256(t.encode()).hexdigest() if digest else t for t, _, _ in done]
            yield pa.record_batch([b.column(0), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_lines", "n_dropped", last])

    joined = _rows(doc_id, text, df).join(maps, ["d", "r"], "left").select("doc_id", "text", "keep")
    return joined.mapInArrow(tidy(rows), f"doc_id long, n_lines long, n_dropped long, {last} string")


LINES_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id
"""
