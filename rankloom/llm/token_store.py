"""Token ids in a binary format of byte or bit planes.

One shard is one value of bytes:

    8 bytes   magic b"RLPLANE1"
    4 x u32   planes kind (0 byte, 1 bit), ids in a block, number of blocks, number of documents
    u64       number of ids
    then      the documents' ids (i64) and lengths (u64) as one zstandard frame, its size (u64) before it
    then      the chunk index: for each block its first id (u64), its number of ids (u32) and the size of each plane (u32 each)
    then      the planes, each a zstandard frame, in the order of the index

A block holds a fixed number of ids (the last one of a shard fewer). Its ids, as little-endian u32, are transposed into 4
byte planes or 32 bit planes, so that the high ones, nearly constant, shrink to a few bytes. Shards close at document ends
and are rows of a Parquet table in the shared folder: Spark's commit protocol keeps half-written ones out after a lost task.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_of, scratch_path, small_batches, text_of, tidy
from .pretokens import encoder

MAGIC = b"RLPLANE1"
BLOCK = 65_536


def planes_of(ids: np.ndarray, bit: bool) -> list[bytes]:
    rows = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bit:
        return [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(32)]


def ids_of(planes: list[bytes], n: int, bit: bool) -> np.ndarray:
    if not bit:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def pack(doc_ids: list[int], lens: list[int], ids: np.ndarray, block: int = BLOCK, bit: bool = False, level: int = 1) -> bytes:
    """A shard of documents ``doc_ids``, of ``lens`` ids each."""
    z = zstandard.ZstdCompressor(level=level)
    head = z.compress(np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lens, "<u8").tobytes())
    index, frames = [], []
    for first in range(0, len(ids), block):
        part = ids[first : first + block]
        planes = [z.compress(p) for p in planes_of(part, bit)]
        index.append(struct.pack(f"<QI{len(planes)}I", first, len(part), *map(len, planes)))
        frames += planes
    return b"".join([MAGIC, struct.pack("<IIIIQQ", bit, block, len(index), len(doc_ids), len(ids), len(head)), head, *index, *frames])


def unpack(shard: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a shard."""
    if shard[:8] != MAGIC:
        raise ValueError("not a shard of token planes")
    bit, _, blocks, docs, total, size = struct.unpack_from("<IIIIQQ", shard, 8)
    z, at, n = zstandard.ZstdDecompressor(), 8 + 32, 32 if bit else 4
    head = z.decompress(shard[at : at + size])
    doc_ids, lens = np.frombuffer(head, "<i8", docs), np.frombuffer(head, "<u8", docs, docs * 8)
    entry = struct.Struct(f"<QI{n}I")
    at += size
    data = at + blocks * entry.size
    ids = np.zeros(total, np.uint32)
    for k in range(blocks):
        first, count, *sizes = entry.unpack_from(shard, at + k * entry.size)
        planes = []
        for s in sizes:
            planes.append(z.decompress(shard[data : data + s]))
            data += s
        ids[first : first + count] = ids_of(planes, count, bool(bit))
    return doc_ids, lens, ids


_NULL_ID = -(1 << 63)  # how a shard writes a null document id


def write_tokens(df: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, doc_id: str = "doc_id", text: str = "text", shard_ids: int = 1_000_000, bit: bool = False, block: int = BLOCK, partitions: int | None = None) -> None:
    """Encode each whole text, in ascending order of ``doc_id``, and write the shards to the Parquet table ``out``.

    Columns: part (range partition), shard (its number there), before (ids of the partition before it), n_ids, data.
    Texts are dealt by ranges of (doc_id, hash of the text), so that many rows of one id don't meet in one task. A null
    id comes first, a null text is empty; rows of one id follow the hash of their texts; other columns are ignored. Ids must be
    whole numbers above -2^63, which a shard writes for a null; another type that casts to them will do, and others raise.
    """
    n = partitions or parts_of(df)
    kept = df.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    kept = kept.withColumn("h", F.xxhash64("text"))
    schema = "part int, shard int, before long, n_ids long, data binary"

    def rows(batches):
        from pyspark import TaskContext

        own, part = encoder(tokenizer), TaskContext.get().partitionId()
        docs, lens, parts, size, shard, before = [], [], [], 0, 0, 0

        def shut():
            data = pack(np.concatenate(docs), np.concatenate(lens), np.concatenate(parts), block, bit)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "before", "n_ids", "data"])

        for batch in batches:
            every, at = batch.column(0).fill_null(_NULL_ID).to_numpy(), 0
            for ids, n in own.batch(batch.column(1).cast(pa.binary()).to_pylist()):
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), np.uint32(end_id)), n + 1
                ends = np.cumsum(n)
                first = 0
                while first < len(n):  # a shard ends with the document that fills it
                    used = int(ends[first - 1]) if first else 0
                    to = min(int(np.searchsorted(ends, used + shard_ids - size)) + 1, len(n))
                    docs.append(every[at + first : at + to])
                    lens.append(n[first:to])
                    parts.append(ids[used : int(ends[to - 1])])
                    size += int(ends[to - 1]) - used
                    first = to
                    if size >= shard_ids:
                        yield shut()
                        before, shard = before + size, shard + 1
                        docs, lens, parts, size = [], [], [], 0
                at += len(n)
        if docs:
            yield shut()

    dealt = kept.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    with small_batches(df.sparkSession):
        dealt.mapInArrow(tidy(rows), schema).write.option("compression", "uncompressed").parquet(out)


def read_tokens(spark, path: str, ids: bool = False) -> DataFrame:
    """The documents of a table of shards: doc_id, start, n_tokens, ids_crc32, shard, and ``ids`` if asked for.

    ``start`` counts all ids before, over shards in order. It needs one row of totals for each range partition that was
    written (as many as ``partitions`` there), summed in one small window and broadcast.
    """
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))
    fields = [("doc_id", T.LongType()), ("part", T.IntegerType()), ("shard", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())]
    schema = T.StructType([T.StructField(*f) for f in fields] + [T.StructField("ids", T.ArrayType(T.LongType()))] * ids)

    def rows(batches):
        for batch in batches:
            for part, shard, before, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                docs, lens, all_ids = unpack(data)
                raw, ends = memoryview(all_ids.astype("<u4").tobytes()), np.cumsum(lens.astype(np.int64))
                starts = ends - lens.astype(np.int64)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [
                    pa.array([None if d == _NULL_ID else d for d in docs.tolist()], pa.int64()),
                    pa.array([part] * len(docs), pa.int32()),
                    pa.array([shard] * len(docs), pa.int32()),
                    pa.array(starts + before),
                    pa.array(ends - starts),
                    pa.array(crc, pa.int64()),
                ]
                if ids:
                    out.append(pa.array([all_ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64())))
                yield pa.record_batch(out, schema.names)

    found = shards.select("part", "shard", "before", "data").mapInArrow(tidy(rows), schema)
    return found.join(F.broadcast(base), "part").select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", *["ids"] * ids)


def store_tokens(df: DataFrame, tokenizer: str, end_id: int | None = 2, **how) -> DataFrame:
    """Write ``df``'s ids to a table of shards in the shared folder and return what :func:`read_tokens` reads back.

    Nulls, ties and repeats as in :func:`write_tokens`. An empty table gives an empty result.
    """
    out = scratch_path(df.sparkSession, "token-planes")
    write_tokens(df, out, tokenizer, end_id, **how)
    return read_tokens(df.sparkSession, out)
