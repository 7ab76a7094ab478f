"""Exact search for the highest inner products with ball trees.

The rows are dealt evenly into shards, and each task builds balanced ball trees over the rows it gets: a node's ball is the mean
of its vectors and their largest distance from it, its halves are parted along the line between two far vectors. The trees are a table,
one row each. Queries go in groups. A task has a group and a few shards: it goes down each tree with all the group's
queries, drops the nodes whose upper bound q.c + |q| r is below the query's kth score so far, and reads the leaves that are left in the
order of that bound, so that scores rise early and later leaves fall away. The kth score passes on from tree to tree in a task;
and trees are searched in waves, each eight times as many as before, where the kth scores of one wave, over all tasks, are the start of the
next. Nothing is cut off: a node goes only if it can't hold a result.

Defined results: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an id, which no result
could name. Candidates are all other rows of another id and of the query's length; where an id repeats, each of its rows is a candidate, and of
a repeated query the least vector (component by component) asks. Scores are exact whole numbers; those beyond a long are its end.
Ties go to the smaller id. Other columns aren't read. No rows or no queries give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, small, stored, tidy
from .vectors import LEAST, Best, inner, matrix, norms, one_of_each_id, whole

TREE_ROWS = 16_384
LEAF_ROWS = 64
GROUP = 4_096
FIRST_WAVE, GROWTH = 4, 8

TREE = "shard int, seq int, dim int, ids binary, vecs binary, centres binary, radii binary"


class Tree:
    """A perfect binary tree of balls; level d has 2**d nodes, whose rows are the cuts of all rows into 2**d parts of equal size."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray, centres: np.ndarray, radii: np.ndarray):
        self.vecs, self.ids, self.centres, self.radii = vecs, ids, centres, radii
        self.depth = max(0, len(radii).bit_length() - 1)

    @staticmethod
    def edges(n: int, level: int) -> list[int]:
        cuts = [0, n]
        for _ in range(level):
            cuts = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in (a, (a + b) // 2)] + [n]
        return cuts

    @classmethod
    def build(cls, vecs: np.ndarray, ids: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        n = len(vecs)
        order, depth = np.arange(n), 0
        while n >> depth > leaf:
            depth += 1
        centres, radii = [], []
        for level in range(depth + 1):
            cuts = cls.edges(n, level)
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = vecs[order[a:b]]
                c = x.mean(0)
                away = norms(x - c)
                centres.append(c)
                radii.append(away.max() * (1 + 1e-9) + 1e-9 * (1 + np.abs(c).max(initial=0)))
                if level < depth:
                    one = x[away.argmax()]
                    two = x[norms(x - one).argmax()]
                    order[a:b] = order[a:b][np.argsort((x - c) @ (two - one), kind="stable")]
        return cls(vecs[order], ids[order], np.array(centres), np.array(radii))

    def bounds(self, q: np.ndarray, size: np.ndarray, node: int) -> np.ndarray:
        """At least the inner product of each query and any vector of the node, a little raised against rounding."""
        c, r = self.centres[node], self.radii[node]
        return q @ c + size * r + 1e-9 * size * (np.sqrt(c @ c) + r) + 1e-6

    def search(self, q: np.ndarray, own: np.ndarray, best: Best) -> None:
        """Offer ``best`` all vectors that can be among the queries' best."""
        size, largest = norms(q), norms(self.vecs).max(initial=0)
        alive, first = {0: np.arange(len(q))}, 0
        for level in range(self.depth + 1):
            below: dict[int, np.ndarray] = {}
            bound = {}
            for node, rows in alive.items():
                b = self.bounds(q[rows], size[rows], first + node)
                some = b >= best.floor[rows]
                if some.any():
                    bound[node] = rows[some], b[some]
                    if level < self.depth:
                        below[2 * node] = below[2 * node + 1] = rows[some]
            alive, first = below, first + (1 << level)
        if not bound:
            return
        # (query, leaf) in the order of the bound; in each round a query reads twice as many leaves as before
        leaf = np.concatenate([np.full(len(rows), node) for node, (rows, _) in bound.items()])
        row = np.concatenate([rows for rows, _ in bound.values()])
        high = np.concatenate([b for _, b in bound.values()])
        order = np.lexsort((-high, row))
        leaf, row, high = leaf[order], row[order], high[order]
        turn = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row]
        cuts, step, begin = self.edges(len(self.vecs), self.depth), 1, 0
        while begin <= turn.max(initial=-1):
            now = np.flatnonzero((turn >= begin) & (turn < begin + step) & (high >= best.floor[row]))
            for node in np.unique(leaf[now]):
                rows, part = row[now[leaf[now] == node]], slice(cuts[node], cuts[node + 1])
                scores = inner(q[rows], self.vecs[part], float(size[rows].max() * largest))
                best.offer(rows, scores, self.ids[part], self.ids[part][None, :] != own[rows][:, None])
            best.settle()
            begin, step = begin + step, step * 2


def build_trees(rows: DataFrame, shards: int, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Deal (id long, vec array<double>) evenly to ``shards`` and build a tree of each length of vector over at most ``tree_rows`` rows at a time."""

    def run(batches):
        from pyspark import TaskContext

        shard, seq, held, count = TaskContext.get().partitionId() % shards, 0, {}, {}

        def tree(dim):
            nonlocal seq
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            t = Tree.build(vecs, ids)
            seq += 1
            return pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "dim": dim, "ids": t.ids.astype("<i8").tobytes(), "vecs": t.vecs.astype("<f8").tobytes(), "centres": t.centres.astype("<f8").tobytes(), "radii": t.radii.astype("<f8").tobytes()}], schema=schema)

        for b in batches:
            dims = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(dims)):
                part = b.filter(pa.array(dims == dim))
                ids, vecs = part.column(0).to_numpy(zero_copy_only=False), matrix(part.column(1), len(part))
                for at in range(0, len(ids), tree_rows):
                    held.setdefault(dim, []).append((ids[at : at + tree_rows], vecs[at : at + tree_rows]))
                    count[dim] = count.get(dim, 0) + len(ids[at : at + tree_rows])
                    if count[dim] >= tree_rows:
                        yield tree(dim)
                        count[dim] = 0
        for dim in sorted(held):
            yield tree(dim)

    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("dim", pa.int32()), *[(c, pa.binary()) for c in ("ids", "vecs", "centres", "radii")]])
    return rows.repartition(shards).mapInArrow(tidy(run), TREE)


def _unpack(row: dict) -> Tree:
    ids, dim = np.frombuffer(row["ids"], "<i8"), row["dim"]
    radii = np.frombuffer(row["radii"], "<f8")
    return Tree(np.frombuffer(row["vecs"], "<f8").reshape(len(ids), dim), ids, np.frombuffer(row["centres"], "<f8").reshape(len(radii), dim), radii)


def _searched(k: int):
    """(grp, shard, kind, id, vec, floor, tree...) in the order of group, shard and kind, queries before trees: each group's best of its shards."""
    wanted = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        now, group, parts, best = None, None, [], None
        floors: dict[int, int] = {}

        def done():
            for q, _, b in best or ():
                yield pa.RecordBatch.from_arrays([pa.array(q[b.query]), pa.array(b.id), pa.array(b.score)], schema=wanted)

        for batch in batches:
            for at in _runs(batch.column(0), batch.column(1), batch.column(2)):
                b = batch.slice(*at)
                key = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
                if key != now:
                    yield from done()
                    if key[0] != group:
                        floors = {}
                    for q, _, x in best or ():
                        if key[0] == group:
                            floors.update(zip(q.tolist(), x.floor.tolist(), strict=True))
                    now, group, parts, best = key, key[0], [], None
                if b.column(2)[0].as_py() == 0:
                    parts.append(b)
                    continue
                if best is None:
                    best = [_queries(p, k, floors) for x in parts for p in _by_length(x)]
                for row in b.select(["dim", "ids", "vecs", "centres", "radii"]).to_pylist():
                    tree = _unpack(row)
                    for ids, q, x in best:
                        if q.shape[1] == row["dim"]:
                            tree.search(q, ids, x)
        yield from done()

    return tidy(run)


def _runs(*columns) -> list[tuple[int, int]]:
    """(offset, length) of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        x = c.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(new)
    return list(zip(at.tolist(), np.diff(np.append(at, n)).tolist(), strict=True))


def _by_length(b) -> list:
    dims = b.column(4).value_lengths().to_numpy(zero_copy_only=False)
    return [b.filter(pa.array(dims == d)) for d in np.unique(dims)]


def _queries(b, k: int, floors: dict[int, int]) -> tuple[np.ndarray, np.ndarray, Best]:
    ids = b.column(3).to_numpy(zero_copy_only=False)
    floor = b.column(5).to_numpy(zero_copy_only=False)
    floor = np.maximum(floor, [floors.get(i, LEAST) for i in ids.tolist()]) if floors else floor
    return ids, matrix(b.column(4), len(ids)), Best(len(ids), k, floor)


def _first(found: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", tree_rows: int = TREE_ROWS, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of another id with the highest inner products, for each id that ``is_query`` picks."""
    spark = table.sparkSession
    rows = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole(F.col(vector), scale).alias("vec"), is_query.alias("asks")).filter(F.col("vec").isNotNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-table.count() // tree_rows))
    trees = stored(build_trees(rows.select("id", "vec"), shards, tree_rows), "trees")
    queries = one_of_each_id(rows.filter("asks").select("id", "vec"), "id", "vec")
    groups = max(1, -(-table.filter(is_query & F.col(key).isNotNull()).count() // group))
    queries = stored(queries.withColumn("grp", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")), "queries")
    none = lambda kind: F.lit(None).cast(kind)
    found, begin, size = None, 0, FIRST_WAVE
    while begin < shards:
        end = min(shards, begin + size)
        asked = queries.withColumn("floor", F.lit(LEAST))
        if found is not None:
            kth = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
            asked = queries.join(kth, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(LEAST)))
        left = asked.select("grp", F.explode(F.sequence(F.lit(begin), F.lit(end - 1))).alias("shard"), F.lit(0).alias("kind"), "id", "vec", "floor", none("int").alias("dim"), *[none("binary").alias(c) for c in ("ids", "vecs", "centres", "radii")])
        right = trees.filter(F.col("shard").between(begin, end - 1)).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "shard", F.lit(1).alias("kind"), none("long").alias("id"), none("array<double>").alias("vec"), none("long").alias("floor"), "dim", "ids", "vecs", "centres", "radii")
        dealt = left.unionByName(right).repartition(max(parts, min(groups * (end - begin), 8 * parts)), "grp", "shard").sortWithinPartitions("grp", "shard", "kind")
        more = dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
        before, found = found, stored(_first(more if found is None else found.drop("rank").unionByName(more), k), "found")
        if before is not None:
            dropped(before)
        begin, size = end, size * GROWTH
    dropped(trees, queries)
    return found.select("query_id", "rank", "vec_id", "score")
