"""Hard negatives by inner product, searched over one-dimensional distance keys.

Every vector x gets one more component, sqrt(M^2 - |x|^2), with M the largest norm, so that |q - x|^2 = |q|^2 + M^2 - 2 q.x for a
query q with 0 there: the highest inner products are the nearest neighbours. Each row belongs to its nearest pivot, and the index holds the rows
sorted by (pivot, distance) in blocks, with the least and largest distance of each. A row at distance d from its pivot is at least
|d - |q - pivot|| from q. So a search of radius r reads the blocks whose distances meet the key interval |q - pivot| +- r of each
pivot; it goes on with the annuli of a larger radius until the bound on all rows that are left, (|q|^2 + M^2 - r^2) / 2,
certifies the kth result. The radius grows with a histogram of the keys, and never past what the kth result so far asks for.

Anchors search for positives first, then for negatives, all wants of an anchor in one scan. They go in groups of neighbours (sorted
by their own keys); a task has a group and streams blocks, and what it has found lets later blocks offer less. Pivots are fitted on
``SAMPLE`` rows, the first by a hash of their id; they change only how much is read. Every row is indexed, none is skipped unproved.

Defined results: rows without an id or label, or whose vector is null or holds null, NaN or infinite components, take no part.
Rows meet only rows of vectors of their length. Rows of an anchor's own id are neither its positives nor its negatives; where other ids repeat,
each row counts; of a repeated anchor the least (label, vector) asks. Scores are exact; those beyond a long are its end. Ties go
to the smaller id. Other columns aren't read. No rows or no anchors give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import dropped, numbered, parts_of, small, stored, tidy
from .top_k import _runs
from .vectors import LEAST, MOST, Best, inner, matrix, norms, one_of_each_id, whole

SAMPLE = 4_096
PIVOTS = 16
BLOCK = 2_048
GROUP = 2_048
#: Rows that the first radius reaches, about, and by how much the next ones reach more.
REACH, GROWTH = 4_096, 16
BINS = 256

BLOCKS = "block long, pivot int, lo double, hi double, n int, ids binary, labels binary, vecs binary"
STATE = "id long, label long, vec array<double>, dist array<double>, near int, dnear double, room double"


def fit_pivots(vecs: np.ndarray, extra: np.ndarray, k: int = PIVOTS, steps: int = 8) -> np.ndarray:
    """Means of ``k`` clusters of a sample: far points first, then Lloyd's steps; the last column is the added component."""
    x = np.column_stack([vecs, extra])
    at = [int(np.argmax(norms(x - x.mean(0))))]
    away = norms(x - x[at[0]])
    while len(at) < min(k, len(x)) and away.max() > 0:
        at.append(int(away.argmax()))
        away = np.minimum(away, norms(x - x[at[-1]]))
    p = x[at]
    for _ in range(steps):
        own = np.argmin((p * p).sum(1) - 2 * x @ p.T, axis=1)
        p = np.array([x[own == j].mean(0) if (own == j).any() else p[j] for j in range(len(p))])
    return p


class Pivots:
    """Pivots by length of vector, numbered on; a length that the sample lacks has one at the origin, of number -1 - length."""

    def __init__(self, largest: float, by_dim: dict[int, np.ndarray]):
        self.largest, self.by_dim, self.first, n = largest, by_dim, {}, 0
        for d, p in sorted(by_dim.items()):
            self.first[d], n = n, n + len(p)
        #: For rounding: distances this much apart may be equal.
        self.slack = 1e-6 * (1 + largest)

    def of(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """The pivots of a length and their numbers."""
        p = self.by_dim.get(dim)
        if p is None:
            return np.zeros((1, dim + 1)), np.array([-1 - dim])
        return p, self.first[dim] + np.arange(len(p))

    def distances(self, vecs: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, numbers = self.of(vecs.shape[1])
        x = np.column_stack([vecs, extra])
        return np.column_stack([norms(x - c) for c in p]), numbers


def _by_length(column):
    dims = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(dims):
        yield int(d), np.flatnonzero(dims == d)


def _keyed(pivots: Pivots, anchors: bool):
    """(id, label, vec) with the keys: of rows (near, dnear), of anchors the distances from all pivots too, and |q|^2 + M^2."""

    def run(batches):
        for b in batches:
            for _, at in _by_length(b.column(2)):
                part = b.take(pa.array(at))
                vecs = matrix(part.column(2), len(part))
                square = np.einsum("ij,ij->i", vecs, vecs)
                extra = np.zeros(len(vecs)) if anchors else np.sqrt(np.maximum(0, pivots.largest**2 - square))
                dist, numbers = pivots.distances(vecs, extra)
                near = dist.argmin(1)
                cols = {"id": part.column(0), "label": part.column(1), "vec": part.column(2)}
                if anchors:
                    cols["dist"] = pa.array(list(dist), pa.list_(pa.float64()))
                cols |= {"near": pa.array(numbers[near], pa.int32()), "dnear": pa.array(dist[np.arange(len(dist)), near])}
                if anchors:
                    cols["room"] = pa.array(square + pivots.largest**2)
                yield pa.RecordBatch.from_pydict(cols)

    return tidy(run)


def _pack(size: int):
    """Rows in the order of (pivot, distance) as blocks of at most ``size``."""
    schema = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vecs")]])

    def run(batches):
        from pyspark import TaskContext

        seq, held, n, pivot = TaskContext.get().partitionId() << 32, [], 0, None

        def block():
            nonlocal seq, held, n
            ids, labels, vecs, d = (np.concatenate(x) for x in zip(*held, strict=True))
            row = {"block": seq, "pivot": pivot, "lo": d[0], "hi": d[-1], "n": n, "ids": ids.astype("<i8").tobytes(), "labels": labels.astype("<i8").tobytes(), "vecs": vecs.astype("<f8").tobytes()}
            seq, held, n = seq + 1, [], 0
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for b in batches:
            for at, length in _runs(b.column(3)):
                part = b.slice(at, length)
                if part.column(3)[0].as_py() != pivot:
                    if n:
                        yield block()
                    pivot = part.column(3)[0].as_py()
                while len(part):
                    some = part.slice(0, size - n)
                    part = part.slice(len(some))
                    held.append((some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_numpy(zero_copy_only=False), matrix(some.column(2), len(some)), some.column(4).to_numpy(zero_copy_only=False)))
                    n += len(some)
                    if n == size:
                        yield block()
        if n:
            yield block()

    return tidy(run)


class Index:
    """The stored blocks, the pivots, and counts of rows by (pivot, bin of distance)."""

    def __init__(self, rows: DataFrame, block: int = BLOCK, pivots: int = PIVOTS, sample: int = SAMPLE):
        large = rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))).first()[0]
        few = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        largest, by_dim = float(np.sqrt(large or 0.0)), {}
        for r in few:
            by_dim.setdefault(len(r.vec), []).append(r.vec)
        for d, vecs in by_dim.items():
            x = np.array(vecs, float).reshape(len(vecs), d)
            by_dim[d] = fit_pivots(x, np.sqrt(np.maximum(0, largest**2 - np.einsum("ij,ij->i", x, x))), pivots)
        self.pivots = Pivots(largest, by_dim)
        keyed = rows.select("id", "label", "vec").mapInArrow(_keyed(self.pivots, False), "id long, label long, vec array<double>, near int, dnear double")
        ordered = keyed.repartitionByRange(parts_of(rows), "near", "dnear", "id").sortWithinPartitions("near", "dnear", "id")
        self.table = stored(ordered.mapInArrow(_pack(block), BLOCKS), "keys")
        self.width = max(2 * largest / BINS, 1e-9)
        mid = F.least(F.floor((F.col("lo") + F.col("hi")) / 2 / self.width), F.lit(BINS - 1)).cast("int")
        counts = self.table.filter("pivot >= 0").groupBy("pivot", mid.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("blocks")).collect()
        total = self.table.agg(F.count("*")).first()[0]
        self.blocks, self.bins = total, {}
        for r in counts:  # at most PIVOTS * BINS for each length of the sample
            self.bins.setdefault(r.pivot, np.zeros(BINS))[r.bin] += r.n

    def __getstate__(self) -> dict:
        """Tasks get all but the table."""
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    def reach(self, dist: np.ndarray, dim: int, rows: float) -> float:
        """A radius whose key intervals hold about so many rows; that of everything if there are fewer."""
        _, numbers = self.pivots.of(dim)
        gaps, counts = [], []
        mids = (np.arange(BINS) + 0.5) * self.width
        for d, p in zip(dist, numbers, strict=True):
            if p in self.bins:
                gaps.append(np.abs(mids - d))
                counts.append(self.bins[p])
        if not gaps:
            return 4 * self.pivots.largest + 1
        gap, count = np.concatenate(gaps), np.concatenate(counts)
        order = np.argsort(gap, kind="stable")
        at = np.searchsorted(np.cumsum(count[order]), rows)
        return float(gap[order[at]]) + self.width if at < len(order) else 4 * self.pivots.largest + 1


def _radius(index: Index, first: bool):
    """(state..., caps, lows, floors, r0, r1): set the next radius of each anchor and leave out those whose wants are all certified."""

    def run(batches):
        pivots, reach = index.pivots, index.reach
        for b in batches:
            keep, r0, r1 = [], [], []
            for i, r in enumerate(b.select(["vec", "dist", "room", "caps", "lows", "floors", "r1"]).to_pylist()):
                far = lambda score, room=r["room"]: float(np.sqrt(max(0.0, room - 2.0 * score))) * (1 + 1e-9) + pivots.slack
                need = max((far(max(low, floor)) for cap, low, floor in zip(r["caps"], r["lows"], r["floors"], strict=True) if low <= cap), default=-1.0)
                need = min(need, 4 * pivots.largest + 1)  # beyond, nothing is left
                if need <= r["r1"]:
                    continue
                dist, dim = np.array(r["dist"]), len(r["vec"])
                if first:
                    begin = max((far(cap) for cap in r["caps"] if cap != MOST), default=0.0)
                    reached = max(begin, reach(dist, dim, REACH))
                else:
                    _, numbers = pivots.of(dim)
                    mids = (np.arange(BINS) + 0.5) * index.width
                    had = sum(float(index.bins[p][np.abs(mids - d) <= r["r1"]].sum()) for d, p in zip(dist, numbers, strict=True) if p in index.bins)
                    reached = max(reach(dist, dim, GROWTH * max(had, REACH)), 1.05 * r["r1"] + pivots.slack)
                keep.append(i)
                r0.append(r["r1"])
                r1.append(min(need, reached))
            out = b.take(pa.array(keep, pa.int64()))
            out = out.set_column(b.schema.get_field_index("r0"), "r0", pa.array(r0, pa.float64()))
            yield out.set_column(b.schema.get_field_index("r1"), "r1", pa.array(r1, pa.float64()))

    return tidy(run)


def _spans(pivots: Pivots):
    """(grp, vec, dist, r1) to (grp, pivot, from, to): the key intervals of a group, joined over its anchors in the batch."""
    schema = pa.schema([("grp", pa.int32()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])

    def run(batches):
        for b in batches:
            spans: dict = {}
            grp, r1 = b.column(0).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            for dim, at in _by_length(b.column(1)):
                _, numbers = pivots.of(dim)
                dist = matrix(b.column(2).take(pa.array(at)), len(at))
                for g in np.unique(grp[at]):
                    mine = grp[at] == g
                    low, high = (dist[mine] - r1[at][mine, None]).min(0), (dist[mine] + r1[at][mine, None]).max(0)
                    for p, x, y in zip(numbers.tolist(), low.tolist(), high.tolist(), strict=True):
                        had = spans.get((int(g), p), (x, y))
                        spans[int(g), p] = min(x, had[0]), max(y, had[1])
            yield pa.RecordBatch.from_pylist([{"grp": g, "pivot": p, "low": x, "high": y} for (g, p), (x, y) in spans.items()], schema=schema)

    return tidy(run)


def _scan(pivots: Pivots, k: int, same: bool):
    """Anchors (kind 0) of a group before blocks (kind 1): the best ``k`` rows of each want in the blocks that the anchors' annuli meet."""
    wanted = pa.schema([("id", pa.int64()), ("want", pa.int32()), ("row_id", pa.int64()), ("score", pa.int64())])

    class Anchors:
        def __init__(self, part):
            get = lambda c: part.column(part.schema.get_field_index(c))
            self.ids, self.labels, self.r0, self.r1 = (get(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "r0", "r1"))
            self.vecs, self.dist = matrix(get("vec"), len(part)), matrix(get("dist"), len(part))
            caps, lows, floors = (get(c).to_pylist() for c in ("caps", "lows", "floors"))
            self.of = np.repeat(np.arange(len(part)), [len(c) for c in caps])
            self.want = np.concatenate([np.arange(len(c)) for c in caps]).astype(np.int32)
            self.caps = np.array([x for c in caps for x in c], np.int64)
            self.best = Best(len(self.of), k, np.maximum(np.array([x for c in lows for x in c], np.int64), np.array([x for c in floors for x in c], np.int64)))
            self.numbers = {p: i for i, p in enumerate(pivots.of(self.vecs.shape[1])[1].tolist())}
            self.large = norms(self.vecs).max(initial=0)

        def read(self, row: dict) -> None:
            at = self.numbers.get(row["pivot"])
            if at is None:
                return
            gap = np.maximum(0, np.maximum(self.dist[:, at] - row["hi"], row["lo"] - self.dist[:, at]))
            now = np.flatnonzero((gap <= self.r1) & (gap > self.r0))
            if not len(now):
                return
            ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
            vecs = np.frombuffer(row["vecs"], "<f8").reshape(len(ids), self.vecs.shape[1])
            scores = inner(self.vecs[now], vecs, float(self.large * norms(vecs).max(initial=0)))
            fits = ((labels[None, :] == self.labels[now][:, None]) == same) & (ids[None, :] != self.ids[now][:, None])
            place = np.full(len(self.ids), -1)
            place[now] = np.arange(len(now))
            wants = np.flatnonzero(place[self.of] >= 0)
            for part in np.array_split(wants, -(-len(wants) // GROUP)):
                its = place[self.of[part]]
                self.best.offer(part, scores[its], ids, fits[its] & (scores[its] <= self.caps[part][:, None]))
            self.best.settle()

        def found(self):
            b = self.best
            return pa.RecordBatch.from_arrays([pa.array(self.ids[self.of[b.query]]), pa.array(self.want[b.query]), pa.array(b.id), pa.array(b.score)], schema=wanted)

    def run(batches):
        now, parts, sets = None, [], None
        for batch in batches:
            for at in _runs(*(batch.column(c) for c in range(3))):
                b = batch.slice(*at)
                key = (b.column(0)[0].as_py(), b.column(1)[0].as_py())
                if key != now:
                    yield from (s.found() for s in sets or ())
                    now, parts, sets = key, [], None
                if b.column(2)[0].as_py() == 0:
                    parts.append(b)
                    continue
                if sets is None:
                    whole_group = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
                    sets = [Anchors(g.take(pa.array(i))) for g in whole_group for _, i in _by_length(g.column(g.schema.get_field_index("vec")))]
                for row in b.select(["pivot", "lo", "hi", "ids", "labels", "vecs"]).to_pylist():
                    for s in sets:
                        s.read(row)
        yield from (s.found() for s in sets or ())

    return tidy(run)


def search(anchors: DataFrame, index: Index, k: int, same: bool) -> DataFrame:
    """(id, want, rank, row_id, score): for each want (caps[i], lows[i]) of an anchor the ``k`` best rows of the same or another label."""
    spark = anchors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = int(anchors.agg(F.coalesce(F.max("grp"), F.lit(-1))).first()[0]) + 1
    slices = max(1, -(-parts // max(1, groups)), -(-index.blocks // 256))
    fields = ["id", "label", "vec", "dist", "room", "grp", "caps", "lows", "floors", "r0", "r1"]
    begun = anchors.withColumns({"floors": F.transform("caps", lambda _: F.lit(LEAST)), "r0": F.lit(-1.0), "r1": F.lit(-1.0)}).select(*fields)
    state = stored(begun.mapInArrow(_radius(index, True), begun.schema), "radii")
    found, w = None, W.partitionBy("id", "want").orderBy(F.desc("score"), "row_id")
    while state.count():
        spans = state.select("grp", "vec", "dist", "r1").mapInArrow(_spans(index.pivots), "grp int, pivot int, low double, high double")
        spans = spans.groupBy("grp", "pivot").agg((F.min("low") - index.pivots.slack).alias("low"), (F.max("high") + index.pivots.slack).alias("high"))
        met = index.table.join(small(spans, groups * PIVOTS), "pivot").filter((F.col("hi") >= F.col("low")) & (F.col("lo") <= F.col("high")))
        none = {c: F.lit(None).cast(t) for c, t in (("id", "long"), ("label", "long"), ("vec", "array<double>"), ("dist", "array<double>"), ("r0", "double"), ("r1", "double"), ("caps", "array<long>"), ("lows", "array<long>"), ("floors", "array<long>"))}
        empty = {c: F.lit(None).cast(t) for c, t in (("pivot", "int"), ("lo", "double"), ("hi", "double"), ("ids", "binary"), ("labels", "binary"), ("vecs", "binary"))}
        left = state.select("grp", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), *none, *[e.alias(c) for c, e in empty.items()])
        right = met.select("grp", F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), *[e.alias(c) for c, e in none.items()], *empty)
        dealt = left.unionByName(right).repartition(max(parts, min(groups * slices, 8 * parts)), "grp", "slice").sortWithinPartitions("grp", "slice", "kind")
        more = dealt.mapInArrow(_scan(index.pivots, k, same), "id long, want int, row_id long, score long")
        ranked = (more if found is None else found.drop("rank").unionByName(more)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        before, found = (found, state), stored(ranked, "near")
        kth = found.filter(F.col("rank") == k).groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("kth"))
        floors = F.transform("caps", lambda _, i: F.coalesce(F.try_element_at("kth", i), F.lit(LEAST)))
        asked = state.join(kth, F.col("id") == F.col("of"), "left").withColumn("floors", floors).select(*fields)
        state = stored(asked.mapInArrow(_radius(index, False), begun.schema), "radii")
        dropped(*[x for x in before if x is not None])
    dropped(state)
    return found if found is not None else spark.createDataFrame([], "id long, want int, row_id long, score long, rank int")


def hard_negatives(table: DataFrame, is_anchor: Column, label: Column, scale: int = 256, positives: int = 5, negatives: int = 3, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the ids that ``is_anchor`` picks.

    An anchor's positives are its ``positives`` best rows of its label; for each the ``negatives`` best of another label are returned whose
    score is from half of the positive's to 95 % of it.
    """
    rows = table.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), whole(F.col(vector), scale).alias("vec"), is_anchor.alias("asks")).filter("label is not null and vec is not null")
    index = Index(rows, block, pivots)
    one = one_of_each_id(rows.filter("asks").select("id", F.struct("label", "vec").alias("x")), "id", "x").select("id", "x.label", "x.vec")
    anchors, n = numbered(one.mapInArrow(_keyed(index.pivots, True), STATE), ["near", "dnear", "id"], "place", "anchors")
    anchors = anchors.withColumn("grp", F.floor(F.col("place") / group).cast("int")).drop("place")
    same = search(anchors.withColumns({"caps": F.array(F.lit(MOST)), "lows": F.array(F.lit(LEAST))}), index, positives, True)
    score = F.col("score")
    cap = score - F.expr("score div 20") - (score % 20 > 0).cast("long")
    low = score - F.expr("score div 2")
    each = same.select("id", F.col("rank").alias("nth"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score"), F.when(score >= 0, cap).otherwise(LEAST).alias("cap"), F.when(score >= 0, low).otherwise(MOST).alias("low"))
    wants = each.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("nth", "cap", "low"))).alias("wants"))
    asked = anchors.join(wants, "id").withColumns({"caps": F.col("wants.cap"), "lows": F.col("wants.low")})
    other = search(asked, index, negatives, False)
    out = other.withColumn("nth", F.col("want") + 1).join(each, ["id", "nth"])
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
