"""Near-duplicates by Order MinHash, verified by banded alignment.

A text's words (lower-cased, without punctuation at their ends) form k-mers of five words, labelled by how often each has
come before, so that a text written twice differs from the text. For each of ``bands`` hash functions the ``picks``
smallest k-mers are kept in the order in which they stand in the text, and hashed: two texts agree in a band if the same
k-mers come out in the same order, which follows their edit similarity rather than their common vocabulary. An edit breaks
up to five k-mers, so texts of edit similarity 0.8 share about a fifth of theirs and agree in one band of twenty-five: hence
64 bands. Texts of up to SHORT words may share none, and have bands of ``picks`` + 2 single words instead.

Texts with equal words are one class from the start, and only one of each goes on. Those that agree in a band form a
bucket.

1. Each member of a bucket is compared with the bucket's smallest key, its pivot, and links are joined into classes by
   passing the smallest key on and jumping along it. Most buckets are one class then, and done.
2. In an open bucket, all pairs of members of different classes are tested behind profiles (word counts, a sample of word
   pairs), in blocks of LEAF members, whatever the bucket's size; buckets of over WHOLE members or HELD bytes are dealt to tasks
   as pairs of blocks. Most texts that meet by chance have no counterpart in their bucket that lengths and samples allow for:
   that is found with small profiles first (``samples``, 128 bytes a member), and they go no further. Members that go on bring
   their words along, so that the task that finds a pair aligns it and joins its classes there and then; of the open buckets that two texts share, one that is drawn by their keys tests them. ``levels`` above 0 parts groups of over LEAF members by further hashes first, which is faster and loses links.

Rows stay in proportion to members throughout: pairs within a group are never rows, only links are, and of these fewer than
the group has members, as two that links of the group lead to aren't tested again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, dropped, free, small, stored, text_of, tidy

#: Texts of up to SHORT words have bands of single words, longer ones and those nearly as short as that of k-mers. Pairs are tested
#: in blocks of LEAF members; buckets of over WHOLE members part into pairs of blocks in the cluster before a task takes one on.
SHORT, LEAF, WHOLE = 40, 128, 16_384
#: Bytes of members (words and profiles) that a task takes on at once; larger buckets part likewise.
HELD = 48_000_000
#: Profiles: word counts in COUNTS buckets, and the smallest word pair under each of SLOTS hashes. Of texts of over SHORT words
#: that are just similar enough, fewer than AGREE slots agree with probability 0.001; shorter ones are told by their counts.
COUNTS, SLOTS, AGREE = 1024, 64, 16

_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_EDGE = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words; what is punctuation alone is no word."""
    words = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    coded = words.values.cast(pa.large_binary()).dictionary_encode()
    bare = [w.strip(_EDGE) for w in coded.dictionary.to_pylist()]
    each = np.array([xxhash.xxh3_64_intdigest(w) for w in bare], np.uint64) if bare else np.zeros(0, np.uint64)
    real = np.array([bool(w) for w in bare], bool)
    at = coded.indices.to_numpy()
    h, ok, ends = each[at], real[at], words.offsets.to_numpy()
    return [h[a:b][ok[a:b]] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def runs(lists: list, most: int = 60_000):
    """Runs of ``lists`` of about ``most`` items, so that what is worked on at once stays in a CPU's cache."""
    part, n = [], 0
    for x in lists:
        part.append(x)
        n += len(x) + 8
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


def kmers(lists: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-mers of some texts, one text after the other: plain, labelled by occurrence, the place in the text, and where each text's begin. A text of fewer words is one k-mer."""
    n = np.array([len(w) for w in lists], np.int64)
    room = n + k - 1  # each text with k - 1 blanks behind it
    at = np.cumsum(room) - room
    flat = np.zeros(int(room.sum()) + k, np.uint64)
    for a, w in zip(at.tolist(), lists, strict=True):
        flat[a : a + len(w)] = w
    m = np.maximum(n - k + 1, 1)
    starts = np.cumsum(m) - m
    text = np.repeat(np.arange(len(n)), m)
    place = np.arange(len(text)) - starts[text]
    with np.errstate(over="ignore"):
        full = np.zeros(len(flat) - k + 1, np.uint64)
        for i in range(k):
            full = _mix(full * _STEP + flat[i : i + len(full)] + np.uint64(i + 1))
        plain = full[at[text] + place]
        key = plain + _mix(text.astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        s = key[order]
        first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        times = np.empty(len(s), np.uint64)
        times[order] = (np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))).astype(np.uint64)
        return plain, _mix(plain + times * _STEP), place.astype(np.uint64), starts


def order_sketch(lists: list[np.ndarray], k: int, bands: int, picks: int) -> np.ndarray:
    """For each text (rows) one hash for each band, of its smallest labelled k-mers in text order."""
    if not lists:
        return np.zeros((0, bands), np.uint64)
    plain, labelled, place, starts = kmers(lists, k)
    ends = np.append(starts[1:], len(plain))
    out = np.empty((len(lists), bands), np.uint64)
    low = np.uint64((1 << max(24, int((ends - starts).max()).bit_length())) - 1)  # the low bits give way to the place
    with np.errstate(over="ignore"):
        seeds = _mix(np.arange(1, 2 * bands + 1, dtype=np.uint64) * _STEP)
        for b in range(bands):
            h = (labelled ^ seeds[2 * b]) * (seeds[2 * b + 1] | np.uint64(1))
            h &= ~low
            h |= place
            best = []
            for p in range(picks):
                i = starts + (np.minimum.reduceat(h, starts) & low).astype(np.int64)
                best.append(np.where(ends - starts > p, i, -1))
                if p + 1 < picks:
                    h[best[-1][best[-1] >= 0]] = ~np.uint64(0)
            best = np.sort(np.stack(best), axis=0)
            got = np.zeros(len(lists), np.uint64)
            for i, at in enumerate(best):
                got = np.where(at >= 0, _mix(got * _STEP + plain[at] + np.uint64(i)), got)
            out[:, b] = got
    return out


def buckets(lists: list[np.ndarray], least: float, k: int, bands: int, picks: int, fine: int) -> list[np.ndarray]:
    """Each text's buckets: ``bands`` of k-mers, for short texts ``fine`` ones of single words; those about as long as SHORT have both, so that two that may be similar have one kind in common."""
    n = np.array([len(w) for w in lists])
    out: list[list[np.ndarray]] = [[] for _ in lists]
    for chosen, first, how in ((n > least * SHORT, 0, (k, bands, picks)), ((n > 0) & (n <= SHORT), bands, (1, fine, picks + 2))):
        which = np.flatnonzero(chosen).tolist()
        band = _mix(np.arange(first + 1, first + how[1] + 1, dtype=np.uint64))
        at = 0
        for part in runs([lists[i] for i in which]):
            with np.errstate(over="ignore"):
                found = _mix(order_sketch(part, *how) + band).view(np.int64)
            for row in found:
                out[which[at]].append(row)
                at += 1
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def word_counts(lists: list[np.ndarray], size: int = COUNTS) -> np.ndarray:
    """Each text's word counts in ``size`` buckets (a power of 2), 255 at most."""
    return np.stack([np.minimum(np.bincount((w & w.dtype.type(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8) for w in lists])


def pair_slots(lists: list[np.ndarray]) -> np.ndarray:
    """16 bits of each text's smallest word pair under each of SLOTS hashes."""
    return np.concatenate([order_sketch(part, 2, SLOTS, 1).astype(np.uint16) for part in runs(lists)])


def profiles(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`word_counts` and :func:`pair_slots` say of each text."""
    return word_counts(lists), pair_slots(lists)


def samples(lists: list[np.ndarray]) -> np.ndarray:
    """Small profiles of 32-bit words, that allow for whatever :func:`profiles` do: a byte of each slot, and word counts in SLOTS buckets of texts of up to SHORT words."""
    slots = pair_slots([w.astype(np.uint64) for w in lists]).astype(np.uint8)
    return np.hstack([slots, word_counts([w if len(w) <= SHORT else w[:0] for w in lists], SLOTS)])


class Group:
    """Members of a bucket: keys, the classes that they are in, numbers of words, profiles (``rough``: small ones), and for :meth:`links` their words and, unless every pair counts, all open buckets that each is in and this one."""

    def __init__(self, least, keys, classes, n, counts, slots, words=None, own=None, home=None, rough=False):
        self.least, self.keys, self.n, self.counts, self.slots, self.words, self.own, self.home = least, keys, n, counts, slots, words, own, home
        self.of = np.unique(classes, return_inverse=True)[1]
        self.met, self.rough = None, rough

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (a, b) of different classes whose lengths and profiles allow for the similarity. An edit changes at most two counts by one, and only one where it changes the length."""
        ok = self.of[a] != self.of[b]
        if self.met is not None:
            ok &= ~(self.met[a] & self.met[b])
        a, b = a[ok], b[ok]
        short, long = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        ok = short >= long * self.least - 1e-6
        a, b, short, long = a[ok], b[ok], short[ok], long[ok]
        ok = (long <= SHORT) | ((self.slots[a] == self.slots[b]).sum(1) >= AGREE)
        a, b, short, long = a[ok], b[ok], short[ok], long[ok]
        far = np.zeros(len(a), np.int64)
        for at in range(0, len(a), 2048):  # a few MB at a time
            x, y = self.counts[a[at : at + 2048]], self.counts[b[at : at + 2048]]
            far[at : at + 2048] = (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)
        ok = far <= 2 * np.floor((1 - self.least) * long + 1e-9) - (long - short)
        if self.rough:  # of longer texts there are no counts
            ok |= long > SHORT
        return a[ok], b[ok]

    def _all(self, m: np.ndarray):
        m = m[np.argsort(self.n[m], kind="stable")]
        ends = np.searchsorted(self.n[m], self.n[m] / self.least + 1e-6, "right")  # beyond, texts are too long for one another
        for at in range(0, len(m), LEAF):
            rows = np.arange(at, min(at + LEAF, len(m)))
            for col in range(at, int(ends[rows].max()), LEAF):
                cols = np.arange(col, min(col + LEAF, int(ends[rows].max())))
                a, b = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
                yield self.possible(m[a[a < b]], m[b[a < b]])

    def pairs(self, first: int, levels: int = SLOTS):
        """Pairs to verify, in parts. ``first``: the slot by which a large group parts first; all of its pairs are tested once ``levels`` slots are used."""
        todo = [(np.arange(len(self.n)), 0)]
        while todo:
            m, level = todo.pop()
            if len(m) < 2 or (self.of[m] == self.of[m[0]]).all():
                continue
            if len(m) <= LEAF or level >= levels:
                yield from self._all(m)
                continue
            pivot = m[int(_mix(np.uint64([first * 64 + level + 1]))[0] % np.uint64(len(m)))]
            yield self.possible(np.full(len(m), pivot), m)
            slot = self.slots[m, (first + level) % SLOTS]
            order = np.argsort(slot, kind="stable")
            todo += [(m[i], level + 1) for i in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1)]

    def paired(self) -> np.ndarray:
        """Whether each member is in a possible pair; pairs of two of whom that is known aren't tested."""
        self.met = np.zeros(len(self.n), bool)
        for a, b in self._all(np.arange(len(self.n))):
            self.met[a] = self.met[b] = True
        return self.met

    def _here(self, i: int, j: int) -> bool:
        """Whether this is the bucket that tests a pair: any of those that the two share, but the same one wherever they meet."""
        if self.own is None:
            return True
        both = np.intersect1d(self.own[i], self.own[j], assume_unique=True)
        return int(both[(self.keys[i][-1] + self.keys[j][-1]) % len(both)]) == self.home

    def links(self, first: int, levels: int = SLOTS):
        """Similar pairs of different classes, in parts. A link makes its classes one, so there are fewer than members; every similar pair that :meth:`pairs` gives and that is tested here is in one class in the end."""
        for a, b in self.pairs(first, levels):
            found = []
            for i, j in zip(a.tolist(), b.tolist(), strict=True):
                if self.of[i] != self.of[j] and self._here(i, j) and alignment_similarity(self.words[i], self.words[j], self.least) >= self.least:
                    self.of[self.of == self.of[j]] = self.of[i]
                    found.append((i, j))
            if found:
                yield found


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if it is at most ``most``, else ``most`` + 1: bit vectors that hold a band around the diagonal.

    The band reaches ``most`` cells to either side. VP and VN say where a column's cells are one more or one less than those
    above; a row of the band is one bit, and the window moves down by one with every column.
    """
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    lo = 0
    while lo < m and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < m - lo and a[n - 1 - hi] == b[m - 1 - hi]:
        hi += 1
    a, b = a[lo : n - hi], b[lo : m - hi]
    n, m = len(a), len(b)
    if not m or most == 0:
        return min(n, most + 1)
    most = min(most, n - 1) if most >= n else most
    cap = most
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << width - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    vp, vn, dist = full ^ ((1 << width - most - 1) - 1), 0, most
    at, across = most + 1 - width, top >> 1
    give_up = 2 * most + m - n
    for j in range(m):
        x = where.get(b[j], 0)
        x = (x >> at if at >= 0 else x << -at) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j < n - most:
            if not d0 & top:
                dist += 1
            if dist > give_up:
                return cap + 1
        else:
            dist += (1 if hp & across else 0) - (1 if hn & across else 0)
            across >>= 1
        down = d0 >> 1
        vp = (hn | ~(down | hp)) & full
        vn = down & hp
        at += 1
    return dist if dist <= cap else cap + 1


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """1 - distance / length of the longer one if that is at least ``least``, else 0. The band starts narrow and doubles up to what ``least`` allows."""
    n = max(len(a), len(b))
    if not n:
        return 1.0
    most = int((1 - least) * n + 1e-9)
    if abs(len(a) - len(b)) > most:
        return 0.0
    both, counts = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(np.bincount(counts[: len(a)], minlength=len(both)), np.bincount(counts[len(a) :], minlength=len(both))).sum()
    if n - common > most:  # no alignment matches more words than the two have in common
        return 0.0
    x, y = a.tolist(), b.tolist()
    band = max(1, min(most, max(16, n // 16)))
    while True:
        d = banded_distance(x, y, min(band, most))
        if d <= min(band, most):
            return 1 - d / n
        if band >= most:
            return 0.0
        band *= 2


def _sketches(docs: DataFrame, doc_id: str, text: str, least: float, k: int, bands: int, picks: int, fine: int) -> DataFrame:
    names = ["doc_id", "h", "key", "n", "buckets", "words", "sample"]

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                lists = word_hashes(b.column(2).to_pylist())
                own = buckets(lists, least, k, bands, picks, fine)
                ends = np.cumsum([0, *map(len, own)])
                words = [w.astype("<u4") for w in lists]
                yield pa.record_batch(
                    [b.column(0), b.column(1), pa.array([xxhash.xxh3_128_digest(w.tobytes()) for w in lists], pa.binary()), pa.array([len(w) for w in lists], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own))), pa.array([w.tobytes() for w in words], pa.binary()), pa.array([x.tobytes() for x in samples(words)], pa.binary())],
                    names,
                )

    kept = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), text_of(text).alias("text"))
    return kept.mapInArrow(tidy(rows), f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, h long, key binary, n int, buckets array<long>, words binary, sample binary")


def _asked(texts: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``column`` of the texts of the distinct ``keys``, with what else these have; copies of a text fall together before the shuffle."""
    found = texts.select("key", column).join(small(keys.withColumnRenamed("key", "k")), F.col("key") == F.col("k")).drop("k")
    return stored(found.groupBy("key").agg(*[F.first(c).alias(c) for c in found.columns[1:]]), name)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b) of the distinct ``pairs`` (pivot a, member b) that are similar enough.

    Each member carries its words to its pivot, of which there is one: a pivot with very many members is one key of a plain
    join, which adaptive execution splits. Of the texts asked for, only pivots go to the one side and only members to the other.
    """
    ends = pairs.select(F.col("a").alias("key"), F.lit(True).alias("pivot")).union(pairs.select("b", F.lit(False)))
    keys = stored(ends.groupBy("key").agg(F.max("pivot").alias("pivot"), F.max(~F.col("pivot")).alias("member")), "keys")
    asked = _asked(texts, "words", keys, "words")
    members = pairs.join(asked.filter("member"), F.col("b") == F.col("key")).select("a", "b", F.col("words").alias("wb"))
    pivots = asked.filter("pivot").select(F.col("key").alias("p"), F.col("words").alias("wa"))

    def rows(batches):
        for batch in batches:
            ok = [alignment_similarity(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4"), least) >= least for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = members.join(pivots, F.col("a") == F.col("p")).select("a", "b", "wa", "wb")
    found = stored(joined.mapInArrow(tidy(rows), "a binary, b binary"), "links")
    dropped(keys, asked)
    return found


def _likely(open_: DataFrame, counts: DataFrame, texts: DataFrame, least: float, whole: int) -> DataFrame:
    """Members of open buckets that their bucket holds a possible pair for, by lengths and :func:`samples`. ``counts``: the members of each bucket."""

    def rows(batches):
        for bucket, held in _by_bucket(batches, _SAMPLED):
            keys, classes, n, sample, home = held
            small_ones = np.frombuffer(b"".join(sample), np.uint8).reshape(-1, 2 * SLOTS)
            group = Group(least, keys, np.array(classes, object), np.array(n, np.int64), small_ones[:, SLOTS:], small_ones[:, :SLOTS], rough=True)
            at = np.flatnonzero(group.paired()).tolist()
            if at:
                yield pa.record_batch([pa.array([x[i] for i in at], kind) for x, kind in zip((home, keys, classes, n), (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["bucket", "key", "class", "n"])

    large = stored(counts.filter(F.col("c") > whole).select("bucket", "c", F.lit(0).alias("size")), "large")
    n = large.count()
    members = open_.select("bucket", "key", "class", "n", F.col("bucket").alias("home"))
    if n:
        whole_ones, big = (members.join(small(large.select("bucket"), n), "bucket", how) for how in ("left_anti", "left_semi"))
        members = whole_ones.unionByName(_in_blocks(big, large, whole))
    keys = stored(open_.select("key").distinct(), "keys")
    each = _asked(texts, "sample", keys, "samples")
    dealt = members.join(each, "key").select("bucket", *_SAMPLED).repartition("bucket").sortWithinPartitions("bucket", "key")
    found = dealt.mapInArrow(tidy(rows), "bucket long, key binary, class binary, n int")
    found = stored(found.distinct() if n else found, "likely")
    dropped(large, keys, each)
    return found


def _profiled(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members with their texts' words and samples of word pairs, the open buckets of each text (``own``), and the bucket again (``home``), as ``bucket`` may part."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = pair_slots([np.frombuffer(w.as_py(), "<u4").astype(np.uint64) for w in batch.column(1)])
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in slots.astype("<u2")], pa.binary()), *batch.columns[1:]], ["key", "slots", "words", "own"])

    keys = stored(members.groupBy("key").agg(F.sort_array(F.collect_set("bucket")).alias("own")), "keys")  # a few dozen for each
    asked = _asked(texts, "words", keys, "words")
    each = stored(asked.mapInArrow(tidy(rows), "key binary, slots binary, words binary, own array<long>"), "profiles")
    out = stored(members.join(each, "key").withColumn("home", F.col("bucket")), "profiled")
    dropped(keys, asked, each)
    return out


_MEMBER = ("key", "class", "n", "slots", "words", "own", "home")
_SAMPLED = ("key", "class", "n", "sample", "home")


def _by_bucket(batches, names: tuple):
    """Each bucket with its members' columns ``names``, of rows that begin with the bucket and are sorted by it."""
    held: list[list] = []
    last = None
    for batch in batches:
        ids = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(ids)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            if hi == lo:
                continue
            if last != int(ids[lo]):
                if last is not None:
                    yield last, held
                last, held = int(ids[lo]), [[] for _ in names]
            for i, x in enumerate(names):
                values = batch.column(i + 1).slice(lo, hi - lo)
                held[i] += [v.values.to_numpy().copy() for v in values] if x == "own" else values.to_pylist()
    if last is not None:
        yield last, held


def _group(least: float, columns: list, once: bool = False) -> Group:
    keys, classes, n, slots, words, own, home = columns
    words = [np.frombuffer(w, "<u4") for w in words]
    return Group(least, keys, np.array(classes, object), np.array(n, np.int64), word_counts(words), np.frombuffer(b"".join(slots), "<u2").reshape(-1, SLOTS), words, own if once else None, home[0])


def _link_batch(group: Group, links: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [sorted((group.keys[i], group.keys[j])) for i, j in links]
    return pa.record_batch([pa.array([x for x, _ in ends], pa.binary()), pa.array([y for _, y in ends], pa.binary())], ["a", "b"])


def _links_of_buckets(members: DataFrame, least: float, levels: int) -> DataFrame:
    """Links of buckets that one task holds: at most WHOLE members and HELD bytes at a time."""

    def rows(batches):
        for bucket, held in _by_bucket(batches, _MEMBER):
            group = _group(least, held, levels == 0)  # parts of a bucket may not test all of its pairs
            for found in group.links(bucket % SLOTS, levels):
                yield _link_batch(group, found)

    dealt = members.select("bucket", *_MEMBER).repartition("bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(tidy(rows), "a binary, b binary")


def _parted(members: DataFrame, stats: DataFrame, least: float, level: int) -> tuple[DataFrame, DataFrame]:
    """Links of members with their bucket's pivot, and the members in smaller buckets: of those that agree in one slot more."""

    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own, of_pivot = ([batch.column(len(_MEMBER) * side + i).to_pylist() for i in range(len(_MEMBER))] for side in (0, 1))
            group = _group(least, [x + y for x, y in zip(own, of_pivot, strict=True)])
            at = np.arange(batch.num_rows)
            a, b = group.possible(at, at + batch.num_rows)
            found = [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if alignment_similarity(group.words[i], group.words[j], least) >= least]
            if found:
                yield _link_batch(group, found)

    pivots = stats.select("bucket", *[F.col(f"pivot.{x}").alias("p" + x) for x in _MEMBER])
    stars = members.join(small(pivots), "bucket").select(*_MEMBER, *["p" + x for x in _MEMBER]).mapInArrow(tidy(rows), "a binary, b binary")
    slot = F.substring("slots", F.pmod(F.col("first") + F.lit(level), F.lit(SLOTS)).cast("int") * 2 + 1, F.lit(2))
    return stars, members.withColumn("bucket", F.xxhash64("bucket", slot))


def _in_blocks(members: DataFrame, stats: DataFrame, whole: int) -> DataFrame:
    """Buckets that no slot parts, as buckets of about ``whole`` / 2 members or HELD / 2 bytes: one for every two of their blocks."""
    blocks = F.ceil(F.greatest(F.col("c") * 4 / F.lit(whole), F.col("size") * 4 / F.lit(HELD))).cast("int")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    at = members.join(small(stats.select("bucket", blocks.alias("blocks"))), "bucket").withColumn("block", block)
    each = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return each.withColumn("bucket", F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))).drop("blocks", "block", "other")


def _open_links(open_: DataFrame, texts: DataFrame, least: float, whole: int, levels: int) -> DataFrame:
    """Links between members of different classes in one bucket, enough to join the classes that have some."""
    profiled = _profiled(open_, texts)
    live = profiled.withColumn("first", F.pmod("bucket", F.lit(SLOTS)))
    parts = []
    for level in range(levels + 1):
        pivot = F.min(F.struct(F.xxhash64("bucket", "key").alias("o"), *_MEMBER)).alias("pivot")
        size = F.sum(F.col("n").cast("long") * 4 + F.size("own") * 8 + COUNTS + 2 * SLOTS + 500)  # with the objects that hold them
        large = live.groupBy("bucket").agg(F.count("*").alias("c"), size.alias("size"), F.min("class").alias("c0"), F.max("class").alias("c1")).filter(((F.col("c") > whole) | (F.col("size") > HELD)) & (F.col("c0") != F.col("c1")))
        large = stored(large.select("bucket", "c", "size"), "large")
        n = large.count()
        if not n:
            break
        big = live.join(small(large.select("bucket"), n), "bucket", "left_semi")
        parts.append(_links_of_buckets(live.join(small(large.select("bucket"), n), "bucket", "left_anti"), least, levels))
        if level == levels:
            live = _in_blocks(big, large, whole)
            break
        stats = stored(big.groupBy("bucket").agg(pivot), "pivots")
        stars, deeper = _parted(big, stats, least, level)
        parts.append(stars)
        live = stored(deeper, "parted")
    parts.append(_links_of_buckets(live, least, levels))
    links = parts[0]
    for p in parts[1:]:
        links = links.union(p)
    links = stored(links.distinct(), "links")
    dropped(profiled)
    return links


def _roots_of(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the class of their key: the root that links lead to, or the key itself."""
    of = roots.select(F.col("key").alias("k"), "root")
    return members.join(small(of), F.col("key") == F.col("k"), "left").withColumn("class", F.coalesce("root", "key")).drop("k", "root")


def _all_roots(reps: DataFrame, texts: DataFrame, least: float, whole: int, levels: int) -> DataFrame:
    """(key, root) of every text that is linked to another one."""
    all_of = reps.select("key", "n", F.explode("buckets").alias("bucket"))
    shared = stored(all_of.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1").select("bucket"), "buckets")
    members = stored(all_of.join(small(shared, most=BROADCAST_BYTES // 64), "bucket"), "members")
    pivots = members.groupBy("bucket").agg(F.min(F.struct("key", "n")).alias("p"))
    near_in_length = F.least("n", "p.n") >= F.greatest("n", "p.n") * least - 1e-6
    pairs = members.join(pivots, "bucket").filter((F.col("key") != F.col("p.key")) & near_in_length)
    pairs = stored(pairs.select(F.col("p.key").alias("a"), F.col("key").alias("b")).distinct(), "pairs")
    roots = _components(_verified(pairs, texts, least))
    members = stored(_roots_of(members, roots), "members-of-classes")
    still = stored(members.groupBy("bucket").agg(F.count("*").alias("c"), F.min("class").alias("c0"), F.max("class").alias("c1")).filter("c0 != c1").select("bucket", "c"), "open")
    open_ = members.join(small(still.select("bucket"), most=BROADCAST_BYTES // 64), "bucket")
    if levels == 0:
        open_ = _likely(open_, still, texts, least, whole)
    more = _open_links(open_, texts, least, whole, levels)
    ends = _roots_of(_roots_of(more.select("a", F.col("b").alias("key")), roots).select(F.col("class").alias("b"), F.col("a").alias("key")), roots)
    joined = _components(ends.select(F.col("class").alias("a"), "b").filter("a != b"))
    both = _roots_of(roots.select(F.col("root").alias("key"), F.col("key").alias("own")), joined).select(F.col("own").alias("key"), F.col("class").alias("root"))
    new = joined.join(small(roots.select(F.col("key").alias("k"))), F.col("key") == F.col("k"), "left_anti")
    return stored(both.union(new), "roots")


def _components(links: DataFrame) -> DataFrame:
    """(key, root) for every key of a link: the smallest key that links lead to.

    In each round every key hops to its smallest neighbour, and from there once more; links then join what keys have hopped to,
    and those within one drop out, so that each round works on far fewer links than the one before.
    """
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        lower = edges.select(F.col("b").alias("key"), F.col("a").alias("to")).union(edges.select(F.col("a").alias("key"), F.col("a").alias("to")))
        hop = stored(lower.groupBy("key").agg(F.min("to").alias("to")), "hops")
        on = hop.select(F.col("key").alias("at"), F.col("to").alias("root"))
        far = stored(hop.join(on, F.col("to") == F.col("at")).select("key", "root"), "hops")
        a, b = (far.select(F.col("key").alias("of_" + x), F.col("root").alias("r" + x)) for x in "ab")
        ends = edges.join(a, F.col("a") == F.col("of_a")).join(b, F.col("b") == F.col("of_b")).filter("ra != rb")
        fewer = stored(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if roots is None:
            new = far
        else:
            on = far.select(F.col("key").alias("k"), F.col("root").alias("r"))
            new = stored(roots.join(small(on), F.col("root") == F.col("k"), "left").select("key", F.coalesce("r", "root").alias("root")), "roots")
            dropped(roots, far)
        dropped(edges, hop)
        edges, roots = fewer, new
    dropped(edges)
    return roots if roots is not None else links.sparkSession.createDataFrame([], "key binary, root binary")


def classes(docs: DataFrame, least: float = 0.8, k: int = 5, bands: int = 64, picks: int = 2, fine: int = 24, doc_id: str = "doc_id", text: str = "text", whole: int = WHOLE, levels: int = 0) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, kept, and h, the 64-bit hash of the text.

    Texts are near-duplicates if their words' edit similarity, 1 - distance / words of the longer one, is at least ``least``;
    classes are closed under that. class_id is the smallest id in the class, ``kept`` marks the rows with that id (and, for
    rows of one id, the smallest h). Texts without words, null and empty ones among them, are one class. Null ids stay null and
    are kept only if their class has no other. Repeated rows share a class and ``kept``; other columns are ignored, whatever
    their names. An empty table gives none.
    """
    sk = stored(_sketches(docs, doc_id, text, least, k, bands, picks, fine), "sketches", compression="zstd")
    ids = stored(sk.select("doc_id", "h", "key"), "ids")
    real = sk.filter(F.col("n") > 0)
    reps = stored(real.groupBy("key").agg(F.first("buckets").alias("buckets"), F.first("n").alias("n")), "texts")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("rep")
    least_ids = stored(ids.groupBy("key").agg(smallest), "copies")
    roots = _all_roots(reps, real.select("key", "words", "sample"), least, whole, levels)
    dropped(reps, sk)
    linked = stored(roots.join(least_ids, "key"), "linked")
    whole_class = stored(linked.groupBy("root").agg(F.min("rep").alias("best")), "classes")
    of_key = stored(linked.join(whole_class, "root").select(F.col("key").alias("lk"), "best"), "class-of-text")
    table = stored(least_ids.join(of_key, F.col("key") == F.col("lk"), "left").select("key", F.coalesce("best", "rep").alias("rep")), "class-of-each")
    dropped(linked, whole_class, of_key, least_ids, roots)
    out = ids.join(table, "key")
    kept = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h"))
    return out.select("doc_id", F.col("rep.doc_id").alias("class_id"), kept.alias("kept"), "h")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does, with all their columns, whatever these are named.

    Nulls, ties and repeats as in :func:`classes`; of repeated rows that are kept one stays.
    """
    d, h = free(docs, "d"), free(docs, "h")
    found = stored(classes(docs, doc_id=doc_id, text=text, **how).select(F.col("doc_id").alias(d), F.col("h").alias(h), "kept"), "near-duplicates")
    stay = found.filter("kept").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce(F.col(d).cast("string"), F.lit("")), F.col(d).isNull(), F.col(h)).alias("u")).first()
    gone = found.filter(~F.col("kept")).drop("kept")
    out = docs.join(small(gone), F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text_of(text)) == F.col(h)), "left_anti")
    return out if stay.n == stay.u else out.withColumn(h, F.xxhash64(text_of(text))).dropDuplicates([doc_id, h]).drop(h)
