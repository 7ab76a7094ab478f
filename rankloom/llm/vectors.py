"""What the two vector searches share: whole-number vectors, exact inner products, and the best candidates of many queries at once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Inner products below this are exact in floating point, whatever the order of the sum.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Candidates that wait to be merged.
PENDING = 1 << 20


def whole(vector: Column, scale: int) -> Column:
    """floor(``scale`` * x) of each component as a double, within a long; null for a vector that is null or holds a null, NaN or infinity."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * float(scale)).cast("double"))
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, x)


def matrix(column, n: int) -> np.ndarray:
    """An Arrow column of ``n`` lists of one length as rows; without copying if it can."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, len(flat) // n if n else 0)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def inner(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b`` as whole numbers; ``most`` bounds the product of their norms.

    Beyond what floating point holds exactly they are taken in Python's integers; those that no long can hold are its end.
    """
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    ints = lambda m: [[int(v) for v in row] for row in m]
    rows, cols = ints(a), ints(b)
    return np.array([[min(MOST, max(LEAST, sum(p * q for p, q in zip(r, c, strict=True)))) for c in cols] for r in rows], np.int64).reshape(len(rows), len(cols))


class Best:
    """The ``k`` best (score, id) of each of ``n`` queries, higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.n = k, n
        self.query, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        #: A candidate of a lower score can't count: the kth score so far, or what is known from elsewhere.
        self.floor = np.full(n, LEAST, np.int64) if floor is None else floor.astype(np.int64).copy()
        #: Of candidates at the floor itself those of a larger id can't count either.
        self.last = np.full(n, MOST, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, keep: np.ndarray | None = None) -> None:
        """Candidates ``ids`` with ``scores`` (queries ``rows`` by candidates); ``keep`` says which count at all."""
        floor = self.floor[rows][:, None]
        good = (scores > floor) | ((scores == floor) & (ids[None, :] <= self.last[rows][:, None]))
        if keep is not None:
            good &= keep
        r, c = np.nonzero(good)
        if len(r):
            self.pending.append((rows[r], scores[r, c], ids[c]))
            self.waiting += len(r)
            if self.waiting > PENDING:
                self.settle()

    def settle(self) -> None:
        """Merge what was offered and raise the floors."""
        if not self.pending:
            return
        q, s, i = (np.concatenate([old, *new]) for old, new in zip((self.query, self.score, self.id), zip(*self.pending, strict=True), strict=True))
        self.pending, self.waiting = [], 0
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, and has no overflow
        q, s, i = q[order], s[order], i[order]
        begin = np.searchsorted(q, np.arange(self.n))
        rank = np.arange(len(q)) - begin[q]
        first = rank < self.k
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[q[last]], self.last[q[last]] = s[last], i[last]
        self.query, self.score, self.id = q[first], s[first], i[first]


def one_of_each_id(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Of rows that share an id the one of the least ``value``."""
    return rows.groupBy(key).agg(F.min(value).alias(value))
