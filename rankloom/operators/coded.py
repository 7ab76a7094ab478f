"""Many comparisons of the same rows at once: a row's classes are one number, its code, and each feature's values meet once for all comparisons.

A row for each comparison, fold or task would multiply the rows before they are shuffled. Here a task counts its rows by value and code, and hands on one
row of arrays for each feature and range of values; whatever comparisons want follows from the sums of ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch

#: Rows that a task counts at once, rows that a range should have at most, and ranges of a feature.
CHUNK, ROWS, RANGES = 1 << 18, 250_000, 1024
_PACKED = "feature int, _range int, values array<double>, codes array<int>, n array<bigint>"


def value_cuts(wide: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Where each feature is cut into ranges of about equal size, by a sketch: at most RANGES numbers for each. A value is in one range only; where the cuts are changes no result."""
    rows = wide.agg(F.count("*")).first()[0]
    ranges = max(min(256, max(4, int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions")))), min(RANGES, -(-rows // ROWS)))
    v = lambda f: F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double"))
    found = wide.agg(*[F.percentile_approx(v(f), [i / ranges for i in range(1, ranges)], 20 * ranges) for f in features]).first()
    return [np.unique(np.array(x or [], float)) for x in found]


def _met(values: np.ndarray, codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (value, code) in order of the value, with their rows."""
    if not len(values):
        return values, codes, np.zeros(0, np.int64)
    order = np.lexsort((codes, values))
    values, codes = values[order], codes[order]
    first = np.flatnonzero(np.concatenate([[True], (values[1:] != values[:-1]) | (codes[1:] != codes[:-1])]))
    n = np.diff(np.append(first, len(values))) if n is None else np.add.reduceat(n[order], first)
    return values[first], codes[first], n.astype(np.int64)


def _lists(ends: np.ndarray, *flat: tuple) -> list:
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind)) for x, kind in flat]


def _flat(t: pa.Table, name: str) -> np.ndarray:
    return t[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def counted(wide: DataFrame, features: list[str], code: str, cuts: list[np.ndarray]) -> DataFrame:
    """(feature by its place, _range, values, codes, n): for each run of a task's rows and each range, its distinct (value, code) with their rows. Missing values and NaN take no part."""

    def rows(batches):
        def done(held):
            codes = np.concatenate([b.column(0).to_numpy() for b in held])
            for i in range(len(features)):
                v = np.concatenate([b.column(i + 1).to_numpy(zero_copy_only=False) for b in held])  # null is NaN
                ok = ~np.isnan(v)
                values, c, n = _met(v[ok], codes[ok])
                ends = np.concatenate([[0], np.searchsorted(values, cuts[i], "right"), [len(values)]])
                some = np.flatnonzero(np.diff(ends))
                if len(some):
                    at = np.append(ends[some], len(values))
                    names = ["feature", "_range", "values", "codes", "n"]
                    yield pa.record_batch([pa.array([i] * len(some), pa.int32()), pa.array(some, pa.int32()), *_lists(at, (values, pa.float64()), (c, pa.int32()), (n, pa.int64()))], names)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= CHUNK:
                yield from done(held)
                held, size = [], 0
        if size:
            yield from done(held)

    return wide.select(F.col(code).cast("int"), *[F.col(f"`{f}`").cast("double") for f in features]).mapInArrow(rows, _PACKED)


def _fold_sums(tasks: int, n: int):
    """From a range's counts, for each task: rows, positives, means and squared deviations of each fold, and a[f][g] as :func:`scoring._range_sums` has it."""

    def sums(key, t):
        values, codes, rows = _met(_flat(t, "values"), _flat(t, "codes"), _flat(t, "n"))
        distinct, at = np.unique(values, return_inverse=True)
        out = []
        for k in range(tasks):
            own = codes // (2 * n + 1) ** k % (2 * n + 1)
            m = np.bincount(at * (2 * n + 1) + own, rows, len(distinct) * (2 * n + 1)).reshape(-1, 2 * n + 1)[:, : 2 * n]
            p = m[:, 1::2]
            c = m[:, ::2] + p
            total = c.sum(0)
            mean = np.divide((np.where(c > 0, distinct[:, None], 0) * c).sum(0), total, out=np.zeros(n), where=total > 0)
            out.append([total, p.sum(0), mean, (np.where(c > 0, distinct[:, None] - mean, 0) ** 2 * c).sum(0), (p.T @ (c.cumsum(0) - c / 2)).ravel()])
        arrays = [pa.array([k.as_py()] * tasks, pa.int32()) for k in key] + [pa.array(range(tasks), pa.int32())]
        return pa.table(arrays + [pa.array([x[i].tolist() for x in out], pa.list_(pa.float64())) for i in range(5)], ["feature", "_range", "task", "c", "p", "m", "q", "a"])

    return sums


def _fold_models(tasks: list[str], features: list[str], n: int, models: list[int]):
    """From a task's and feature's ranges, at most RANGES rows, (task, model, feature, delta, mu, sd)."""

    def params(key, t):
        t = t.sort_by("_range")
        get = lambda x, *shape: np.array(t[x].to_pylist()).reshape(t.num_rows, *shape)
        c, p, m, q, a = get("c", n), get("p", n), get("m", n), get("q", n), get("a", n, n)
        a = a.sum(0) + p.T @ (c.cumsum(0) - c)
        out = []
        for model in models:
            k = [f for f in range(n) if f != model]
            n1, rows = p[:, k].sum(), c[:, k].sum()
            if not rows:
                continue
            n2 = rows - n1
            u = a[np.ix_(k, k)].sum() + n1 / 2 - n1 * (n1 + 1) / 2
            mu = (c[:, k] * m[:, k]).sum() / rows
            sd = np.sqrt((q[:, k] + c[:, k] * (m[:, k] - mu) ** 2).sum() / (rows - 1)) if rows > 1 else 0.0
            out.append((tasks[key[0].as_py()], model, features[key[1].as_py()], 2 * u / (n1 * n2) - 1 if n1 and n2 else 0.0, mu, sd if sd >= 1e-9 else 1.0))
        kinds = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64())
        return pa.table([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["task", "model", "feature", "delta", "mu", "sd"])

    return params


def fold_params(wide: DataFrame, features: list[str], tasks: dict[str, tuple[str, str]], n: int = 5, full: int = -1) -> DataFrame:
    """(task, model, feature, delta, mu, sd) as :func:`scoring.fold_params` has them, from one row for each report: ``tasks`` names the columns (y, fold) of each.

    ``wide`` is a written table. A row counts for a task where its fold is from 0 to n - 1; a missing y is negative.
    """
    if (2 * n + 1) ** len(tasks) >= 1 << 31:
        raise ValueError("too many tasks for one code")
    code, base = F.lit(0), 1
    for y, fold in tasks.values():
        known = F.col(fold).between(0, n - 1)
        own = F.when(known, F.col(fold) * 2 + F.coalesce(F.col(y) == 1, F.lit(False)).cast("int")).otherwise(2 * n)
        code, base = code + own * F.lit(base), base * (2 * n + 1)
    d = wide.withColumn("_code", code)
    each = counted(d, features, "_code", value_cuts(wide, features))
    ranges = each.groupBy("feature", "_range").applyInArrow(_fold_sums(len(tasks), n), f"feature int, _range int, task int, {', '.join(f'{x} array<double>' for x in 'cpmqa')}")
    return ranges.groupBy("task", "feature").applyInArrow(_fold_models(list(tasks), features, n, [full, *range(n)]), "task string, model int, feature string, delta double, mu double, sd double")


def _side_sums(sides: np.ndarray):
    """From a range's counts, for each comparison: rows and sums of both sides, the first's sum of average ranks within the range, and the ties."""

    def sums(key, t):
        distinct, at = np.unique(_flat(t, "values"), return_inverse=True)
        codes, rows = _flat(t, "codes"), _flat(t, "n")
        out = []
        for k, side in enumerate(sides):
            c1, c2 = (np.bincount(at, rows * (side[codes] == s), len(distinct)) for s in (1, 0))
            c = c1 + c2
            out.append((key[0].as_py(), key[1].as_py(), k, c1.sum(), c2.sum(), np.dot(c1, np.where(c1 > 0, distinct, 0)), np.dot(c2, np.where(c2 > 0, distinct, 0)), (c1 * (c.cumsum() - c + (c + 1) / 2)).sum(), (c * c * c - c).sum()))
        return pa.table([pa.array([r[i] for r in out], pa.int32() if i < 3 else pa.float64()) for i in range(9)], ["feature", "_range", "by", "n1", "n2", "s1", "s2", "r", "t"])

    return sums


def _merged(key, t):
    values, codes, n = _met(_flat(t, "values"), _flat(t, "codes"), _flat(t, "n"))
    ends = np.array([0, len(values)])
    return pa.table([*[pa.array([k.as_py()], pa.int32()) for k in key], *_lists(ends, (values, pa.float64()), (codes, pa.int32()), (n, pa.int64()))], ["feature", "_range", "values", "codes", "n"])


def _at_places(sides: np.ndarray, wanted: dict):
    """The values at places (from 0) of one side's values in a range: wanted[feature, range] is a list of (comparison, side, place)."""

    def rows(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                key = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                values, codes, n = (b.column(c)[i].values.to_numpy() for c in (2, 3, 4))
                for k, s, place in wanted.get(key, ()):
                    below = np.cumsum(n * (sides[k][codes] == s))
                    out.append((key[0], k, s, place, key[1], values[np.searchsorted(below, place, "right")]))
            yield pa.record_batch([pa.array([r[i] for r in out], pa.float64() if i == 5 else pa.int64()) for i in range(6)], ["feature", "by", "side", "place", "_range", "value"])

    return rows


def two_groups(wide: DataFrame, features: list[str], code: str, sides: dict[str, list[int | None]], by: str) -> DataFrame:
    """What :func:`stats.two_groups` says of each comparison and feature, as (by, feature, ...), from one row for each report.

    ``sides`` says of each comparison on which side rows of a code are: 1 for the first, 0 for the other, None where they take no part. ``wide`` is a written table.
    Sums of ranges reach the driver, which cuts bound: a row for each comparison, feature and range; medians are then looked up in the ranges that hold them.
    Comparisons of no rows have no row.
    """
    spark, names = wide.sparkSession, list(sides)
    table = np.array([[-1 if s is None else s for s in row] for row in sides.values()], np.int8)
    each = counted(wide, features, code, value_cuts(wide, features)).groupBy("feature", "_range").applyInArrow(_merged, _PACKED)
    each = scratch.stored(each, "ranges")
    sums = each.groupBy("feature", "_range").applyInArrow(_side_sums(table), "feature int, _range int, by int, n1 double, n2 double, s1 double, s2 double, r double, t double")
    got = sums.toArrow().sort_by([("by", "ascending"), ("feature", "ascending"), ("_range", "ascending")])
    col = {c: got[c].to_numpy() for c in got.column_names}
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(col["by"]) != 0) | (np.diff(col["feature"]) != 0)])) if got.num_rows else []
    stats, wanted = [], {}
    for part in np.split(np.arange(got.num_rows), starts[1:]) if got.num_rows else []:
        k, f = int(col["by"][part[0]]), int(col["feature"][part[0]])
        n1, n2, s1, s2, r, t = (col[c][part] for c in ("n1", "n2", "s1", "s2", "r", "t"))
        if not (n1.sum() or n2.sum()):
            continue
        rank = float((r + n1 * ((n1 + n2).cumsum() - n1 - n2)).sum())
        places = []
        for s, n in ((1, n1), (0, n2)):
            for place in ((n.sum() - 1) // 2, n.sum() // 2) if n.sum() else ():
                i = int(np.searchsorted(n.cumsum(), place, "right"))
                at = (k, s, int(place - n[:i].sum()))
                wanted.setdefault((f, int(col["_range"][part[i]])), set()).add(at)
                places.append((s, f, int(col["_range"][part[i]]), at))
        stats.append((k, f, n1.sum(), n2.sum(), s1.sum(), s2.sum(), rank, t.sum(), places))
    keep = F.struct("feature", "_range").isin([F.struct(F.lit(f), F.lit(i)) for f, i in wanted]) if wanted else F.lit(False)
    found = {(r[0], r[4], (r[1], r[2], r[3])): r[5] for r in each.filter(keep).mapInArrow(_at_places(table, wanted), "feature long, by long, side long, place long, _range long, value double").collect()}
    rows = []
    for k, f, n1, n2, s1, s2, rank, ties, places in stats:
        median = [None if not v else v[0] if v[0] == v[1] else (v[0] + v[1]) / 2 for v in ([found[a, i, at] for x, a, i, at in places if x == s] for s in (1, 0))]
        n, both = n1 + n2, n1 > 0 and n2 > 0
        u = rank - n1 * (n1 + 1) / 2 if both else None
        var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1))) if both else 0.0
        z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / var**0.5 if var > 0 else None
        rows.append([names[k], features[f], int(n1), int(n2), *[None if x is None else float(x) for x in (*median, s1 / n1 if n1 else None, s2 / n2 if n2 else None, u, ties, z, 2 * u / (n1 * n2) - 1 if both else None)]])
    return spark.createDataFrame(rows, f"`{by}` string, feature string, n1 bigint, n2 bigint, " + ", ".join(f"{c} double" for c in ("median1", "median2", "mean1", "mean2", "u", "ties", "z", "delta")))
