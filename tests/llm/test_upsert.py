"""The copy-on-write upsert against plain Python: contents of every file, nulls, ties, repeats, hot ids, clashing names, no rows."""

import glob
import hashlib
import math
import random
import zlib

import pyarrow.parquet as pq

from rankloom.llm import upsert as U

CLIENTS = "client_id long, master_id long, source string, name string, city string, segment string, balance double, at string, file string, _metadata string"
CHANGES = "change_id long, client_id long, seq long, op string, source string, segment string, city string, balance double, name string, home_ int"
NAMES = [c.split()[0] for c in CLIENTS.split(", ")]


def crc(x):
    return zlib.crc32(str(x).encode())


def brute(clients, changes, files):
    """(rows, rewritten) of every file in order; ids don't repeat."""
    most = 1 + len(clients) // files
    base = sorted((r for r in clients if r["client_id"] is not None and crc(r["client_id"]) % 7 > 3), key=lambda r: r["client_id"])
    parts = [base[i : i + most] for i in range(0, len(base), most)]
    if not parts:
        return []
    starts, new, last = [p[0]["client_id"] for p in parts], [{r["client_id"]: dict(r) for r in p} for p in parts], {}
    order = lambda x: (x is not None, x or 0)
    for c in changes:
        k = (order(c["seq"]), order(c["change_id"]))
        if c["client_id"] is not None and (c["client_id"] not in last or k > last[c["client_id"]][0]):
            last[c["client_id"]] = (k, c)
    for i, (_, c) in last.items():
        home = max([j for j, s in enumerate(starts) if s <= i], default=0)
        h = crc(starts[home]) % 10
        if h > 7:
            continue
        if c["op"] == "D" or crc("" if c["change_id"] is None else c["change_id"]) % 8 < h:
            new[home].pop(i, None)
        else:
            new[home].setdefault(i, dict.fromkeys(NAMES) | {"client_id": i}).update({k: c[k] for k in ("source", "segment", "city", "balance")})
    out = []
    for old, rows in zip(parts, new, strict=True):
        rows = [rows[k] for k in sorted(rows)]
        if rows == old:
            out.append((rows, False))
            continue
        k, at = -(-len(rows) // most), 0
        for j in range(k):
            size = len(rows) // k + (j < len(rows) % k)
            piece, at = rows[at : at + size], at + size
            if out and out[-1][1] and len(out[-1][0]) + len(piece) <= most:
                out[-1] = (out[-1][0] + piece, True)
            else:
                out.append((piece, True))
    return out


def tables(n, changes, seed, hot=0.3):
    rng = random.Random(seed)
    word = lambda: rng.choice(["web", "crm", "é|x", "", None])
    money = lambda: rng.choice([None, -0.005, 12.345, rng.uniform(-1e3, 1e4)])
    ids = rng.sample(range(-50, 4 * n), n)
    clients = [dict(zip(NAMES, (i, i // 2, word(), f"n{i}", word(), word(), money(), "a", "f", None), strict=True)) for i in ids]
    clients.append(dict.fromkeys(NAMES))
    made = []
    for c in range(changes):
        i = ids[0] if rng.random() < hot else rng.choice([None, rng.randrange(-80, 4 * n + 500), rng.choice(ids), rng.choice(ids)])
        made.append({"change_id": rng.choice([c, c, c, None]) if i != ids[0] else c, "client_id": i, "seq": rng.choice([None, 0, 1, 2, c]), "op": rng.choice(["U", "I", "D", None]), "source": word(), "segment": word(), "city": word(), "balance": money(), "name": "not read", "home_": 3})
    for i in {c["client_id"] for c in made}:  # a change without an id of its own must not tie with another
        seen = set()
        made = [c for c in made if c["client_id"] != i or not ((c["seq"], c["change_id"]) in seen or seen.add((c["seq"], c["change_id"])))]
    same = rng.choice(clients[:-1])
    made.append({k: same.get(k) for k in ("source", "segment", "city", "balance", "client_id", "name")} | {"change_id": 10**6, "seq": 10**6, "op": "U", "home_": 1})
    return clients, made + made[:20]


def run(spark, clients, changes, files):
    as_rows = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema).repartition(3)
    return U.upsert_clients(as_rows(clients, CLIENTS), as_rows(changes, CHANGES), files)


def check(spark, clients, changes, files):
    got = sorted(run(spark, clients, changes, files).collect(), key=lambda r: r.first_id)
    want = brute(clients, changes, files)
    cents = lambda x: 0 if x is None else math.floor(100 * x + 0.5)
    assert [(r.first_id, r.n_rows, r.cents, r.rows_crc, r.ids_sha256, r.columns, r.rewritten) for r in got] == [
        (f[0]["client_id"], len(f), sum(cents(r["balance"]) for r in f), sum(crc("|".join(r[k] or "" for k in ("source", "segment", "city"))) for r in f), hashlib.sha256(",".join(str(r["client_id"]) for r in f).encode()).hexdigest(), ",".join(NAMES), new)
        for f, new in want
    ]
    if got:
        folder = got[0].path.removeprefix("file:").rpartition("/")[0]
        assert {p.lstrip("/") for p in glob.glob(f"{folder}/*.parquet")} == {r.path.removeprefix("file:").lstrip("/") for r in got}
        assert [pq.read_table(r.path.removeprefix("file:")).to_pylist() for r in got] == [f for f, _ in want]
    return want


def test_against_plain_python(spark):
    want = check(spark, *tables(400, 500, 1), files=40)
    assert {new for _, new in want} == {True, False}
    assert len(want) != len(brute(tables(400, 500, 1)[0], [], 40))


def test_files_of_one_row_and_one_file(spark):
    check(spark, *tables(40, 60, 2), files=1500)
    check(spark, *tables(60, 300, 3), files=1)


def test_no_rows(spark):
    clients, changes = tables(30, 40, 4)
    assert run(spark, [], changes, 5).count() == 0
    check(spark, clients, [], 5)
    deletes = [c | {"op": "D", "client_id": r["client_id"], "change_id": 1, "seq": 10**7} for r in clients[:-1] for c in changes[:1]]
    check(spark, clients, deletes, 5)


def test_repeated_ids_and_ties(spark):
    clients, _ = tables(60, 0, 5)
    base = next(r for r in sorted(clients[:-1], key=lambda r: r["client_id"]) if crc(r["client_id"]) % 7 > 3)
    twice = [*clients, base | {"name": "again"}]
    change = {"client_id": base["client_id"], "change_id": 7, "seq": 1, "op": "U", "segment": "s", "city": "c", "balance": 1.5, "name": "", "home_": 0}
    seen = set()
    for _ in range(2):
        got = sorted(run(spark, twice, [change | {"source": s} for s in ("one", "two")], 1).collect(), key=lambda r: r.first_id)
        rows = pq.read_table(got[0].path.removeprefix("file:")).to_pylist()
        mine = [r for r in rows if r["client_id"] == base["client_id"]]
        assert {r["name"] for r in mine} == {base["name"], "again"}
        seen |= {r["source"] for r in mine}
    assert len(seen) == 1  # set alike in both rows, and by the same one of two changes that tie


def test_folding_in_parts_is_the_same():
    rng = random.Random(6)
    pairs = [((0, rng.randrange(9), 0, (True, rng.randrange(5)), (True, c)), (c, "U")) for c in range(300)]
    whole = {k[1]: (k, v) for k, v in U.newest(pairs)}
    some = list(U.newest(pairs, kept=4))
    assert {k[1]: (k, v) for k, v in U.newest(some)} == whole and len(some) > len(whole)


def test_plan():
    assert U.cut(10, 4) == [4, 3, 3] and U.cut(0, 4) == [] and U.cut(4, 4) == [4]
    # 3 + 1 join, 2 can't; a file that stays parts its neighbours; an emptied home doesn't
    assert U.plan(7, {0: 3, 1: 1, 2: 2, 4: 1, 5: 0, 6: 3}, {0, 1, 2, 4, 5, 6}, 4) == ({0: [0], 1: [0], 2: [1], 4: [2], 5: [], 6: [2]}, 3)
