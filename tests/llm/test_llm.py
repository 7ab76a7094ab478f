"""Operators of the subpackage on small tables: brute force, round trips, held-out accuracy, nulls, ties and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankloom.llm import decontaminate as D
from rankloom.llm import line_dedup as L
from rankloom.llm import mixing as M
from rankloom.llm import near_dedup as N
from rankloom.llm import quality, toxicity
from rankloom.llm import secret_scan as S
from rankloom.llm import token_counts, token_store
from rankloom.llm import transport_stream as TS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "the end.", "A\n\n b \nthe END.\n", "x" * 3000, "café don't we'll, ÉtÉ 12.5 !! \U0001f600", "tok<|endoftext|>en <|ENDOFTEXT|>", "H̱x a\x1cb c İ", "same words here and there again", "same words here and there again"]


def words(rng, n):
    return " ".join("".join(rng.choices("aeiourstlnmd", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 4 else None, t, "en", [None, "s1", "s2"][i % 3], 0 if t is None else len(t)) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("h", F.lit("extra")).withColumn("key", F.lit(1)).withColumn("mix_size", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokenizer():
    public = pytest.importorskip("public_tokenizers")
    return public.path("word_bpe_49k.json")


def test_mix(spark, odd, empty):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 40)), "en", "big" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = M.plan_mix(d).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(r[1].split())
    names, total = sorted(size), 1.5 * sum(size.values())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:  # share by weight, cap, share the excess again
        left = total - sum(target.values())
        part = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if part[s] > 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            open_.discard(s)
    target |= part
    taken = Counter()
    for r in got:
        assert abs(r.mix_target - target[r.source]) < 1e-6 and r.mix_source_size == size[r.source] and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_size * r.mix_copies
    assert all(abs(taken[s] - target[s]) < 0.25 * target[s] for s in names)
    assert sorted(map(tuple, M.plan_mix(d).select("doc_id", "mix_copies").collect())) == sorted((r.doc_id, r.mix_copies) for r in got)
    assert M.mix(d).count() == sum(r.mix_copies for r in got)
    o = M.plan_mix(odd).collect()
    assert len(o) == len(ODD) and {r.mix_size for r in o if not r.text} == {0}
    assert M.mix(odd).columns == odd.columns and M.plan_mix(empty).count() == 0 and M.mix(empty).count() == 0


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(5)
    for _ in range(4000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 14))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randint(0, len(b))
            if rng.random() < 0.5:
                b.insert(i, rng.randint(0, 3))
            elif b:
                b.pop(min(i, len(b) - 1))
        most, d = rng.randint(0, 8), edit(a, b)
        assert N.banded_distance(a, b, most) == min(d, most + 1)


def test_sketch_follows_order():
    h = N.word_hashes(["one two three four five six seven eight nine ten", "six seven eight nine ten one two three four five", "One, two three FOUR five six seven eight nine ten!"])
    a, b, c = N.order_sketch(h, 5, 16, 2)
    assert (a == c).all() and not (a == b).all()
    assert (N.order_sketch(h[1:], 5, 16, 2) == [b, c]).all()  # whatever stands beside a text
    assert N.order_sketch([np.zeros(0, np.uint64)], 5, 16, 2).shape == (1, 16) and N.order_sketch([], 5, 16, 2).shape == (0, 16)


def test_sketch_against_its_definition():
    """The smallest labelled k-mers, found by sorting, in text order."""
    rng = random.Random(21)
    lists = [np.array([rng.randint(1, 9) for _ in range(rng.randint(1, 30))], np.uint64) for _ in range(40)]
    plain, labelled, place, starts = N.kmers(lists, 2)
    ends = [*starts[1:].tolist(), len(plain)]
    seeds = N._mix(np.arange(1, 13, dtype=np.uint64) * N._STEP)
    got = N.order_sketch(lists, 2, 6, 3)
    for t, (a, e) in enumerate(zip(starts.tolist(), ends, strict=True)):
        assert place[a:e].tolist() == list(range(e - a)) and e - a == max(1, len(lists[t]) - 1)
        for x in range(a, e):
            for y in range(a, x):
                same = lists[t][x - a : x - a + 2].tolist() == lists[t][y - a : y - a + 2].tolist()
                assert (plain[x] == plain[y]) == same and labelled[x] != labelled[y]
        for band in range(6):
            with np.errstate(over="ignore"):
                h = (labelled[a:e] ^ seeds[2 * band]) * (seeds[2 * band + 1] | np.uint64(1))
            want = np.uint64(0)
            for i, at in enumerate(sorted(np.argsort(h)[:3].tolist()), 3 - min(3, e - a)):
                with np.errstate(over="ignore"):
                    want = N._mix(np.array([want * N._STEP + plain[a + at] + np.uint64(i)], np.uint64))[0]
            assert got[t, band] == want


def test_near_duplicates_against_brute_force(spark, odd, empty):
    rng = random.Random(2)
    passage = words(rng, 60)
    texts = []
    for i in range(60):
        base = words(rng, rng.randint(40, 120))
        texts.append(base + (" " + passage if i % 3 == 0 else ""))
        for _ in range(rng.choice((0, 0, 1, 3))):
            w = texts[-1].split()
            for _ in range(len(w) // 40):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [texts[0]] * 40 + ["", None]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in N.classes(d).collect()}
    h = N.word_hashes([t or "" for t in texts])
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if N.alignment_similarity(h[i], h[j], 0.8) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in range(len(texts))} == {i: r.class_id for i, r in got.items()}
    assert [i for i, r in got.items() if r.kept] == [i for i in got if find(i) == i]
    stay = N.near_dedup(d)
    assert stay.columns == d.columns and sorted(r.doc_id for r in stay.collect()) == sorted({find(i) for i in range(len(texts))})
    o = N.classes(odd).collect()
    assert len(o) == len(ODD) and N.near_dedup(odd).count() == len({r.class_id for r in o})
    assert N.classes(empty).count() == 0 and N.near_dedup(empty).count() == 0


def test_copies_of_one_original_that_are_not_alike(spark):
    rng = random.Random(12)
    texts, groups = [], 12
    for _ in range(groups):
        base = words(rng, 300).split()
        texts.append(" ".join(base))
        for _ in range(24):
            at, new = rng.randrange(250), words(rng, 50).split()
            texts.append(" ".join(base[:at] + new + base[at + 50 :]))
    h = N.word_hashes(texts)
    assert all(N.alignment_similarity(h[g * 25], h[g * 25 + i], 0.8) >= 0.8 for g in range(groups) for i in range(25))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    assert {r.doc_id: r.class_id for r in N.classes(d).collect()} == {i: i // 25 * 25 for i in range(len(texts))}


@pytest.mark.parametrize("low,high,n,least", [(0.80, 0.85, 200, 0.9), (0.85, 0.90, 200, 0.97), (0.90, 1.0, 200, 0.99), (0.80, 0.85, 600, 0.9), (0.80, 0.90, 30, 0.95), (0.80, 0.90, 8, 0.97), (0.80, 0.90, 60, 0.85)])
def test_recall_by_edit_similarity(low, high, n, least):
    """Of planted pairs with words changed all over the text, the share that some band brings together."""
    rng = np.random.default_rng(14)
    a, b = [], []
    while len(a) < 300:
        size = int(n * rng.uniform(0.7, 1.3))
        x = rng.integers(1, 1 << 62, size).astype(np.uint64)
        y, changes = x.copy(), int(round(rng.uniform(1 - high, 1 - low) * size))
        y[rng.choice(size, changes, replace=False)] = rng.integers(1, 1 << 62, changes).astype(np.uint64)
        if 0.8 <= 1 - changes / size and changes:
            a.append(x)
            b.append(y)
    pairs = zip(N.buckets(a, 0.8, 5, 64, 2, 24), N.buckets(b, 0.8, 5, 64, 2, 24), strict=True)
    assert np.mean([bool(set(x.tolist()) & set(y.tolist())) for x, y in pairs]) >= least


def _passage_family(rng, n, shared, own):
    """Texts that share a passage but little else, among them pairs with a few words changed."""
    passage, texts = words(rng, shared), []
    for i in range(n):
        t = words(rng, own).split() + passage.split()
        texts.append(" ".join(t))
        if i % 10 == 0:
            for at in rng.sample(range(own), own // 10):
                t[at] = "other" + str(at)
            texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("whole,levels", [(N.WHOLE, N.SLOTS), (40, 3), (40, 0)])
def test_large_buckets_against_brute_force(spark, monkeypatch, whole, levels):
    """Parting in a task, in the cluster and by blocks find the pairs of a family that meets in most of its buckets."""
    rng = random.Random(15)
    monkeypatch.setattr(N, "LEAF", 16)
    texts = _passage_family(rng, 240, 60, 60) + _passage_family(rng, 60, 30, 30)
    h = N.word_hashes(texts)
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = {r.doc_id: r.class_id for r in N.classes(d, whole=whole, levels=levels).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if N.alignment_similarity(h[i], h[j], 0.8) >= 0.8]
    assert len(links) >= 30 and sum(got[i] == got[j] for i, j in links) >= 0.97 * len(links)
    linked = {x for link in links for x in link}
    assert all(got[i] == i for i in got if i not in linked)


def test_groups_test_all_their_pairs():
    """Without parting, a group gives every pair whose profiles allow for the similarity, blocks or not."""
    rng = random.Random(16)
    lists = []
    for _ in range(40):
        base = [rng.randrange(1 << 30) for _ in range(rng.randint(20, 60))]
        for _ in range(3):
            w = list(base)
            for at in rng.sample(range(len(w)), len(w) // 8):
                w[at] = rng.randrange(1 << 30)
            lists.append(np.array(w, np.uint64))
    counts, slots = N.profiles(lists)
    keys = [bytes([i // 256, i % 256]) for i in range(len(lists))]
    group = N.Group(0.8, keys, np.array(keys, object), np.array([len(x) for x in lists]), counts, slots)
    real = {(j, i) for i in range(len(lists)) for j in range(i) if N.alignment_similarity(lists[i], lists[j], 0.8) >= 0.8}
    for leaf in (7, 10_000):
        N.LEAF, was = leaf, N.LEAF
        got = {(min(x, y), max(x, y)) for a, b in group.pairs(3, 0) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
        N.LEAF = was
        assert real <= got and len(real) > 30


def test_repeated_rows_leave_one(spark):
    d = spark.createDataFrame([(1, "one two three four five six", "en", "s", 1)] * 3 + [(None, "other words altogether in this one", "en", "s", 1)] * 2, SCHEMA)
    assert sorted(r.text[:5] for r in N.near_dedup(d).collect()) == ["one t", "other"]


@pytest.mark.parametrize("bit", [False, True])
def test_planes_round_trip(bit):
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 1 << 20, 1000).astype(np.uint32)
    lens = [0, 1, 500, 499]
    docs, n, back = token_store.unpack(token_store.pack([5, -(1 << 63), 7, 8], lens, ids, block=64, bit=bit))
    assert docs.tolist() == [5, -(1 << 63), 7, 8] and n.tolist() == lens and (back == ids).all()
    none = token_store.unpack(token_store.pack([], [], ids[:0]))
    assert [len(x) for x in none] == [0, 0, 0]
    with pytest.raises(ValueError):
        token_store.unpack(b"nonsense" * 9)


def test_token_store_and_counts_agree_with_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer()
    lib = Tokenizer.from_file(path)
    want = {t: lib.encode(t or "", add_special_tokens=False).ids for t in ODD}
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    got = {r.doc_id: r for r in token_store.store_tokens(odd, path, shard_ids=50, partitions=3).collect()}
    at = 0
    for r in rows:
        ids = np.array([*want[r.text], 2], "<u4")
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.store_tokens(empty, path).count() == 0
    counts = {r.doc_id: r for r in token_counts.count_tokens(odd, path, limit=5).collect()}
    for r in rows:
        c = counts[r.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len((r.text or "").encode()), len(want[r.text]), len(want[r.text]) > 5)
    assert token_counts.count_tokens(empty, path).count() == 0


def test_counts_of_other_tokenizers(spark, odd):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer

    byte, piece = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    t, m = Tokenizer.from_file(byte), sentencepiece.SentencePieceProcessor(model_file=piece)
    for path, count in ((byte, lambda x: len(t.encode(x, add_special_tokens=False).ids)), (piece, lambda x: len(m.encode(x)))):
        for r in token_counts.count_tokens(odd, path).join(odd.select("doc_id", "text"), "doc_id").collect():
            assert r.n_tokens == count(r.text or "")


def test_a_full_cache_starts_anew():
    from tokenizers import Tokenizer

    from rankloom.llm.pretokens import Encoder

    path, rng = tokenizer(), random.Random(3)
    lib, own = Tokenizer.from_file(path), Encoder(path, 50)
    texts = [words(rng, 30) + ", the end." for _ in range(20)]
    for t in texts:
        assert next(own.batch([t.encode()]))[0].tolist() == lib.encode(t, add_special_tokens=False).ids


def test_a_full_cache_starts_anew_with_overlong_pieces():
    from tokenizers import Tokenizer

    from rankloom.llm.pretokens import Encoder

    path, rng = tokenizer(), random.Random(3)
    lib, own = Tokenizer.from_file(path), Encoder(path, 50)
    texts = [words(rng, 30) + " https://" + "ab1/" * 20 + str(i) + ", the end." for i in range(20)]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert next(own.batch([t.encode()]))[0].tolist() == ids and list(own.counts([t.encode()])) == [len(ids)]


def test_odd_texts_in_one_batch_agree_with_the_library():
    from tokenizers import Tokenizer

    from rankloom.llm.pretokens import Encoder

    path, rng = tokenizer(), random.Random(4)
    lib, own = Tokenizer.from_file(path), Encoder(path, 400)
    bits = [".", ",", "..", "a", "A", "é", "É", "İ", "\u0301", "1", "12", " ", "  ", "\n", "\x1c", "\u00a0", "'s", "<|endoftext|>", "<", "|>", "word", "Word", "x" * 70, "漢字", "\u01c5", "ﬁ", "ǆ", "-", "_", "\U0001f600"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 14))) for _ in range(3000)] + ["", ".", ",", "a.", "1,", "\n.", "a.\n"]
    got = []
    for ids, n in own.batch([t.encode() for t in texts]):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(own.counts([t.encode() for t in texts])) == [len(x) for x in got]


def lines_by_hand(rows, at_least, shortest=1):
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(L._UPPER, L._LOWER))
    docs, seen, out = defaultdict(set), set(), {}
    split = {d: (t or "").split("\n") for d, t in rows}
    for d, ls in split.items():
        for x in ls:
            docs[key(x)].add(d)
    for d in sorted(split):
        stay = []
        for x in split[d]:
            k = key(x)
            gone = len(k) >= shortest and (len(docs[k]) >= at_least if at_least else k in seen)
            seen.add(k)
            if not gone:
                stay.append(x)
        out[d] = (len(split[d]), len(split[d]) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("at_least", [None, 2, 10])
def test_lines_against_brute_force(spark, at_least):
    rng = random.Random(4)
    pool = ["", " Menu ", "menu", "COPYRIGHT", "copyright\t", *[words(rng, 3) for _ in range(30)]]
    rows = [(i, "\n".join(rng.choices(pool, weights=[5, 9, 9, 4, 4, *[1] * 30], k=rng.randint(1, 12)))) for i in range(150)] + [(150, None), (151, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in L.drop_lines(d, at_least=at_least, partitions=7).collect()}
    assert got == lines_by_hand(rows, at_least)
    sha = {r.doc_id: r.kept_sha256 for r in L.drop_lines(d, digest=True, at_least=at_least).collect()}
    assert sha == {k: hashlib.sha256(v[2].encode()).hexdigest() for k, v in got.items()}


def test_one_line_over_many_partitions(spark):
    d = spark.createDataFrame([(i, "all\nhave\nthis" + f"\n{i}") for i in range(400)], "doc_id long, text string")
    got = L.drop_lines(d, at_least=10, partitions=40).collect()
    assert {(r.n_lines, r.n_dropped) for r in got} == {(4, 3)}
    first = {r.doc_id: r.n_dropped for r in L.drop_lines(d, at_least=None, partitions=40).collect()}
    assert first[0] == 0 and set(first.values()) == {0, 3} and sum(first.values()) == 399 * 3


def test_lines_of_odd_rows(odd, empty):
    got = L.drop_lines(odd, at_least=2).collect()
    assert len(got) == len(ODD) and {r.n_lines for r in got if r.text == ""} >= {1}
    assert L.drop_lines(empty).count() == 0


def test_decontamination(spark, odd, empty):
    rng = random.Random(6)
    items = [words(rng, rng.randint(16, 50)) for _ in range(20)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, None), (91, "too short"), (92, "")], "item_id long, text string")
    rows, want = [], {}
    for i in range(120):
        w, hit = words(rng, 80).split(), None
        if i % 4 == 0:
            hit = rng.randrange(20)
            p = items[hit].upper().split()
            if i % 8 == 0:  # every eleventh word another one
                p = ["zzz" if k % 11 == 10 else x for k, x in enumerate(p)]
            w[30:30] = p
        want[i] = [hit] if hit is not None else []
        rows.append((i, ", ".join(w), "en", "s", 0))
    d = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in D.contaminated(d, bench).collect()}
    assert {i: r.item_ids for i, r in got.items()} == {i: v for i, v in want.items() if v}
    assert all(r.doc_start == 30 for r in got.values())
    blocks = D.contaminated(d, bench, block_rows=100).collect()
    assert {r.doc_id for r in blocks} == set(got)
    clean = D.decontaminate(d, bench)
    assert clean.columns == d.columns and {r.doc_id for r in clean.collect()} == {i for i, v in want.items() if not v}
    none = bench.limit(0)
    assert D.contaminated(d, none).count() == 0 and D.decontaminate(d, none).count() == 120
    assert D.contaminated(empty, bench).count() == 0 and D.decontaminate(odd, bench).count() == len(ODD)


def test_overlaps_with_gaps_between_verbatim_runs(spark):
    rng = random.Random(14)
    item = words(rng, 118).split()
    short = words(rng, 60).split()
    other = lambda n: [f"z{rng.randrange(10**9)}" for _ in range(n)]
    docs = [
        other(20) + item[:30] + other(14) + item[44:74] + other(14) + item[88:118] + other(20),  # runs of 30, 14 others between
        other(20) + short[:13] + other(6) + short[19:32] + other(6) + short[38:51] + other(20),  # runs of 13, 6 others between
        other(20) + short[:12] + other(20),  # too few
        other(9) + short[:9] + other(6) + short[15:19] + other(1) + short[20:24] + other(1) + short[25:29] + other(1) + short[30:34] + other(9),  # 4 of 5, and a run of 9 that scores more
    ]
    d = spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in enumerate(docs)], SCHEMA)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.matched, r.length) for r in D.contaminated(d, bench).collect()}
    assert set(got) == {0, 1, 3} and all(m >= 13 and m >= 0.8 * n for _, m, n in got.values())


def test_items_too_short_for_seeds(spark):
    bench = spark.createDataFrame([(1, "alpha beta, gamma"), (2, "delta"), (3, "Alpha beta gamma one two three four five"), (4, ""), (5, None), (6, "...")], "item_id long, text string")
    docs = ["x alpha BETA gamma y", "alpha beta x gamma", "Delta!", "the alpha beta gamma one two three four five six", "alpha beta gamma one two three four", "", None]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], SCHEMA)
    for block_rows in (1, 1000):
        got = {r.doc_id: (r.item_ids, r.matched, r.doc_start) for r in D.contaminated(d, bench, block_rows=block_rows).collect()}
        assert got == {0: ([1], 3, 1), 2: ([2], 1, 0), 3: ([1, 3], 8, 1), 4: ([1], 3, 0)}


def test_overlaps_against_brute_force(spark):
    """Random items laid into documents with random tokens replaced, some after 13 verbatim ones: all diagonals, all stretches."""
    rng = random.Random(19)
    items = {i: [f"w{i}x{k}" for k in range(rng.randint(9, 45))] for i in range(8)}
    docs = {}
    for i in range(80):
        part = list(items[rng.randrange(8)])
        keep = rng.choice((0, 13))
        rate = rng.choice((0.1, 0.2, 0.3, 0.5))
        part = [t if k < keep or rng.random() >= rate else f"o{rng.randrange(10**9)}" for k, t in enumerate(part)]
        if i % 3 == 0:
            part = [t if k < 13 or k % 4 else f"o{k}" for k, t in enumerate(items[i % 8])]
        docs[i] = [f"x{rng.randrange(10**9)}" for _ in range(rng.randint(0, 9))] + part + [f"y{rng.randrange(10**9)}" for _ in range(rng.randint(0, 9))]

    def held(doc, item):
        need = min(13, -(-len(item) * 4 // 5))
        for shift in range(-len(item) + 1, len(doc)):
            same = [0 <= k + shift < len(doc) and doc[k + shift] == x for k, x in enumerate(item)]
            hit = any(all(same[j + o] for o, m in enumerate(mask) if m == "1") for mask in D.MASKS for j in range(len(item) - D.SPAN + 1))
            if hit and any(sum(same[p:q]) >= max(need, 0.8 * (q - p) - 1e-9) for p in range(len(item)) for q in range(p + 1, len(item) + 1)):
                return True
        return False

    d = spark.createDataFrame([(i, " ".join(x), "en", "s", 0) for i, x in docs.items()], SCHEMA)
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items.items()], "item_id long, text string")
    want = {(i, k) for i, x in docs.items() for k, y in items.items() if held(x, y)}
    assert {(r.doc_id, r.item_id) for r in D.overlaps(d, bench).collect()} == want and 20 < len(want) < 80
    assert all(any(k == i % 8 for k in items if (i, k) in want) for i in range(0, 80, 3) if len(items[i % 8]) >= 13)


def test_columns_with_clashing_names(spark):
    """Whatever a table's own columns are called, filters return them as they are."""
    rows = [(1, "one two three four five six seven", "src0", 7, 8, 9, 10, "d", "h"), (2, "one two three four five six seven", "src0", 7, 8, 9, 10, "d", "h"), (3, "alpha beta", None, 1, 2, 3, 4, "d", None)]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string, _d int, _h int, mix_size int, mix__size int, d string, h string").withColumn("H_", F.lit(1)).withColumn("kept", F.lit(1))
    bench = spark.createDataFrame([(5, "alpha beta")], "item_id long, text string")
    for out in (N.near_dedup(t), D.decontaminate(t, bench), M.mix(t)):
        assert out.columns == t.columns
        assert all(r._d == {1: 7, 3: 1}[min(r.doc_id, 1) if r.doc_id < 3 else 3] and r.mix_size == r._d + 2 for r in out.collect())
    assert [r.doc_id for r in D.decontaminate(t, bench).collect()] == [1, 2] and sorted(r.doc_id for r in N.near_dedup(t).collect()) == [1, 3]


def test_undecided_runs_wait_as_rows(spark, monkeypatch):
    """A key of many lines in few documents, and then in many: held in small parts, decided alike."""
    monkeypatch.setattr(L, "HELD", 20)
    few, many = "\n".join(["rare"] * 300 + ["own"]), "\n".join(["common"] * 100)
    d = spark.createDataFrame([(i, few + str(i), "en", "s", 0) for i in range(9)] + [(20 + i, many + f"\nother{i}", "en", "s", 0) for i in range(12)], SCHEMA)
    for partitions in (1, 5):
        got = {r.doc_id: r for r in L.drop_lines(d, partitions=partitions).collect()}
        assert all(got[i].n_dropped == 0 and got[i].text == few + str(i) for i in range(9))
        assert all((got[20 + i].n_dropped, got[20 + i].text) == (100, f"other{i}") for i in range(12))


def test_the_best_stretch_against_brute_force(spark):
    rng = random.Random(15)
    rows = []
    for i in range(200):
        n = rng.randint(1, 40)
        rows.append((i, list(range(n)), [k if rng.random() < 0.75 else -1 for k in range(n)]))
    d = spark.createDataFrame(rows, "i int, bh array<int>, dh array<int>")
    got = {r.i: r.s.matches for r in d.select("i", D._stretch("dh", "bh", F.lit(0), 0.8).alias("s")).collect()}
    for i, a, b in rows:
        same = [x == y for x, y in zip(a, b, strict=True)]
        every = (sum(same[p:q]) for p in range(len(a)) for q in range(p + 1, len(a) + 1) if sum(same[p:q]) >= (q - p) * 0.8)
        assert got[i] == max(every, default=0)


def test_decontamination_plan_is_native(spark):
    d = spark.createDataFrame([(1, "x", "en", "s", 1)], SCHEMA)
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r")], "item_id long, text string")
    for df in (D.contaminated(d, bench), M.plan_mix(d)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow", "ArrowEval"))


@pytest.mark.parametrize("n", [0, 1, 64, 176, 177, 184, 345, 360, 361, 16384, 40000])
def test_streams_round_trip(n):
    data = bytes(random.Random(n).randbytes(n))
    m = TS.write_stream(data)
    s = TS.Stream(m)
    assert len(m) % 188 == 0 and s.payload() == data
    assert (s.counter_errors, s.lost_sync, s.crc_errors, s.duplicates) == (0, 0, 0, 0) and s.programs == {1: 0x100} and s.streams == {0x101: 6}
    assert [p[1] for p in s.pes] == [k * TS.TICK for k in range(len(s.pes))] and all(p[2] for p in s.pes)


def test_damaged_streams():
    m = TS.write_stream(bytes(range(250)) * 20)
    assert TS.Stream(m[: 188 * 5] + m[188 * 6 :]).counter_errors == 1
    twice = TS.Stream(m[: 188 * 5] + m[188 * 4 :])
    assert twice.duplicates == 1 and twice.counter_errors == 0 and twice.payload() == TS.Stream(m).payload()
    assert TS.Stream(b"junk" + m).lost_sync == 1 and TS.Stream(b"junk" + m).payload() == TS.Stream(m).payload()
    bad = bytearray(m)
    bad[10] ^= 1
    assert TS.Stream(bytes(bad)).crc_errors == 1 and TS.Stream(b"").payload() == b"" and TS.section_crc(b"123456789") == 0x0376E6E7


def test_media_columns(spark, odd, empty):
    got = {r.doc_id: r for r in TS.read_media(TS.to_media(odd)).collect()}
    for r in odd.collect():
        data = (r.text or "").encode()
        pad = data + b"\0" * ((-len(data)) % 64 or (0 if data else 64))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
    assert TS.read_media(TS.to_media(empty)).count() == 0
    none = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert TS.read_media(none).first().payload_bytes == 0


def test_guess_costs():
    cost = lambda v: S.guess_cost(v)[0]
    assert S.guess_cost("")[0] == 0 and "".join(x for _, x in S.guess_cost("P@ssword1999aaaa")[1]) == "P@ssword1999aaaa"
    assert cost("changeme") < cost("password123") < cost("qwerty12345") < 8 < 10 < cost("x9$Kq2!vLz") < cost("e3b3ed3cc8548923d6")
    assert S.guess_cost("aaaaaaaaaaaa")[1] == [("repeat", "aaaaaaaaaaaa")] and S.guess_cost("20210304")[1][0][0] == "date"
    rng = random.Random(8)
    for _ in range(200):  # never dearer than brute force alone
        v = "".join(rng.choices("ab12xyQ!", k=rng.randint(1, 14)))
        assert cost(v) <= sum(map(S._class_cost, v)) + 1e-9


def test_guess_costs_against_all_segmentations():
    """Every way to cut a value into words, repeats, walks and brute force, tried one by one."""
    rng, words_ = random.Random(18), S.words_at(None)
    step = lambda a, b: (a, b) in S._NEXT

    def prices(v, i, j):
        part, low = v[i:j], v[i:j].lower()
        yield "brute", sum(map(S._class_cost, part))
        for w, leet in ((low, 0.0), (low.translate(S._LEET), 0.301)):
            if len(part) >= 3 and w in S.WORDS:
                upper = sum(x.isupper() for x in part)
                yield "word", 0.301 + np.log10(S.WORDS.index(w) + 1) + leet + 0.301 * min(upper, len(part) - upper + 1)
                break
        for size in (1, 2, 3, 4):
            times = len(part) // size
            whole = len(part) % size == 0 and part == part[:size] * times and not v[i + len(part) :].startswith(part[:size])
            if whole and times >= (3 if size == 1 else 2) and (size > 1 or i == 0 or v[i - 1] != v[i]):
                yield "repeat", sum(map(S._class_cost, part[:size])) + np.log10(times)
        walk = all(map(step, low, low[1:])) and (i == 0 or not step(v[i - 1].lower(), low[0])) and (j == len(v) or not step(low[-1], v[j].lower()))
        if len(part) >= 3 and walk:
            yield "walk", 1 + np.log10(40) + np.log10(len(part))

    def cheapest(v):
        best = [{"": 0.0}] + [{} for _ in v]  # by the kind of the last span, as brute force doesn't follow brute force
        for j in range(1, len(v) + 1):
            for i in range(j):
                for kind, cost in prices(v, i, j):
                    for was, so_far in best[i].items():
                        if (was, kind) != ("brute", "brute"):
                            best[j][kind] = min(best[j].get(kind, 1e9), so_far + cost + (0.301 if i else 0))
        return min(best[-1].values())

    assert words_.longest <= S.Words.LONGEST
    for _ in range(400):
        v = "".join(rng.choices(["a", "b", "ab", "1", "2", "q", "we", "Pass", "p@ss", "key", "x", "$", "zz"], k=rng.randint(1, 7)))
        got = S.guess_cost(v)[0]
        assert abs(got - cheapest(v)) < 1e-9
        assert "".join(x for _, x in S.guess_cost(v)[1]) == v
        for enough in (2.0, 5.0):
            assert abs(S.guess_cost(v, enough)[0] - min(got, enough)) < 1e-9


def test_secret_scans_take_time_in_proportion():
    import time

    for start, block in (("", "a_"), ("password: ", "ab"), ("password: ", "aq3z"), ("pin", " "), ("token=", "1234567890"), ("secret: ", "documentation")):
        began = time.process_time()
        S.spans_of(start + block * (4_000_000 // len(block)))
        assert time.process_time() - began < 10


def test_words_are_no_secrets():
    w = S.words_at(tokenizer())
    for t in ("login: documentation", "Token: description of the field", "the login is unavailable today", "pin: international", "password: changeme", "auth: authorization"):
        assert S.find_guessed(t, words=w) == []
    for t in ("login: xK9#qLm2vT", "api-key => Zx81kfQ0ppLs", "my_db.password is 'e3b3ed3cc854x'"):
        assert len(S.find_guessed(t, words=w)) == 1


def test_secrets_against_plain_patterns(spark, odd, empty):
    import re

    rng = random.Random(9)
    bits = ["password: ", "token=", "API_KEY = '", "secret", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef", " ", "\n", "x", "Passwd:", "=", "ſecret: abcdefgh ", "é"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(400)]
    for t in texts:
        assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
        want = [(m.start(), m.end(), "assign") for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base, every = S.spans_of(t)
        assert sorted(base) == sorted(want) and set(base) <= set(every)
    assert S.find_guessed("the db_pwd is x9$Kq2!vLz7 now") == [(14, 25, "guess")] and S.find_guessed("pwd: changeme") == []
    assert S.find_guessed("my password IS Zq8#vR2!mK9$wX4") == [(15, 30, "guess")]
    assert len(S.find_guessed("pwd is'x9$Kq2!vLz7")) == 1
    assert S.redact("pwd: abc!", [(5, 8, "guess"), (6, 9, "hex")]) == "pwd: [secret]"
    got = S.scan(odd).collect()
    assert len(got) == len(ODD) and {r.base_sha256 for r in got if not r.spans} == {hashlib.sha256(b"").hexdigest()} and S.scan(empty).count() == 0


def labelled(spark, kind, n=400):
    rng = random.Random(10)
    docs, labels = [], []
    for i in range(n):
        w, y = words(rng, rng.randint(30, 150)).split(), int(rng.random() < 0.5)
        if kind == "toxic" and y:
            for _ in range(1 + len(w) // 40):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "morons", "scumbag", "trash"])
        if kind == "quality" and not y:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, y if kind == "quality" else 1, y if kind == "toxic" else 0))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels + [(None, 1, 1), (n + 5, None, None)], "doc_id long, quality int, toxic int")


def held_out_accuracy(rows, labels, label):
    y = {r.doc_id: r[label] for r in labels.collect()}
    out = [r.predicted == y[r.doc_id] for r in rows if r.held_out]
    return sum(out) / len(out)


def test_quality(spark, odd, empty):
    docs, labels = labelled(spark, "quality")
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert held_out_accuracy(rows, labels, "quality") > 0.95
    o = quality.score(odd, model).collect()
    assert len(o) == len(ODD) and all(0 <= r.score <= 1 for r in o) and len({r.score for r in o if r.doc_id in (0, 1)}) == 1
    kept = quality.keep_good(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in o)
    none = quality.train(docs, labels.limit(0))
    assert quality.score(docs, none).count() == 400 and quality.score(empty, model).count() == 0


def test_toxicity(spark, odd, empty):
    docs, labels = labelled(spark, "toxic", 1500)
    net = toxicity.train(docs, labels)
    rows = toxicity.score(docs, net).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert held_out_accuracy(rows, labels, "toxic") > 0.9
    o = toxicity.score(odd, net).collect()
    assert len(o) == len(ODD) and all(0 <= r.score <= 1 for r in o)
    twins = [r.score for r in o if r.doc_id in (9, 10)]
    assert abs(twins[0] - twins[1]) < 1e-4
    none = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, none).count() == 1500 and toxicity.score(empty, net).count() == 0


def test_network_gradients():
    r = np.random.default_rng(0)
    net = toxicity.Net(1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    some, rows, y = [b"abc", b"defg", b"hi", b"jklmn"], r.integers(0, 5, (3, toxicity.WINDOW)), np.array([1, 0, 1.0])

    def loss():
        x, _ = net.inputs(some)
        z = net.forward(net.projected(x).astype(np.float64), rows)
        return np.logaddexp(0, np.where(y > 0, -z, z)).sum()

    x, _ = net.inputs(some)
    z, saved = net.forward(net.projected(x), rows, keep=True)
    g = net.backward(1 / (1 + np.exp(-z)) - y, saved, 4)
    for k in ("u", "a", "v", "o"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        was, e = net.p[k][at], 1e-3
        net.p[k][at] = was + e
        up = loss()
        net.p[k][at] = was - e
        down = loss()
        net.p[k][at] = was
        assert abs((up - down) / (2 * e) - g[k][at]) < 1e-3 + 0.02 * abs(g[k][at])


def test_scores_do_not_depend_on_what_else_there_is():
    rng = random.Random(20)
    texts = [words(rng, n) for n in (0, 1, 5, 31, 32, 33, 48, 49, 500, 3000) for _ in range(8)] + ["is onhe. " * 700, "so " * 40, "so so"]
    y = np.array([i % 2 for i in range(len(texts))])
    net = toxicity.fit([t + " idiot moron" * k for t, k in zip(texts, y, strict=True)], y, epochs=2)
    together = toxicity.Scorer(net).scores(texts[::-1])[::-1]
    assert together.tolist() == [toxicity.Scorer(net).scores([t])[0] for t in texts]
    good, bad = ["plain words of a text " + words(rng, 40) for _ in range(60)], ["### $$$ " + words(rng, 40).upper() for _ in range(60)]
    model = quality.fit(good + bad, np.array([1] * 60 + [0] * 60))
    assert model.scores(texts).tolist() == [model.scores([t])[0] for t in texts]


def test_every_passage_stands_in_a_window():
    """Sixteen words on end, wherever they begin, are seen together."""
    for n in (16, 17, 40, 47, 48, 49, 200):
        rows = toxicity.laid_out(np.arange(n), n)
        assert all(any(set(range(a, a + 16)) <= set(r.tolist()) for r in rows) for a in range(n - 15))


def test_dictionaries_see_the_whole_of_a_text():
    pieces = [bytes([i]) for i in range(100)]
    got = quality._spread(pieces)
    assert len(got) == quality.PIECES and got[0] == pieces[0] and got[-1] == pieces[-1] and quality._spread(pieces[:3]) == pieces[:3]


def test_windows_overlap_and_reach_the_end():
    assert toxicity.windows_of(5).tolist() == [0] and toxicity.windows_of(32).tolist() == [0] and toxicity.windows_of(33).tolist() == [0, toxicity.STRIDE]
    for n in range(1, 200):
        b = toxicity.windows_of(n)
        assert b[-1] + toxicity.WINDOW >= n and (np.diff(b) == toxicity.STRIDE).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(17)
    names = [rng.randbytes(4) for _ in range(300)]
    links = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)] + [(names[i], names[rng.randrange(200, i)]) for i in range(201, 300)]
    rng.shuffle(links)
    rows = N._components(spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in [*links, *links[:9], (names[5], names[5])]], "a binary, b binary")).collect()
    got = {bytes(r.key): bytes(r.root) for r in rows}
    assert len(rows) == 300 and all(got[x] == min(names[k : k + 100]) for k in (0, 100, 200) for x in names[k : k + 100])
    assert N._components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def test_network_against_a_plain_forward_pass():
    """One window, word by word and direction by direction, in ordinary arithmetic."""
    words_, at, _ = toxicity.words_of(["some words and more of these words, then quite a few others"])
    net = toxicity.Net(3)
    rng = np.random.default_rng(4)
    net.odds_word, net.odds_gram = (rng.normal(size=x.shape).astype(np.float32) for x in (net.odds_word, net.odds_gram))
    for name in ("word", "gram"):
        net.p[name] = rng.normal(size=net.p[name].shape).astype(np.float32) / 4
    x = net.inputs(words_)[0]
    rows = toxicity.laid_out(at, len(words_))
    got = net.forward(net.projected(x), rows)
    p, k, sig = {n: v.astype(float) for n, v in net.p.items()}, toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    assert len(rows) == 1
    states = {}
    for d, order in ((0, range(toxicity.WINDOW)), (1, reversed(range(toxicity.WINDOW)))):
        h = np.zeros(k)
        for t in order:
            if rows[0, t] < len(words_):
                g, u = x[rows[0, t]].astype(float) @ p["w"][d] + p["b"][d, 0], h @ p["u"][d]
                z, r = sig(g[:k] + u[:k]), sig(g[k : 2 * k] + u[k : 2 * k])
                c = np.tanh(g[2 * k :] + r * u[2 * k :])
                h = (1 - z) * c + z * h
            states[d, t] = h
    both = [np.concatenate([states[0, t], states[1, t]]) for t in range(toxicity.WINDOW) if rows[0, t] < len(words_)]
    weight = np.exp([float(np.tanh(s @ p["a"]) @ p["v"][:, 0]) for s in both])
    pooled = sum(w * s for w, s in zip(weight / weight.sum(), both, strict=True))
    assert abs(float(got[0]) - float(pooled @ p["o"][:, 0] + p["c"][0])) < 1e-4


def test_large_buckets_test_all_pairs_unless_told_otherwise():
    import inspect

    assert inspect.signature(N.classes).parameters["levels"].default == 0


def test_pairs_of_a_large_group_are_no_rows(spark, monkeypatch):
    """A group's task aligns its pairs itself: it hands on fewer links than members, and of the buckets that two texts share one tests them."""
    rng, calls = random.Random(31), []
    base = [rng.randrange(1 << 30) for _ in range(100)]
    lists = []
    for i in range(80):  # 40 alike, and 40 of the same words in any order
        w = list(base) if i < 40 else rng.sample(base, len(base))
        for at in rng.sample(range(len(w)), 4 if i < 40 else 0):
            w[at] = rng.randrange(1 << 30)
        lists.append(np.array(w, np.uint32))
    real = N.alignment_similarity
    monkeypatch.setattr(N, "AGREE", 0)
    monkeypatch.setattr(N, "alignment_similarity", lambda a, b, least: calls.append(1) or real(a, b, least))
    counts, slots = N.profiles([x.astype(np.uint64) for x in lists])
    keys = [bytes([i, 7 * i % 256]) for i in range(80)]
    group = lambda m, **k: N.Group(0.8, [keys[i] for i in m], np.array([keys[i] for i in m], object), np.full(len(m), 100), counts[m], slots[m], [lists[i] for i in m], **k)
    alike = np.arange(40)
    assert sum(map(len, group(alike).links(0, 0))) == 39 and len(calls) < 40 * 39 / 2
    far = [i for i in range(40, 80) if all(real(lists[i], lists[j], 0.8) == 0 for j in range(40, 80) if j != i)]
    calls.clear()
    assert not list(group(far).links(0, 0))
    once = len(calls)
    calls.clear()
    assert not [x for home in (5, 9, 11) for x in group(far, own=[np.array([5, 9, 11])] * len(far), home=home).links(0, 0)]
    assert len(calls) == once > len(far)
    seen, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, words, least: seen.append(pairs.count()) or verified(pairs, words, least))
    texts = _passage_family(random.Random(32), 60, 60, 60)
    N.classes(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)).collect()
    assert len(seen) == 1  # members with their pivots


def test_small_profiles_allow_for_what_profiles_do():
    rng = random.Random(41)
    vocabulary = [rng.randrange(1 << 32) for _ in range(90)]
    lists = []
    for n in [*range(1, 60), 90, 200] * 2:
        base = rng.choices(vocabulary, k=n)
        for changes in (0, n // 10, n // 5):
            w = list(base)
            for at in rng.sample(range(n), changes):
                w[at] = rng.randrange(1 << 32)
            lists.append(np.array(w, np.uint32))
    keys = [i.to_bytes(2, "big") for i in range(len(lists))]
    every = np.arange(len(lists))
    classes, n = np.array(keys, object), np.array([len(x) for x in lists])
    exact = N.Group(0.8, keys, classes, n, *N.profiles([x.astype(np.uint64) for x in lists]))
    small = N.samples(lists)
    rough = N.Group(0.8, keys, classes, n, small[:, N.SLOTS :], small[:, : N.SLOTS], rough=True)
    pairs = [{(i, j) for a, b in g._all(every) for i, j in zip(a.tolist(), b.tolist(), strict=True)} for g in (exact, rough)]
    assert len(pairs[0]) > 200 and pairs[0] <= pairs[1]
    met = rough.paired()
    assert {x for p in pairs[1] for x in p} == set(np.flatnonzero(met).tolist())


def test_members_that_meet_by_chance_bring_no_words(spark, monkeypatch):
    """Of an open bucket only members with a possible counterpart go on to the step that carries words, once for each bucket and whatever its blocks."""
    rng, seen, profiled = random.Random(42), [], N._profiled
    monkeypatch.setattr(N, "_profiled", lambda members, texts: seen.append(sorted((r.bucket, r.key) for r in members.select("bucket", "key").collect())) or profiled(members, texts))
    alike = _passage_family(rng, 40, 60, 60)
    far = [words(rng, 200) + " " + passage for passage in [words(rng, 40)] for _ in range(60)]
    h = N.word_hashes(far)
    assert not any(N.alignment_similarity(h[i], h[j], 0.8) for i in range(len(h)) for j in range(i))
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(alike + far)], SCHEMA)
    got = [{r.doc_id: r.class_id for r in N.classes(d, whole=whole).collect()} for whole in (N.WHOLE, 16)]
    assert got[0] == got[1] and len(set(got[0].values())) < len(got[0])
    assert seen[0] == seen[1] == sorted(set(seen[0]))
    keys = {xxhash.xxh3_128_digest(w.tobytes()) for w in h}
    assert not [key for _, key in seen[0] if bytes(key) in keys]
