"""Every stage of the pipeline on a small corpus, against plain Python over what the stage before it kept."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rankloom.llm import near_dedup as N
from rankloom.llm import quality

from test_llm import SCHEMA, tokenizer, words

pipeline = pytest.importorskip("corpus_pipeline")


def corpus(spark, root, clash=False):
    rng = random.Random(31)
    items = [words(rng, 30) for _ in range(3)] + ["short item"]
    rows, labels = [], []
    for i in range(160):
        t = words(rng, rng.randint(30, 90))
        kind = i % 8
        if kind == 1:
            t = rows[-1][1]  # a copy
        elif kind == 2:
            w = rows[-2][1].split()
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t += " " + items[i % 3].upper() + " " + words(rng, 5)
        elif kind == 4:
            t = " ".join(x.upper() + "###" for x in t.split())
        rows.append((i, t, "en", [None, "a", "b", "c"][i % 4] if i % 3 else "a", len(t)))
        labels.append((i, int(kind != 4), 0))
    rows += [(160, "", "en", "a", 0), (161, None, None, None, None), (None, "null id " + words(rng, 40), "en", "b", 1), (5, rows[5][1], "en", "a", 1), (162, words(rng, 20_000), "en", "a", 1), (163, "a short item here " + words(rng, 20), "en", "a", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    if clash:
        d = d.selectExpr("*", "1 AS _d", "2 AS H", "3 AS mix_size", "4 AS kept", "5 AS key")
    d.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return items


@pytest.mark.parametrize("clash", [False, True])
def test_stages_against_plain_python(spark, tmp_path, clash):
    from tokenizers import Tokenizer

    root = str(tmp_path)
    items = corpus(spark, root, clash)
    docs = spark.read.parquet(f"{root}/documents.parquet")
    kept = []
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, root)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{root}/{name.split()[0]}")
        kept.append((docs.collect(), spark.read.parquet(f"{root}/{name.split()[0]}")))
        docs = kept[-1][1]
    (first, good), (_, single), (_, clean), (_, mixed), (_, tokens) = kept
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")

    table = spark.read.parquet(f"{root}/documents.parquet")
    model = quality.train(table, spark.read.parquet(f"{root}/labels.parquet"))
    want = [r for r in first if model.scores([r.text or ""])[0] >= 0.3]
    assert sorted(map(key, good.collect())) == sorted(map(key, want)) and len(want) < len(first)
    assert not any("###" in (r.text or "") for r in want)
    assert sum(bool(r.text) for r in want) == sum(bool(r.text) and "###" not in r.text for r in first)

    rows = sorted({key(r) for r in want})
    h = N.word_hashes([t for _, _, t in rows])
    root_of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if N.alignment_similarity(h[i], h[j], 0.8) >= 0.8:
                a, b = root_of[i], root_of[j]
                root_of = [min(a, b) if x in (a, b) else x for x in root_of]
    one = [rows[k] for k in sorted(set(root_of))]
    assert [(a, b) for a, b, _ in sorted(map(key, single.collect()))] == [(a, b) for a, b, _ in one]

    held = lambda t: any((" " + i.lower() + " ") in (" " + t.lower() + " ") for i in items)
    stay = [r for r in one if not held(r[2])]
    assert [(a, b) for a, b, _ in sorted(map(key, clean.collect()))] == [(a, b) for a, b, _ in stay] and len(stay) < len(one)

    rows = clean.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len((r.text or "").split())
    order = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(order)}
    target, still, total = {}, set(order), 1.5 * sum(size.values())
    while True:  # share by weight, and what is above twice a source's size again
        left = total - sum(target.values())
        part = {x: left * weight[x] / sum(weight[y] for y in still) for x in still}
        over = [x for x in still if part[x] > 2 * size[x]]
        if not over:
            break
        target |= {x: 2.0 * size[x] for x in over}
        still -= set(over)
    target |= part
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    times = Counter()
    for r in rows:
        rate = target[r.source] / size[r.source] if size[r.source] else 0.0
        draw = int(md5("|".join(["mix", "" if r.doc_id is None else str(r.doc_id), md5(r.text or "")]))[:13], 16) / 2**52
        times[key(r)] += int(rate) + (draw < rate % 1)
    assert Counter(map(key, mixed.collect())) == +times

    lib = Tokenizer.from_file(tokenizer())
    every = sorted(map(key, mixed.collect()), key=lambda r: (not r[0], r[1]))
    ids = {r: np.array([*lib.encode(r[2], add_special_tokens=False).ids, 2], "<u4") for r in set(every)}
    got = sorted(tokens.collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((None if r[0] else r[1], len(ids[r]), zlib.crc32(ids[r].tobytes())) for r in every)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_empty_tables(spark, tmp_path):
    corpus(spark, str(tmp_path))
    none = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
