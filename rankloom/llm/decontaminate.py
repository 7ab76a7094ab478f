"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A fixed mask over a few token positions names those that must be equal; the others may differ. Hashes of the masked tokens
at every position of the benchmark's items make a small table; those of the documents at every position are looked up in
it. Around each hit the two texts are laid side by side, and the stretch with the most equal tokens among those that are
equal in a given share says how much of the item the document holds, substitutions included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, free, small, stored, text_of

#: 1: the token must be equal; 0: it may be any. All start and end with 1 and are as long.
MASKS = ("110101011", "111001101", "101110011")
SPAN = len(MASKS[0])
TOKEN = r"[\p{L}\p{N}]+"


def token_hashes(text: str) -> Column:
    """Hashes of the lower-cased runs of letters and digits of a text."""
    return F.transform(F.regexp_extract_all(F.lower(text_of(text)), F.lit(TOKEN), F.lit(0)), lambda x: F.xxhash64(x))


def _seed(k: int, tokens: str, at: Column) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(F.col(tokens), at + F.lit(o)) for o, m in enumerate(MASKS[k]) if m == "1"])


def benchmark_items(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The benchmark's items by key, with their token hashes."""
    items = bench.select(F.col(item_id).alias("item_id"), F.xxhash64(F.col(item_id), text_of(text)).alias("item"), token_hashes(text).alias("bh"))
    return items.filter(F.size("bh") > 0).dropDuplicates(["item"])


def item_seeds(items: DataFrame) -> DataFrame:
    """For each mask k and position j the hash h, the one a position before, and those of the masks before k at j."""
    at = items.filter(F.size("bh") >= SPAN).select("item", "bh", F.explode(F.sequence(F.lit(0), F.size("bh") - SPAN)).alias("j"))
    seed = lambda k: _seed(k, "bh", F.col("j"))
    each = [F.struct(F.lit(k).alias("k"), seed(k).alias("h"), F.when(F.col("j") > 0, _seed(k, "bh", F.col("j") - 1)).alias("before"), F.array(*map(seed, range(k))).cast("array<bigint>").alias("others")) for k in range(len(MASKS))]
    return at.select("item", "j", F.explode(F.array(*each)).alias("s")).select("item", "j", "s.*")


def _stretch(doc: str, item: str, shift: Column, share: float) -> Column:
    """The stretch of ``item`` laid on ``doc`` at ``shift`` with the most equal tokens among all that have ``share`` of them: struct(matches, less, at), less being minus its length.

    A stretch begins where tokens are equal. A beginning is worth keeping only if fewer tokens are missing before it than
    before all earlier ones; of those kept, the earliest that has the share up to a token gives the most equal ones.
    """
    low, high = F.greatest(F.lit(0), -shift), F.least(F.size(item), F.size(doc) - shift) - 1
    kind = "struct<m:int,begins:array<struct<m:int,k:int>>,best:struct<matches:int,less:int,at:int>>"
    zero = F.lit(0)
    start = F.struct(zero.alias("m"), F.array().alias("begins"), F.struct(zero.alias("matches"), zero.alias("less"), zero.alias("at")).alias("best")).cast(kind)

    def step(s, k):
        same = F.get(F.col(item), k) == F.get(F.col(doc), k + shift)
        last = F.get(s["begins"], F.size(s["begins"]) - 1)
        new = (F.size(s["begins"]) == 0) | (s["m"] - k * share < last["m"] - last["k"] * share)
        begins = F.when(new, F.concat(s["begins"], F.array(F.struct(s["m"].alias("m"), k.alias("k"))))).otherwise(s["begins"])
        m = s["m"] + 1
        enough = F.slice(F.filter(begins, lambda r: m - r["m"] >= (k + 1 - r["k"]) * share), 1, 1)
        ends = F.transform(enough, lambda r: F.struct((m - r["m"]).alias("matches"), (r["k"] - k - 1).alias("less"), r["k"].alias("at")))
        found = F.struct(m.alias("m"), begins.alias("begins"), F.array_max(F.concat(F.array(s["best"]), ends)).alias("best"))
        return F.when(same, found.cast(kind)).otherwise(s)

    return F.aggregate(F.sequence(low, high), start, step, lambda s: s["best"])


def _short_overlaps(d: DataFrame, items: DataFrame, lengths: list[int], block_rows: int) -> list[DataFrame]:
    """Where documents hold all tokens of an item too short for a seed, in a row: one lookup for each length that there is."""
    out = []
    for n in lengths:
        gram = lambda tokens, at, n=n: F.xxhash64(F.lit(n), *[F.get(F.col(tokens), at + F.lit(o)) for o in range(n)])
        own = stored(items.filter(F.size("bh") == n).select("item_id", gram("bh", F.lit(0)).alias("h")), "bench-short")
        grams = F.when(F.size("dh") >= n, F.transform(F.sequence(F.lit(0), F.size("dh") - n), lambda i: gram("dh", i)))
        at = d.select("doc_id", "text_hash", F.posexplode(grams).alias("doc_start", "dhash"))
        blocks = max(1, -(-own.count() // block_rows))
        for b in range(blocks):
            hit = at.join(F.broadcast(own.filter(F.pmod("h", F.lit(blocks)) == b)), F.col("dhash") == F.col("h"))
            out.append(hit.select("doc_id", "text_hash", "item_id", F.lit(n).alias("matches"), F.lit(n).alias("length"), "doc_start", F.lit(n).alias("item_tokens")))
    return out


def overlaps(docs: DataFrame, bench: DataFrame, at_least: int = 13, share: float = 0.8, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and item that overlap: doc_id, text_hash, item_id, matched, length, item_tokens, doc_start.

    An overlap counts if it has ``at_least`` equal tokens, or ``share`` of a shorter item's, and equal tokens make up
    ``share`` of its length; an item of under 9 tokens counts where all of them stand in a row. Tokens are lower-cased runs of
    letters and digits. The benchmark's items are broadcast, with their seeds, in blocks of about ``block_rows`` seeds (an
    item stays whole), one pass over the documents each, so any benchmark fits. A run of hits along one diagonal is verified
    once, at its first, whatever masks it hits. Items and documents without tokens, null and empty texts among them, overlap
    with nothing. A null id stays null; rows that repeat id and text give one row; empty tables give none. Other columns are
    ignored.
    """
    items = stored(benchmark_items(bench, item_id, text), "bench")
    tokens = F.size("bh")
    sizes = items.agg(F.sum(F.when(tokens >= SPAN, (tokens - SPAN + 1) * len(MASKS))).alias("n"), F.array_sort(F.collect_set(F.when(tokens < SPAN, tokens))).alias("short")).first()
    seeds = stored(item_seeds(items), "bench-seeds")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text_of(text)).alias("text_hash"), token_hashes(text).alias("dh"))
    starts = F.when(F.size("dh") >= SPAN, F.sequence(F.lit(0), F.size("dh") - SPAN))  # no filter above: it would hash all tokens twice
    at = d.select("doc_id", "text_hash", "dh", F.explode(starts).alias("i"))
    at = at.select("*", F.explode(F.array(*[_seed(k, "dh", F.col("i")) for k in range(len(MASKS))])).alias("dhash"))
    back = F.col("i") - 1
    before = F.when(F.col("k") == 0, _seed(0, "dh", back))
    for k in range(1, len(MASKS)):
        before = before.when(F.col("k") == k, _seed(k, "dh", back))
    first = F.col("before").isNull() | (F.col("i") == 0) | (before != F.col("before"))  # of its mask's hits along the diagonal
    for k in range(len(MASKS) - 1):  # and no mask before it hits there too
        first &= (F.col("k") <= k) | (_seed(k, "dh", F.col("i")) != F.get("others", F.lit(k)))
    columns = ["doc_id", "text_hash", "item_id", "matches", "length", "doc_start", "item_tokens"]
    parts = []
    blocks = max(1, -(-(sizes.n or 0) // block_rows))
    for b in range(blocks):
        mine = F.pmod("item", F.lit(blocks)) == b
        hit = at.join(F.broadcast(seeds.filter(mine)), (F.col("dhash") == F.col("h")) & first).select("doc_id", "text_hash", "dh", "item", (F.col("i") - F.col("j")).alias("shift"))
        laid = hit.join(F.broadcast(items.filter(mine)), "item")
        laid = laid.select("doc_id", "text_hash", "item_id", "shift", tokens.alias("item_tokens"), _stretch("dh", "bh", F.col("shift"), share).alias("s"))
        need = F.least(F.lit(at_least), F.ceil(F.col("item_tokens") * F.lit(share)).cast("int"))
        laid = laid.filter((F.col("s.matches") >= need) & (F.col("s.matches") >= -F.col("s.less") * F.lit(share)))
        parts.append(laid.select("doc_id", "text_hash", "item_id", "s.matches", (-F.col("s.less")).alias("length"), (F.col("shift") + F.col("s.at")).alias("doc_start"), "item_tokens"))
    found = None
    for p in [*parts, *_short_overlaps(d, items, sizes.short, block_rows)]:
        p = p.select(columns)
        found = p if found is None else found.union(p)
    best = F.max(F.struct("matches", "length", "doc_start", "item_tokens")).alias("b")
    found = found.groupBy("doc_id", "text_hash", "item_id").agg(best)
    return found.select("doc_id", "text_hash", "item_id", F.col("b.matches").alias("matched"), F.col("b.length").alias("length"), F.col("b.item_tokens").alias("item_tokens"), F.col("b.doc_start").alias("doc_start"))


def contaminated(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """One row for each contaminated document: doc_id, n_items, item_ids (ascending), and its longest overlap's figures."""
    best = F.max(F.struct("matched", "length", "item_tokens", "item_id", "doc_start")).alias("b")
    rows = overlaps(docs, bench, **how).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), best)
    return rows.select("doc_id", "n_items", "item_ids", F.col("b.item_id").alias("best_item_id"), F.col("b.matched").cast("long").alias("matched"), F.col("b.length").cast("long").alias("length"), F.col("b.item_tokens").cast("long").alias("item_tokens"), F.col("b.doc_start").cast("long").alias("doc_start"))


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no item overlaps, with all their columns; others stay as they are."""
    d, h = free(docs, "d"), free(docs, "h")
    bad = stored(overlaps(docs, bench, doc_id=doc_id, text=text, **how).select(F.col("doc_id").alias(d), F.col("text_hash").alias(h)).distinct(), "contaminated")
    return docs.join(small(bad), F.col(doc_id).eqNullSafe(F.col(d)) & (F.xxhash64(text_of(text)) == F.col(h)), "left_anti")
