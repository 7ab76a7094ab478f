"""Secret scans: fixed patterns, and password guess costs for values where a credential is being given.

The cost of a value is the base-10 logarithm of the guesses that an attacker needs who tries words, dates, repeats, keyboard
walks and then brute force: the cheapest segmentation of the value into such spans, found by dynamic programming. Values in
a credential context that cost much are secrets, whatever they look like; placeholders and common passwords cost little,
and so do the words of a language, whose order of frequency a public tokenizer's vocabulary gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Where a value of a credential follows: a wider context and wider values than the fixed pattern's.
_CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pass|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|authorization|bearer|credentials?|login|pin)["']?\x20*(?:[:=]|=>|\bis\b)\x20*["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)
_MARKS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "login", "pin")

#: Words that people choose, most frequent first.
WORDS = (
    "password", "admin", "welcome", "letmein", "monkey", "dragon", "master", "login", "princess", "football", "baseball", "shadow", "sunshine", "superman",
    "batman", "secret", "trustno", "hello", "freedom", "whatever", "changeme", "default", "guest", "root", "user", "test", "example", "sample", "demo",
    "pass", "passwd", "token", "key", "private", "public", "access", "server", "system", "computer", "internet", "summer", "winter", "spring", "autumn",
    "monday", "friday", "sunday", "january", "march", "april", "june", "july", "august", "october", "december", "love", "money", "happy", "lucky", "star",
    "angel", "flower", "cookie", "pepper", "ginger", "orange", "banana", "apple", "cherry", "purple", "yellow", "green", "black", "white", "silver",
    "golden", "tiger", "eagle", "falcon", "phoenix", "hunter", "ranger", "soccer", "hockey", "tennis", "michael", "jordan", "robert", "daniel", "thomas",
    "charlie", "george", "andrew", "jessica", "ashley", "nicole", "the", "and", "you", "for", "none", "null", "true", "false", "your", "here", "string",
)
#: The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_LEET = str.maketrans("013457$@", "oleastsa")
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(chr(c), chr(c + 1)) for c in [*range(97, 122), *range(48, 57)]} | {(chr(c + 1), chr(c)) for c in [*range(97, 122), *range(48, 57)]}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d")


class Words:
    """What words cost: WORDS first, then the whole words of a tokenizer's vocabulary, in its order, which is about that of frequency."""

    LONGEST = 24

    def __init__(self, path: str | None = None):
        every = dict.fromkeys(WORDS)
        if path:
            with open(path, encoding="utf-8") as f:
                vocabulary = json.load(f)["model"]["vocab"]
            whole = (t.removesuffix("</w>") for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if t.endswith("</w>"))
            every |= dict.fromkeys(w for w in whole if 3 <= len(w) <= self.LONGEST and w.isascii() and w.isalpha())
        self.cost = {w: 0.301 + math.log10(k + 1) for k, w in enumerate(every)}
        self.longest = max(map(len, self.cost))


_KEPT: dict[str | None, Words] = {}


def words_at(path: str | None) -> Words:
    """One list for each worker process and vocabulary."""
    if path not in _KEPT:
        _KEPT[path] = Words(path)
    return _KEPT[path]


def _class_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33)


def _repeats(value: str, size: int) -> np.ndarray:
    """For each position, where the repeats of the block of ``size`` characters there end."""
    a = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.arange(len(a), dtype=np.int32)
    if len(a) <= size:
        return at + size
    differs = np.append(a[:-size] != a[size:], np.ones(size, bool))
    first = np.minimum.accumulate(np.where(differs, at, len(a))[::-1])[::-1]  # the next position that differs from the one a block on
    return at + ((first - at) // size + 1) * size


def guess_cost(value: str, enough: float = math.inf, words: Words | None = None) -> tuple[float, list[tuple[str, str]]]:
    """(log10 of guesses, the cheapest segmentation as (kind, span)), or (``enough``, []) if it costs that much or more.

    A span of brute force costs each character's class; others cost a digit for their kind and their rank, length or
    position. Every further span costs a factor of 2. Spans other than brute force start at each position, words of up to
    the longest word's length, walks from where they begin, and repeats as far as they go, which is known beforehand, so that
    the time grows with the value's length alone. Positions that cost ``enough`` lead nowhere.
    """
    words = words or words_at(None)
    n, low = len(value), value.lower() if value.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    # Two states for each position, as going on with a brute-force span is free of the factor: 0 after any other span, 1 after brute force
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: dict[tuple[int, int], tuple[int, int, str]] = {}
    dates = {m.start(): m.end() for m in _DATE.finditer(value)}
    ends = {size: _repeats(value, size) for size in (1, 2, 3, 4)} if n else {}
    todo, waiting = [0], {0}

    def put(i: int, state: int, j: int, cost: float, kind: str) -> None:
        to = (j, int(kind == "brute"))
        if cost < min(best.get(to, enough), enough):
            if j not in waiting:
                waiting.add(j)
                heapq.heappush(todo, j)
            best[to], back[to] = cost, (i, state, kind)

    while todo:
        i = heapq.heappop(todo)
        if i == n:
            break
        after = [(best[i, s], s) for s in (0, 1) if (i, s) in best]
        least, state = min(after)
        here = least + (0.301 if i else 0.0)
        c = _class_cost(value[i])
        put(i, state, i + 1, here + c, "brute")
        if (i, 1) in best:
            put(i, 1, i + 1, best[i, 1] + c, "brute")
        for j in range(i + 3, min(n, i + words.longest) + 1):
            for s, leet in ((low[i:j], 0.0), (plain[i:j], 0.301)):
                if s in words.cost:
                    upper = sum(ch.isupper() for ch in value[i:j])
                    put(i, state, j, here + words.cost[s] + leet + (0.301 * min(upper, j - i - upper + 1)), "word")
                    break
        if i in dates:
            put(i, state, dates[i], here + 1.0 + (2.1 if dates[i] - i == 4 else 4.6), "date")
        for size, end in ends.items():
            j, shortest = int(end[i]), 3 if size == 1 else 2 * size
            if j >= i + shortest and (size > 1 or i == 0 or value[i - 1] != value[i]):
                put(i, state, j, here + sum(map(_class_cost, value[i : i + size])) + math.log10((j - i) // size), "repeat")
        if i == 0 or (low[i - 1], low[i]) not in _NEXT:
            j = i + 1
            while j < n and (low[j - 1], low[j]) in _NEXT:
                j += 1
            if j - i >= 3:
                put(i, state, j, here + 1.0 + math.log10(40) + math.log10(j - i), "walk")
    last = [(best[n, s], s) for s in (0, 1) if (n, s) in best]
    if not last:
        return (enough, []) if n else (0.0, [])
    cost, state = min(last)
    spans, at = [], (n, state)
    while at in back:
        i, state, kind = back[at]
        if kind == "brute" and spans and spans[-1][0] == "brute":
            spans[-1] = ("brute", value[i : at[0]] + spans[-1][1])
        else:
            spans.append((kind, value[i : at[0]]))
        at = (i, state)
    return cost, spans[::-1]


def find_base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(m in low for m in ("passw", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def find_guessed(text: str, least: float = 10.0, shortest: int = 8, words: Words | None = None) -> list[tuple[int, int, str]]:
    """(start, end, "guess") of values in a credential context that cost 10 ** ``least`` guesses or more."""
    low = text.lower()
    if not any(m in low for m in _MARKS) or not any(m in low for m in (":", "=", "is")):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(".)]}!?")
        if len(value) >= shortest and guess_cost(value, least, words)[0] >= least:
            out.append((m.start(1), m.start(1) + len(value), "guess"))
    return out


def spans_of(text: str, least: float = 10.0, words: Words | None = None) -> tuple[list, list]:
    """(base spans, all spans), each in order of start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(find_base(text), key=order)
    return base, sorted(base + find_guessed(text, least, words=words), key=order)


def scan(docs: DataFrame, least: float = 10.0, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_guess for each row.

    Spans are kind:start:end in code points of the whole match, or of the value for ``guess``, ends exclusive,
    comma-joined. ``vocabulary`` names a tokenizers ``.json`` file that every worker can open, whose words count as words. A
    null text is empty and has none; equal texts have equal results; a null id stays null; other columns are ignored; an
    empty table gives none.
    """

    def rows(batches):
        words = words_at(vocabulary)
        for b in batches:
            out = [[] for _ in range(6)]
            for t in b.column(1).to_pylist():
                base, every = spans_of(t, least, words)
                for k, kind in enumerate(("assign", "access", "hex")):
                    out[k].append(sum(s[2] == kind for s in base))
                text_form = lambda spans: ",".join(f"{k}:{a}:{e}" for a, e, k in spans)
                out[3].append(hashlib.sha256(text_form(base).encode()).hexdigest())
                out[4].append(text_form(every))
                out[5].append(len(every) - len(base))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([b.column(0), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(tidy(rows), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(text: str, spans: list, mark: str = "[secret]") -> str:
    """``text`` with the union of ``spans`` replaced by ``mark``."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, e, _ in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(e, merged[-1][1])
        else:
            merged.append([a, e])
    for a, e in merged:
        out += [text[at:a], mark]
        at = e
    return "".join([*out, text[at:]])
