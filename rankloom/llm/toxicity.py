"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input has a word part and a character part. Both hash into tables (the word itself, and its character 3- to
5-grams with marks at its ends) that hold how strongly a bucket speaks for a label (a smoothed log-odds ratio over its
standard error) and a few learnt numbers. The network reads windows of 32 words, each 16 after the one before, so that
any 16 words on end stand in one; attention pools a window's states into one logit. Labels belong to whole documents, so each epoch
learns from the highest window of each document, and from another one of those without the label. While the network learns
from one fold of the labelled texts, the odds come from the others, so that it meets them as they are on new texts. A document's score is
its highest window's logit, calibrated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy
from .labelled import logistic, remainder, sample, sigmoid

WINDOW, STRIDE, FOLDS = 32, 16, 4
#: Texts of each label from which on the tables of buckets learn too.
LEARNABLE = 200
#: Windows, and words, that are worked on at once: always as many, so that no sum's order depends on what else there is.
AT_ONCE, WORDS_AT_ONCE = 1_024, 4_096
BUCKETS, LEARNT, HIDDEN, ATTEND = 1 << 16, 4, 8, 8
INPUT = 3 + 2 * LEARNT
_EDGE = bytes(range(0x21, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x7F))


def words_of(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, which one stands at each place, where each text ends): lower-cased, without punctuation at their ends."""
    lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.large_string()))
    coded = lists.values.cast(pa.large_binary()).dictionary_encode()
    raw = coded.dictionary.to_pylist()
    place: dict[bytes, int] = {}
    to = np.array([place.setdefault(w.strip(_EDGE) or w, len(place)) for w in raw], np.int64)
    return list(place), to[coded.indices.to_numpy()] if len(raw) else np.zeros(0, np.int64), lists.offsets.to_numpy()[1:]


def buckets_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each word's bucket, the buckets of all its character n-grams, where each word's n-grams begin)."""
    own = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % BUCKETS
    marked = [b"<" + (w or b"_") + b">" for w in words]  # splitting leaves an empty word at a blank end
    raw = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    ends = np.cumsum(size)
    word = np.repeat(np.arange(len(words)), size)
    left = ends[word] - np.arange(len(raw))  # bytes from here to the word's end
    grams, owners = [], []
    with np.errstate(over="ignore"):
        for n in (3, 4, 5):
            if len(raw) < n:
                continue
            h = np.zeros(len(raw) - n + 1, np.uint64)
            for i in range(n):
                h = (h + raw[i : i + len(h)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ok = left[: len(h)] >= n
            grams.append(((h + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64)[ok])
            owners.append(word[: len(h)][ok])
    g, o = np.concatenate(grams), np.concatenate(owners)  # every marked word has three bytes, so one n-gram at least
    order = np.argsort(o, kind="stable")
    return own, g[order], np.searchsorted(o[order], np.arange(len(words)))


def windows_of(n: int) -> np.ndarray:
    """Where windows begin in a text of ``n`` words: every 16 words, up to the one that reaches the end."""
    return np.arange(0, max(1, -(-(n - WINDOW) // STRIDE) + 1) * STRIDE, STRIDE) if n > WINDOW else np.zeros(1, np.int64)


def laid_out(at: np.ndarray, pad: int) -> np.ndarray:
    """The windows of a text as rows of word numbers, ``pad`` where it has ended."""
    begins = windows_of(len(at))
    rows = begins[:, None] + np.arange(WINDOW)
    out = np.full(rows.shape, pad, np.int64)
    inside = rows < len(at)
    out[inside] = at[rows[inside]]
    return out


class Net:
    """The network's weights. Directions are stacked along the first axis: 0 reads forward, 1 backward."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.3 / np.sqrt(s[-2] if len(s) > 1 else 1)).astype(np.float32)
        self.odds_word, self.odds_gram = np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
        self.p = {
            "word": np.zeros((BUCKETS, LEARNT), np.float32),
            "gram": np.zeros((BUCKETS, LEARNT), np.float32),
            "w": small(2, INPUT, 3 * HIDDEN),
            "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "u": small(2, HIDDEN, 3 * HIDDEN),
            "a": small(2 * HIDDEN, ATTEND),
            "v": small(ATTEND, 1),
            "o": small(2 * HIDDEN, 1),
            "c": np.zeros(1, np.float32),
        }
        self.calibration = np.array([1.0, 0.0, 0.0])

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """The input vectors of words, and the buckets that they came from."""
        own, grams, first = buckets_of(words)
        count = np.diff(np.append(first, len(grams)))
        odds = self.odds_gram[grams]
        mean = np.add.reduceat(self.p["gram"][grams], first) / count[:, None]
        x = np.column_stack([self.odds_word[own], np.maximum.reduceat(odds, first), np.add.reduceat(odds, first) / count, self.p["word"][own], mean])
        return x.astype(np.float32), (own, grams, first, count)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Inputs times the gates' input weights, for each direction."""
        out = np.empty((2, len(x), 3 * HIDDEN), np.float32)
        for i in range(0, len(x), WORDS_AT_ONCE):
            part = x[i : i + WORDS_AT_ONCE]
            out[:, i : i + len(part)] = (_filled(part, WORDS_AT_ONCE, 0) @ self.p["w"] + self.p["b"])[:, : len(part)]
        return out

    def forward(self, proj: np.ndarray, rows: np.ndarray, keep: bool = False):
        """Logits of windows ``rows`` of word numbers; a number beyond the words is padding. proj: (2, words, gates)."""
        n, h = len(rows), np.zeros((2, len(rows), HIDDEN), np.float32)
        mask = rows < proj.shape[1]
        safe = np.where(mask, rows, 0)
        states = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        tape = []
        u, k = self.p["u"], HIDDEN
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            m = np.stack([mask[:, t], mask[:, back]])[:, :, None]
            g = np.stack([proj[0, safe[:, t]], proj[1, safe[:, back]]])
            hu = h @ u
            zr = 1 / (1 + np.exp(-(g[:, :, : 2 * k] + hu[:, :, : 2 * k])))
            z, r = zr[:, :, :k], zr[:, :, k:]
            c = np.tanh(g[:, :, 2 * k :] + r * hu[:, :, 2 * k :])
            new = np.where(m, c + z * (h - c), h)
            if keep:
                tape.append((h, z, r, c, hu[:, :, 2 * k :], m))
            h = new
            states[t, :, :k], states[back, :, k:] = h[0], h[1]
        e = np.tanh(states @ self.p["a"])
        s = np.where(mask.T, (e @ self.p["v"])[:, :, 0], -1e9)
        s = np.exp(s - s.max(0))
        s = s / s.sum(0)
        pooled = (s[:, :, None] * states).sum(0)
        logit = (pooled @ self.p["o"])[:, 0] + self.p["c"]
        return (logit, (tape, states, e, s, pooled, mask, safe)) if keep else logit

    def backward(self, dlogit: np.ndarray, saved, words: int) -> dict[str, np.ndarray]:
        """Gradients of all weights, and of the projected inputs as ``proj``."""
        tape, states, e, s, pooled, mask, safe = saved
        k = HIDDEN
        g = {"o": pooled.T @ dlogit[:, None], "c": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["o"].T
        ds = (dpool[None] * states).sum(-1)
        dscore = s * (ds - (s * ds).sum(0))
        g["v"] = np.einsum("tnk,tn->k", e, dscore)[:, None]
        de = dscore[:, :, None] * self.p["v"][:, 0] * (1 - e * e)
        g["a"] = np.einsum("tni,tnj->ij", states, de)
        dstates = s[:, :, None] * dpool[None] + de @ self.p["a"].T
        du, dproj = np.zeros_like(self.p["u"]), np.zeros((2, words, 3 * k), np.float32)
        dh = np.zeros((2, len(dlogit), k), np.float32)
        for t in reversed(range(WINDOW)):
            back = WINDOW - 1 - t
            dh = dh + np.stack([dstates[t, :, :k], dstates[back, :, k:]])
            h, z, r, c, hc, m = tape[t]
            live = dh * m
            dc = live * (1 - z) * (1 - c * c)
            dz = live * (h - c) * z * (1 - z)
            dr = dc * hc * r * (1 - r)
            gates = np.concatenate([dz, dr, dc], axis=2)
            hidden = np.concatenate([dz, dr, dc * r], axis=2)
            du += h.transpose(0, 2, 1) @ hidden
            for d, col in ((0, t), (1, back)):
                np.add.at(dproj[d], safe[:, col], gates[d] * mask[:, col, None])
            dh = np.where(m, live * z, dh) + hidden @ self.p["u"].transpose(0, 2, 1)
        return g | {"u": du, "proj": dproj}


def _odds(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-odds of a bucket's documents over its standard error, squashed to -2 .. 2. counts: (2, buckets), by label."""
    c = counts + (totals / max(1, totals.sum()))[:, None]  # shared out by label, so that what was never seen says nothing
    log = np.log(c[1] / max(1, totals[1])) - np.log(c[0] / max(1, totals[0]))
    return (2 * np.tanh(log / np.sqrt(1 / c[0] + 1 / c[1]) / 4)).astype(np.float32)


def _odds_of(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The odds of word buckets and of n-gram buckets, from the texts of each label that have them."""
    words, at, ends = words_of(texts)
    own, grams, first = buckets_of(words)
    last = np.append(first[1:], len(grams))
    by_word, by_gram = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for a, label in zip(np.split(at, ends[:-1]), y, strict=True):
        d = np.unique(a)
        by_word[label, np.unique(own[d])] += 1
        if len(d):
            by_gram[label, np.unique(np.concatenate([grams[first[i] : last[i]] for i in d]))] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()])
    return _odds(by_word, totals), _odds(by_gram, totals)


def fit(texts: list[str], y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 0.006, seed: int = 7) -> Net:
    """Train on labelled texts. Without both labels the net stays as it began, and its calibration is the base rate.

    With fewer than ``LEARNABLE`` texts of a label the learnt numbers of buckets stay 0, as they would remember those texts instead of
    learning from them, and the rest learns in smaller steps more often.
    """
    net = Net(seed)
    few = min((y == 0).sum(), (y == 1).sum()) < LEARNABLE
    if few:
        epochs, batch = 3 * epochs, batch // 8
    base = (float(y.sum()) + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        net.calibration = np.array([0.0, 0.0, np.log(base / (1 - base))])
        return net
    fold = np.arange(len(y)) % FOLDS
    if any(len(set(y[fold != f].tolist())) < 2 for f in range(FOLDS)):
        fold[:] = 0
    parts = []
    for f in np.unique(fold):
        mine = np.flatnonzero(fold == f)
        others = np.flatnonzero(fold != f) if fold.any() else mine
        words, at, ends = words_of([texts[i] for i in mine])
        rows = [laid_out(a, len(words)) for a in np.split(at, ends[:-1])]
        begin = np.cumsum([0, *map(len, rows)])
        doc_of = np.repeat(np.arange(len(rows)), np.diff(begin))
        parts.append((_odds_of([texts[i] for i in others], y[others]), words, np.concatenate(rows), begin, doc_of, y[mine]))
    rng = np.random.default_rng(seed)
    adam = _Adam(net, rate, ("word", "gram") if few else ())
    for _ in range(epochs):
        for f in rng.permutation(len(parts)):
            _epoch(net, adam, parts[f], rng, batch)
    best, sizes, labels = [], [], []
    for odds, words, rows, begin, _, own in parts:
        net.odds_word, net.odds_gram = odds
        best.append(np.maximum.reduceat(_scored(net, net.projected(net.inputs(words)[0]), rows), begin[:-1]))
        sizes.append(np.diff(begin))
        labels.append(own)
    net.calibration = logistic(np.column_stack([np.concatenate(best), np.log(np.concatenate(sizes))]), np.concatenate(labels).astype(float))
    net.odds_word, net.odds_gram = _odds_of(texts, y)
    return net


class _Adam:
    """Adam steps; the learnt tables shrink a little with each."""

    def __init__(self, net: Net, rate: float, frozen: tuple[str, ...] = ()):
        self.net, self.rate, self.n, self.frozen = net, rate, 0, frozen
        self.moments = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in net.p.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.n += 1
        for name, grad in grads.items():
            if name in self.frozen:
                continue
            m, v = self.moments[name]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            fall = self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.99**self.n)) + 1e-6)
            self.net.p[name] -= fall.astype(np.float32)
            if name in ("word", "gram"):
                self.net.p[name] *= 0.999


def _epoch(net: Net, adam: _Adam, part: tuple, rng, batch: int) -> None:
    """Learn once from the windows of one fold, with the odds of the others."""
    (net.odds_word, net.odds_gram), words, rows, begin, doc_of, y = part
    logits = _scored(net, net.projected(net.inputs(words)[0]), rows)
    top = np.lexsort((logits, doc_of))[begin[1:] - 1]  # the highest window of each document
    other = np.array([rng.integers(a, b) for a, b in zip(begin[:-1], begin[1:], strict=True)], np.int64)[y == 0]
    pick = np.concatenate([top, other])
    target = np.concatenate([y, np.zeros(len(other), y.dtype)]).astype(np.float32)
    weight = np.where(target > 0, 0.5 / max(1, target.sum()), 0.5 / max(1, (target == 0).sum())).astype(np.float32) * len(pick)
    order = rng.permutation(len(pick))
    for i in range(0, len(order), batch):
        j = order[i : i + batch]
        mine, inverse = np.unique(rows[pick[j]], return_inverse=True)
        real = mine[mine < len(words)]
        if not len(real):
            continue
        x, (own, grams, _, count) = net.inputs([words[k] for k in real])
        logit, saved = net.forward(net.projected(x), inverse.reshape(len(j), WINDOW), keep=True)
        g = net.backward(((1 / (1 + np.exp(-logit)) - target[j]) * weight[j] / len(j)).astype(np.float32), saved, len(real))
        dproj = g.pop("proj")
        g["w"], g["b"] = x.T[None] @ dproj, dproj.sum(1, keepdims=True)
        dx = (dproj @ net.p["w"].transpose(0, 2, 1)).sum(0)
        g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(g["word"], own, dx[:, 3 : 3 + LEARNT])
        np.add.at(g["gram"], grams, np.repeat(dx[:, 3 + LEARNT :] / count[:, None], count, axis=0))
        adam.step(g)


def _filled(rows: np.ndarray, n: int, blank) -> np.ndarray:
    """``rows`` with blank ones behind, ``n`` in all."""
    return rows if len(rows) == n else np.concatenate([rows, np.full((n - len(rows), *rows.shape[1:]), blank, rows.dtype)])


def _scored(net: Net, proj: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of windows, AT_ONCE at a time."""
    pad = proj.shape[1]
    return np.concatenate([net.forward(proj, _filled(rows[i : i + AT_ONCE], AT_ONCE, pad)) for i in range(0, len(rows), AT_ONCE)])[: len(rows)]


class Scorer:
    """A net with a bounded cache of words' projected inputs, for one worker."""

    def __init__(self, net: Net, most: int = 200_000):
        self.net, self.most = net, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.proj = np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)

    def _rows_of(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.at]
        if len(self.at) + len(new) > self.most:
            self.clear()
            new = words
        if new:
            n = len(self.at)
            while n + len(new) > self.proj.shape[1]:
                self.proj = np.concatenate([self.proj, np.zeros_like(self.proj)], axis=1)
            for i in range(0, len(new), 20_000):
                part = new[i : i + 20_000]
                self.proj[:, n + i : n + i + len(part)] = self.net.projected(self.net.inputs(part)[0])
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts, some megabytes at a time; a text of more goes alone."""
        out, part, size = [], [], 0
        for t in texts:
            part.append(t)
            size += len(t)
            if size > 2_000_000:
                out.append(self._some(part))
                part, size = [], 0
        if part:
            out.append(self._some(part))
        return np.concatenate(out) if out else np.zeros(0)

    def _some(self, texts: list[str]) -> np.ndarray:
        words, at, ends = words_of(texts)
        slots = self._rows_of(words)[at] if len(words) else np.zeros(0, np.int64)
        pad = self.proj.shape[1]
        rows = [laid_out(a, pad) for a in np.split(slots, ends[:-1])]
        begin = np.cumsum([0, *map(len, rows)])
        best = np.maximum.reduceat(_scored(self.net, self.proj, np.concatenate(rows)), begin[:-1])
        of_best, of_size, base = self.net.calibration
        return sigmoid(best.astype(float) * of_best + np.log(np.diff(begin)) * of_size + base)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2_500, longest: int = 12_000, mod: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> Net:
    """Fit on a sample of at most ``per_class`` documents of each label, then put the labels' true rate back.

    Rows whose label or id is null or whose text is missing aren't learnt from; an id with both labels counts as 1. Without both labels the
    score is the base rate."""
    learn = remainder(F.col("doc_id"), mod) != held_out
    texts, y = sample(docs, labels, label, per_class, longest, learn, doc_id, text)
    net = fit(texts, y)
    n = labels.filter(learn & F.col(label).isin(0, 1)).agg(F.count("*"), F.sum(label)).first()
    if len(texts) and 0 < y.mean() < 1 and n[1] and n[1] < n[0]:
        odds = lambda p: float(np.log(p / (1 - p)))
        net.calibration[-1] += odds(n[1] / n[0]) - odds(float(y.mean()))
    return net


def score(docs: DataFrame, net: Net, threshold: float = 0.3, mod: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return (doc_id, held_out, score, predicted) for each row.

    Only the text is scored, all its windows. A null text is empty, and an empty one is one window of padding. Equal texts have
    equal scores, whatever else there is. A null id stays null and counts as empty text for ``held_out``; repeated rows are scored each.
    Other columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(batches):
        own = Scorer(shared.value)
        for b in batches:
            s = own.scores(b.column(2).to_pylist()).round(5)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), (remainder(F.col(doc_id), mod) == held_out).alias("held_out"), text_of(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(tidy(rows), f"doc_id {kind}, held_out boolean, score double, predicted int")
