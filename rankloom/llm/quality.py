"""Quality by compression: a dictionary of good and one of bad text, and which of them helps more."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy
from .labelled import logistic, remainder, sample, sigmoid

#: Bytes in a piece; pieces of each labelled text, spread over the whole of it, that the dictionaries are trained on.
CHUNK, PIECES = 512, 8


def _chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]


class Model:
    """Two zstandard dictionaries and the weights that turn compressed sizes into the probability of label 1.

    A text is cut into pieces of CHUNK bytes, so that its own past doesn't hide what the dictionaries know. Its features are the
    difference of the two compressed sizes over their sum, over the whole text and in its worst piece, and how far the size
    under the good dictionary falls short of a quarter of the length, whole and in the most repetitive piece: text that
    repeats itself shrinks alike under both dictionaries, so that the difference alone misses it.
    """

    LEVEL = 3

    def __init__(self, good: bytes, bad: bytes, weights: list[float]):
        self.good, self.bad, self.weights = good, bad, weights
        self._z = None

    def __getstate__(self):
        return {"good": self.good, "bad": self.bad, "weights": self.weights, "_z": None}

    def _sizes(self, pieces: list[bytes]) -> np.ndarray:
        if self._z is None:
            params = zstandard.ZstdCompressionParameters.from_level(self.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            self._z = []
            for d in (self.good, self.bad):
                d = zstandard.ZstdCompressionDict(d)  # trained ones hold match content and entropy tables, others content alone
                d.precompute_compress(level=self.LEVEL)
                self._z.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
        g, b = self._z
        return np.array([(len(g.compress(p)), len(b.compress(p)), len(p)) for p in pieces], float)

    def features(self, text: str) -> list[float]:
        s = self._sizes(_chunks(text.encode()))
        g, b, n = s.sum(0)
        each = (s[:, 0] - s[:, 1]) / (s[:, 0] + s[:, 1])
        long = s[:, 2] >= CHUNK // 4
        worst = each[long].max() if long.any() else (g - b) / (g + b)
        ratio = g / (n + 16)
        least = (s[long, 0] / (s[long, 2] + 16)).min() if long.any() else ratio
        return [(g - b) / (g + b), worst, max(0.0, 0.25 - ratio), max(0.0, 0.25 - least)]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([self.features(t) for t in texts])
        return sigmoid((x * np.array(self.weights[:-1])).sum(1) + self.weights[-1])


def _spread(pieces: list[bytes]) -> list[bytes]:
    """At most PIECES of them, the first and the last and others as far apart as can be."""
    return [pieces[i] for i in np.unique(np.linspace(0, len(pieces) - 1, PIECES).round().astype(int))]


def _dictionary(texts: list[str], size: int) -> bytes:
    """A trained dictionary, so that matches and symbol statistics count both; plain content where there is too little to train on."""
    pieces = [c for t in texts for c in _spread(_chunks(t.encode()))]
    try:
        return zstandard.train_dictionary(size, pieces, level=Model.LEVEL, threads=0).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size] or b"-"


def fit(texts: list[str], y: np.ndarray, size: int = 131_072) -> Model:
    """Dictionaries from one half of the labelled texts, the weights from the other half; without both classes, the base rate alone."""
    base = (y.sum() + 1) / (len(y) + 2)
    if len(set(y.tolist())) < 2:
        return Model(b"-", b"-", [0.0] * 4 + [float(np.log(base / (1 - base)))])
    half = np.arange(len(texts)) % 2
    half[[np.flatnonzero(y == c)[0] for c in (0, 1)]] = 0
    good, bad = (_dictionary([t for t, c, h in zip(texts, y, half, strict=True) if c == k and h == 0], size) for k in (1, 0))
    model = Model(good, bad, [])
    rest = np.flatnonzero(half) if len(set(y[half == 1].tolist())) == 2 else np.arange(len(texts))
    x = np.array([model.features(texts[i]) for i in rest])
    model.weights = logistic(x, y[rest].astype(float)).tolist()
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 3_000, longest: int = 20_000, mod: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on a sample of at most ``per_class`` documents of each class, the true rate of classes put back afterwards.

    Only rows whose crc32(id) mod ``mod`` is not ``held_out`` are learnt from. Sampled texts have at most ``longest`` code points;
    the dictionaries see PIECES pieces of each, from all over it.
    """
    learn = remainder(F.col("doc_id"), mod) != held_out
    texts, y = sample(docs, labels, label, per_class, longest, learn, doc_id, text)
    model = fit(texts, y)
    n = labels.filter(learn & F.col(label).isin(0, 1)).agg(F.count("*"), F.sum(label)).first()
    if len(texts) and 0 < y.mean() < 1 and n[1] and n[1] < n[0]:
        odds = lambda p: float(np.log(p / (1 - p)))
        model.weights[-1] += odds(n[1] / n[0]) - odds(float(y.mean()))
    return model


def score(docs: DataFrame, model: Model, threshold: float = 0.3, mod: int = 5, held_out: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Return (doc_id, held_out, score, predicted) for each row.

    Only the text is scored, whole. A null text is empty, and an empty one gets the score of its sizes like any other.
    Equal texts have equal scores. A null id stays null and counts as held out if crc32 of an empty text says so. Other
    columns are ignored; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for b in batches:
            s = shared.value.scores(b.column(2).to_pylist())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kept = docs.select(F.col(doc_id).alias("doc_id"), (remainder(F.col(doc_id), mod) == held_out).alias("held_out"), text_of(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(tidy(rows), f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns as they are. A null text scores as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def rows(batches):
        for b in batches:
            s = shared.value.scores([t or "" for t in b.column(at).to_pylist()])
            yield b.filter(pa.array(s >= threshold))

    return docs.mapInArrow(tidy(rows), docs.schema)
