"""Worker-side token ids of white-space-delimited pieces, for tokenizers that drop white space.

A tokenizer whose pre-tokenizer drops white space never joins anything across it, so the ids of a text are the ids
of its pieces, one after the other. Pieces repeat, texts hardly do: each worker keeps the ids of the pieces that it
has met and asks the library only for new ones, many in one call.
"""

from __future__ import annotations

import json
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ABOVE_LATIN = bytes(range(0xCC))  # deleting these bytes leaves something only where a code point is U+0300 or above
_COMMA, _STOP = 0x2C, 0x2E


def drops_white_space(path: str) -> bool:
    """Whether the file's pre-tokenizer keeps only what its pattern matches, and the pattern never matches white space."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in spec["added_tokens"])
    lower = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    kept = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(kept and plain and lower and "[^\\s" in first["pattern"].get("Regex", "") and not spec.get("post_processor"))


class Pieces:
    """Ids of pieces, as slices of one growing array.

    ``most`` bounds the pieces that are kept; when it is reached the cache starts anew, with those that have just come again. Pieces of over 64 bytes are
    encoded each time and never kept.
    """

    LONGEST = 64

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.marks = [c.encode() for c in added]
        self.bare = Tokenizer(self.tok.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.mark = next(iter(added), None)
        self.mark_id = added.get(self.mark)
        self.ends_word = np.zeros(self.tok.get_vocab_size(with_added_tokens=True) + 1, bool)
        for token, i in self.tok.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.starts = np.zeros(1 << 16, np.int64)
        self.lens = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.n = self.used = 0
        self.far: list[np.ndarray] = []

    def renew(self, words: list[bytes], slots: np.ndarray) -> None:
        """Start anew with those of ``words`` that are known: what comes again is worth keeping."""
        again = np.flatnonzero(slots >= 0)
        lens, flat = self.lens[slots[again]].astype(np.int64), self.ids(slots[again])
        self.clear()
        new = np.fromiter((words[i] not in self.at for i in again), bool, len(again))
        self._add([words[i] for i in again[new]], lens[new], flat[np.repeat(new, lens)])

    def split(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each piece between ASCII white space its slot, learnt where it was new, and for each text where its pieces end.
        ASCII letters are lowered first where that can't change a composition or make a special string. Overlong pieces
        are slots below 0, which count down through ``self.far``, their ids."""
        low = [t.lower() if b"<" not in t and not t.translate(None, _ABOVE_LATIN) else t for t in texts]
        lists = pc.ascii_split_whitespace(stops_apart(low))
        coded = lists.values.cast(pa.large_binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        short = pc.binary_length(coded.dictionary).to_numpy() <= self.LONGEST
        find = lambda: np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        slots = find()
        new = np.flatnonzero(short & (slots < 0))
        if len(new) and self.n + len(new) > self.most and self.n:
            self.renew(words, slots)
            slots = find()
            new = np.flatnonzero(short & (slots < 0))
        if len(new):
            self.learn([words[i] for i in new])
            slots[new] = np.fromiter((self.at[words[i]] for i in new), np.int64, len(new))
        long = np.flatnonzero(~short)
        slots[long] = -1 - np.arange(len(long))
        self.far = [self._one(words[i]) for i in long]
        return slots[coded.indices.to_numpy()], lists.offsets.to_numpy()[1:]

    def _add(self, pieces: list[bytes], lens: np.ndarray, flat: np.ndarray) -> None:
        n, used = self.n + len(pieces), self.used + len(flat)
        while n > len(self.starts):
            self.starts, self.lens = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lens))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : used] = flat
        self.lens[self.n : n] = lens
        self.starts[self.n : n] = self.used + np.cumsum(lens) - lens
        self.at.update(zip(pieces, range(self.n, n), strict=True))
        self.n, self.used = n, used

    def _one(self, piece: bytes) -> np.ndarray:
        return np.array(self.tok.encode(piece.decode(), add_special_tokens=False).ids, np.uint32)

    def _between_spaces(self, tok, words: list[bytes]) -> bool:
        """Learn ``words`` from one call in which they stand between spaces, if each is one pre-token, whose last id ends a word."""
        ids = np.array(tok.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) == len(words):
            self._add(words, np.diff(ends, prepend=-1), ids)
        return len(ends) == len(words)

    def _encode(self, pieces: list[bytes]) -> None:
        """Learn ``pieces`` from a few calls of the library. Small ASCII letters need neither its normalizer nor its pattern; other
        words of letters alone stand between spaces too; what is left stands between special strings, which it cuts out first."""
        plain = [p for p in pieces if p.isascii() and p.isalpha() and p.islower()]
        if plain and self._between_spaces(self.bare, plain):
            pieces = [p for p in pieces if p not in self.at]
        words = [p for p in pieces if (p.isalpha() if p.isascii() else not p.translate(None, _ABOVE_LATIN) and p.decode().isalpha())]
        if words and self._between_spaces(self.tok, words):
            pieces = [p for p in pieces if p not in self.at]
        if not pieces:
            return
        if self.mark is None or any(m in p for p in pieces if b"<" in p for m in self.marks):
            parts = [self._one(p) for p in pieces]
            self._add(pieces, np.array([len(x) for x in parts]), np.concatenate(parts))
            return
        ids = np.array(self.tok.encode_batch_fast([self.mark.join(p.decode() for p in pieces)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.mark_id)
        self._add(pieces, np.diff(cuts, prepend=-1, append=len(ids)) - 1, ids[ids != self.mark_id])

    def learn(self, words: list[bytes]) -> None:
        """Make ``words``, different from one another and from those known, known."""
        for i in range(0, len(words), 4096):
            self._encode(words[i : i + 4096])

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the pieces in ``slots``, one after the other."""
        if not len(slots):
            return np.zeros(0, np.uint32)
        n, flat, starts = self.counts(slots), self.flat, self.starts[slots]
        if self.far:
            flat = np.concatenate([self.flat[: self.used], *self.far])
            lens = np.array([len(x) for x in self.far])
            at = np.flatnonzero(slots < 0)
            starts[at] = (self.used + np.cumsum(lens) - lens)[-1 - slots[at]]
        ends = np.cumsum(n)
        return flat[np.arange(ends[-1]) + np.repeat(starts - ends + n, n)]

    def counts(self, slots: np.ndarray) -> np.ndarray:
        """Ids of each piece in ``slots``, as a number."""
        n = self.lens[slots].astype(np.int64)
        if self.far:
            at = np.flatnonzero(slots < 0)
            n[at] = np.array([len(x) for x in self.far])[-1 - slots[at]]
        return n


def stops_apart(texts: list[bytes]) -> pa.Array:
    """``texts`` with a blank put before each comma and full stop that ends a piece behind an ASCII letter or digit.

    They never share a pre-token with these, and words that differ only in the stop behind them need to be learnt once.
    """
    array = pa.array(texts, pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(texts) + 1)
    data = np.frombuffer(array.buffers()[2], np.uint8, int(offsets[-1])) if offsets[-1] else np.zeros(0, np.uint8)
    at = np.flatnonzero((data == _COMMA) | (data == _STOP))
    last = np.zeros(len(data) + 1, bool)
    last[offsets] = True  # a text begins here, and another ends
    at = at[~last[at]]
    before = data[at - 1]
    small = (before | 0x20) - np.uint8(0x61)
    at = at[(small < 26) | (before - np.uint8(0x30) < 10)]
    after = data[np.minimum(at + 1, len(data) - 1)] if len(data) else data
    at = at[last[at + 1] | (after == 0x20) | (after - np.uint8(9) < 5)]
    if len(at):
        data, offsets = np.insert(data, at, 0x20), offsets + np.searchsorted(at, offsets)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data)]).cast(pa.large_string())


class Whole:
    """Ids of whole texts by the library, for tokenizers whose pieces depend on the white space around them."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            self.encode = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda text: np.array(model.encode(text), np.uint32)


class Encoder:
    """Ids of texts given as UTF-8, exactly as the library gives them."""

    def __init__(self, path: str, most: int = 250_000):
        self.pieces = Pieces(path, most) if drops_white_space(path) else None
        self.whole = None if self.pieces else Whole(path)

    def batch(self, texts: list[bytes]):
        """Runs of ``texts``: the ids of all of a run, one text after the other, and how many each has."""
        if self.whole:
            for t in texts:
                ids = self.whole.encode(t.decode())
                yield ids, np.array([len(ids)])
            return
        for part in blocks(texts):
            slots, ends = self.pieces.split(part)
            sums = np.concatenate([[0], np.cumsum(self.pieces.counts(slots))])
            yield self.pieces.ids(slots), np.diff(sums[ends], prepend=0)

    def counts(self, texts: list[bytes]):
        """How many ids each text has."""
        if self.whole:
            for t in texts:
                yield len(self.whole.encode(t.decode()))
            return
        for part in blocks(texts):
            slots, ends = self.pieces.split(part)
            sums = np.concatenate([[0], np.cumsum(self.pieces.counts(slots))])
            yield from np.diff(sums[ends], prepend=0).tolist()


def blocks(texts: list[bytes], most: int = 4_000_000):
    """Runs of ``texts`` of about ``most`` bytes."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= most:
            yield part
            part, n = [], 0
    if part:
        yield part


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, most: int = 250_000) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if (path, most) not in _ENCODERS:
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
