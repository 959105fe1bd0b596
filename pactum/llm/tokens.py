"""Token ids of whole texts by a public tokenizer.

The tokenizer of the queries drops white space and encodes each piece between white
space on its own, so a text's ids are the ids of its white-space separated words in
order. Each Python worker encodes a word once and keeps the ids of at most
``CACHE_WORDS`` words and those of one run of text. Whether a tokenizer works like
that is read from its file; by any other, texts are encoded whole.

Null and empty texts, and texts of white space alone, have no ids. A long text is
taken in runs of about a million bytes that end before white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from operator import attrgetter
from string import punctuation

import numpy as np

#: Words whose ids a worker keeps, in about 100 bytes each; beyond it they are dropped and gathered anew.
CACHE_WORDS = 2_000_000

#: New words that are encoded at a time: the tokenizer takes many bytes for each one of a text.
LEARN_WORDS = 4096

#: Bytes of a text that are split at a time.
RUN_BYTES = 1 << 20

#: Bytes of texts whose words are looked up together: what is held of them stays near the core.
LOT_BYTES = 1 << 18

#: The id that ends each document.
END_ID = 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How a tokenizer's file states that it lower-cases and encodes pieces between white space.
_BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_SPACE = re.compile(rb"\s")
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\f\v"))

#: Letters that the tokenizer does no more to than lower-case them; of such a word and signs after it, it makes two pieces.
_LETTERS = re.compile(r"[a-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

_ID = attrgetter("id")

# The characters that stand for bytes in byte-level tokenizers.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = dict(zip([*_SHOWN, *sorted(set(range(256)) - set(_SHOWN))], [*_SHOWN, *range(256, 324)], strict=True))


#: Bytes of a word that its two 64-bit halves hold, with its length in the last byte.
SHORT_BYTES = 15
_LOW = np.array([(1 << 8 * min(k, 8)) - 1 for k in range(SHORT_BYTES + 1)], np.uint64)
_HIGH = np.array([(1 << 8 * max(k - 8, 0)) - 1 for k in range(SHORT_BYTES + 1)], np.uint64)


class _Halves:
    """Halves of short words -> their numbers, many at a time: an open table, less than half full."""

    def __init__(self, bits: int = 16):
        self.bits, self.n, size = bits, 0, 1 << bits
        self.low, self.high, self.number = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, -1, np.int32)

    def _place(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed += high
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Their numbers, -1 for what isn't there."""
        at = self._place(low, high)
        held = self.high.take(at)
        out = self.number.take(at)
        rest = np.flatnonzero((held != high) | (self.low.take(at) != low))
        out[rest] = -1
        rest = rest[held[rest] != 0]  # an empty place ends the search
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.high) - 1)
            held = self.high[at]
            same = (held == high[rest]) & (self.low[at] == low[rest])
            out[rest[same]] = self.number[at[same]]
            on = ~same & (held != 0)
            rest, at = rest[on], at[on]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, number: np.ndarray) -> None:
        """Take in words that differ and aren't there."""
        while 2 * (self.n + len(number)) > len(self.high):
            old = np.flatnonzero(self.high)
            low, high, number = (np.concatenate([x[old], y]) for x, y in ((self.low, low), (self.high, high), (self.number, number)))
            self.__init__(self.bits + 1)
        self.n += len(number)
        rest, at = np.arange(len(number)), self._place(low, high)
        while len(rest):
            free = self.high[at] == 0
            tried, place = rest[free], at[free]
            self.number[place] = number[tried]  # of words that try one place, the last stays
            won = self.number[place] == number[tried]
            self.low[place[won]], self.high[place[won]] = low[tried[won]], high[tried[won]]
            rest, at = np.concatenate([rest[~free], tried[~won]]), np.concatenate([at[~free], place[~won]])
            at = (at + 1) & (len(self.high) - 1)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``raw``, which begins and ends with white space, start and end.

    A stop after a letter, before white space, is a word of its own, as the tokenizer makes it a piece of its own.
    """
    byte = np.frombuffer(raw, np.uint8)
    space = _IS_SPACE.take(byte)
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    last = byte.take(end - 1)
    stop = end[(last == ord(".")) | (last == ord(","))] - 1
    before = byte.take(stop - 1)
    stop = stop[((before >= ord("a")) & (before <= ord("z"))) | ((before >= 0xA0) & (before <= 0xB6) & (byte.take(stop - 2) == 0xC3))]
    return np.sort(np.concatenate([start, stop]), kind="stable"), np.sort(np.concatenate([end, stop]), kind="stable")


def _halves(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The halves of words of at most SHORT_BYTES; 24 bytes and more follow the last start."""
    whole = np.frombuffer(raw, "<u8", len(raw) // 8)
    at, right = start >> 3, ((start & 7) << 3).view(np.uint64)
    left = np.uint64(64) - right  # a shift by 64 leaves nothing
    a, b, c = whole.take(at), whole.take(at + 1), whole.take(at + 2)
    low, high = (a >> right) | (b << left), (b >> right) | (c << left)
    return low & _LOW.take(size, mode="clip"), (high & _HIGH.take(size, mode="clip")) | (size.view(np.uint64) << np.uint64(56))


class _Grown:
    """Values that grow at the end."""

    def __init__(self, dtype: type):
        self.values, self.n = np.zeros(1 << 16, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.zeros(max(self.n, len(more)), self.values.dtype)])
        self.values[self.n : self.n + len(more)] = more
        self.n += len(more)


def _shown(piece: str) -> str:
    return piece.lower().encode().decode("latin-1").translate(_BYTE_CHARS)


class _Pieces(dict):
    """piece -> its ids, kept with the words that hold it."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, piece: str) -> list[int]:
        self[piece] = out = self.work(piece)
        return out


class WordEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        self.by_words = all(described[k] == v for k, v in _BY_WORDS.items())
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.long, self.halves, self.ids, self.ends, self.signs = {}, _Halves(), _Grown(np.uint32), _Grown(np.int64), _Pieces(self._piece)
        self.ends.append(np.zeros(1, np.int64))

    def encode(self, text: str | None) -> np.ndarray:
        """uint32 ids of the whole text, without an end id."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of whole texts one after the other, and where each text's ids end."""
        if not self.by_words:
            each = [np.array(self.tokenizer.encode(t or "", add_special_tokens=False).ids, np.uint32) for t in texts]
            return np.concatenate([np.empty(0, np.uint32), *each]), np.cumsum([len(x) for x in each], dtype=np.int64)
        out, sizes, runs, texts_of = [np.empty(0, np.uint32)], np.zeros(len(texts), np.int64), [], []
        held = 0
        for k, text in enumerate(texts):
            for run in self._runs((text or "").encode("utf-8", "surrogatepass")):
                runs.append(run)
                texts_of.append(k)
                held += len(run)
                if held > LOT_BYTES:
                    out.append(self._ids(runs, texts_of, sizes))
                    runs, texts_of, held = [], [], 0
        if runs:
            out.append(self._ids(runs, texts_of, sizes))
        return np.concatenate(out), np.cumsum(sizes)

    @staticmethod
    def _runs(raw: bytes) -> Iterator[bytes]:
        if b"<|" not in raw:  # the tokenizer lower-cases all but its special tokens
            raw = raw.lower()
        at = 0
        while at < len(raw):
            space = _SPACE.search(raw, at + RUN_BYTES) if len(raw) - at > RUN_BYTES else None
            end = space.start() if space else len(raw)
            yield raw[at:end]
            at = end

    def _ids(self, runs: list[bytes], texts_of: list[int], sizes: np.ndarray) -> np.ndarray:
        """Ids of the words of some runs; ``sizes`` of a text grows by those of its runs, whose text ``texts_of`` names."""
        raw = b" ".join([b"", *runs, b" " * 24])
        first, end = _words(raw)
        at = self._numbers(raw, first, end)
        start = self.ends.values
        n = start[at + 1] - start[at]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.ids.values[np.repeat(start[at] - total[:-1], n) + np.arange(total[-1])]
        last = np.searchsorted(first, np.cumsum([len(x) + 1 for x in runs]))
        np.add.at(sizes, texts_of, np.diff(total[last], prepend=0))
        if self.ends.n > CACHE_WORDS:
            self.clear()
        return out

    def _numbers(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of words; those that are long, or seen first, are told apart by their bytes."""
        size = end - start
        low, high = _halves(raw, start, size)
        at = self.halves.find(low, high)
        at[size > SHORT_BYTES] = -1
        other = np.flatnonzero(at < 0)
        words = [raw[a:b] for a, b in zip(start[other].tolist(), end[other].tolist(), strict=True)]
        number = {w: self.long.get(w) for w in words}
        new = [w for w, n in number.items() if n is None]
        number.update(zip(new, range(self.ends.n - 1, self.ends.n - 1 + len(new)), strict=True))
        self.long.update((w, number[w]) for w in new if len(w) > SHORT_BYTES)
        at[other] = [number[w] for w in words]
        for k in range(0, len(new), LEARN_WORDS):
            self._learn([w.decode("utf-8", "replace") for w in new[k : k + LEARN_WORDS]])
        short = other[size[other] <= SHORT_BYTES]
        number, first = np.unique(at[short], return_index=True)
        self.halves.add(low[short[first]], high[short[first]], number)
        return at

    def _learn(self, new: list[str]) -> None:
        """Encode new words: letters and the signs after them as the pieces that they are, all others as one text."""
        parts = [w.rstrip(punctuation) for w in new]
        pieces = [(x.isalpha() and x.islower()) if x.isascii() else _LETTERS.fullmatch(x) is not None for x in parts]
        others = iter(self._together([w for w, fits in zip(new, pieces, strict=True) if not fits]))
        ids, ends, tokenize = [], [], self.model.tokenize
        for w, letters, fits in zip(new, parts, pieces, strict=True):
            if not fits:
                ids += next(others)
            else:
                ids += map(_ID, tokenize(letters if letters.isascii() else _shown(letters)))
                if len(letters) < len(w):
                    ids += self.signs[w[len(letters) :]]
            ends.append(len(ids))
        self.ends.append(self.ids.n + np.array(ends, np.int64))
        self.ids.append(np.array(ids, np.uint32))

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _together(self, new: list[str]) -> list[list[int]]:
        """The ids of each of some words, encoded as one text; a token belongs to the word that its offset lies in."""
        if not new:
            return []
        got = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
        ids, last = got.ids, np.cumsum([len(w) + 1 for w in new])
        start = np.fromiter((o[0] for o in got.offsets), dtype=np.int64, count=len(ids))
        ends = np.searchsorted(start, last).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
