"""Vectorised byte scans over batches of texts.

Words are runs of bytes outside 0x20 and 0x09-0x0D. No byte of a longer UTF-8
sequence lies there, so scanning bytes finds the same words as scanning code
points. Null texts count as empty.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def random_words(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTE = random_words(256, 11)
_ODD = _U(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _ODD, dtype=_U), dtype=_U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        _POWERS = np.cumprod(np.full(n, _ODD, dtype=_U), dtype=_U)
    return _POWERS


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, each followed by a newline, and the offset at which each begins."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    return data, np.concatenate([[0], np.cumsum(sizes)])


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A-Z lower-cased, and the text that each word is in."""
    data, at = joined(texts)
    if not len(data):
        return np.empty(0, _U), np.empty(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    before = np.concatenate([[True], space[:-1]])
    start = np.flatnonzero(word & before)
    if not len(start):
        return np.empty(0, _U), np.empty(0, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    body = np.flatnonzero(word)
    end = np.flatnonzero(space & ~before)
    sizes = end - start
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    within = np.arange(len(body)) - np.repeat(first, sizes)
    terms = _BYTE[low[body]] * _powers(int(sizes.max()))[within]
    h = splitmix(np.add.reduceat(terms, first) + sizes.astype(_U))
    return h, np.searchsorted(at, start, side="right") - 1


#: Characters of text that are scanned at a time; a longer text is scanned alone.
SLICE_CHARS = 1 << 20


def slices(batch, column: str = "text"):
    """Runs of rows of an Arrow batch or table with about SLICE_CHARS of text each."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    ends = np.cumsum(np.asarray(sizes.combine_chunks() if hasattr(sizes, "combine_chunks") else sizes, dtype=np.int64)) if batch.num_rows else np.empty(0, np.int64)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + SLICE_CHARS, side="right")))
        yield batch.slice(at, end - at)
        at = end


def groups(owner: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each owner's run in a sorted ``owner`` column: owner i has [b[i], b[i+1])."""
    return np.searchsorted(owner, np.arange(n + 1))
