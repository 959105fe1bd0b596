"""Adaptive context-mixing range coder for token ids, many blocks in step.

Each block is coded on its own: its models and its range coder begin afresh, and
its CRC-32 is kept beside it. Blocks of a segment are the lanes of NumPy vectors,
so one step codes the next id of all blocks at once.

An id is predicted by the id that last followed the two ids before it (order 2)
or, if these are new, by the one that last followed the id before it (order 1).
The chance that the prediction holds is a logistic mix of an adaptive estimate, by the
order and confidence of the prediction and by whether order 1 agrees with it, and of
the predicted id's frequency (order 0); the weights are learned as coding goes. An id
that is not predicted is coded by order 0. These frequencies, counted over the segment
and rounded to quarter powers of two, stand once before its blocks: a block of a few
thousand ids is too short to learn them.
All arithmetic is on integers, so the decoder repeats the encoder exactly.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

#: Ids in a block. Each block can be decoded without any other.
BLOCK_IDS = 2048

#: Most blocks that are coded in step; those of a longer segment are taken in lots of about one size.
LANES = 4096

#: Ids lie below this; the number itself stands for no id.
MOST_ID = _NONE = 65535
_TOP, _BOT, _MASK = 1 << 46, 1 << 38, (1 << 62) - 1
_STRETCH = np.array([round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], dtype=np.int32)
_SQUASH = np.array([min(4095, max(1, round(4096 / (1 + math.exp(-x / 256))))) for x in range(-2047, 2048)], dtype=np.int32)
_SLOTS = 2048

#: Order-0 frequencies of a segment add up to 1 << _UNIT.
_UNIT = 18


class Frequencies:
    """Order-0 chances of the ids of a segment, in units of 1 / (1 << _UNIT)."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray):
        weight = np.array([16, 19, 23, 27], np.int64)[classes & 3] << (classes >> 2).astype(np.int64)
        size = 1 + weight * ((1 << _UNIT) - len(ids)) // max(1, int(weight.sum()))
        if len(ids):
            size[size.argmax()] += (1 << _UNIT) - size.sum()
        self.ids, self.classes = ids, classes
        self.size, self.start = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.size[ids], self.start[ids] = size, np.cumsum(size) - size
        self.span = (self.start << 20) | self.size
        self.id_at = np.repeat(ids, size).astype(np.int32)
        self.stretched = _STRETCH[np.minimum(self.size >> (_UNIT - 12), 4095)]

    @classmethod
    def of(cls, ids: np.ndarray) -> Frequencies:
        count = np.bincount(ids, minlength=1)
        found = np.flatnonzero(count)
        steps = np.array([w << k for k in range(40) for w in (16, 19, 23, 27)], np.int64)
        return cls(found, (np.searchsorted(steps, count[found] * 16, side="right") - 1).astype(np.uint8))

    def to_bytes(self) -> bytes:
        return zlib.compress(np.diff(self.ids, prepend=0).astype("<u2").tobytes() + self.classes.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        raw = zlib.decompress(data)
        n = len(raw) // 3
        return cls(np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64)), np.frombuffer(raw, np.uint8, n, 2 * n))


class _Coder:
    """Ranges of all lanes: ``low`` and ``range`` within 62 bits, moved on 16 bits at a time.

    After a settling a range has 38 bits at least, enough for one flag and one id.
    """

    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.int64)
        self.range = np.full(lanes, _MASK, np.int64)

    def settle(self) -> None:
        """Move on what is settled: all lanes at once, then the few that have more than 16 bits to move."""
        low, size = self.low, self.range
        same = (low ^ (low + size)) < _TOP
        thin = size < _BOT
        go = same | thin
        if np.count_nonzero(thin > same):
            cut = np.flatnonzero(thin > same)
            size[cut] = -low[cut] & (_BOT - 1)
        by = go.astype(np.int64)
        shift = by << 4
        self._move_all(low, by, shift)
        low <<= shift
        low &= _MASK
        size <<= shift
        lane = np.flatnonzero(go & (size < _TOP))
        while len(lane):
            low, size = self.low[lane], self.range[lane]
            same = (low ^ (low + size)) < _TOP
            go = same | (size < _BOT)
            lane, low, size, same = lane[go], low[go], size[go], same[go]
            self._move(lane, low)
            size = np.where(same, size, -low & (_BOT - 1)) << 16
            self.low[lane] = (low << 16) & _MASK
            self.range[lane] = size
            lane = lane[size < _TOP]

    def _take(self, hit: np.ndarray, one: np.ndarray, part: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """A lane that hits keeps the range ``one``; any other an id's place in what is left of it.

        By bits: a choice for each lane that no processor foresees costs more than both results.
        """
        lost = hit.astype(np.int64)
        lost -= 1
        low = part * start
        low += one
        low &= lost
        self.low += low
        size = part * size
        size ^= one
        size &= lost
        size ^= one
        self.range = size


class Encoder(_Coder):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.room = room
        self.out = np.zeros(lanes * room, np.uint16)
        self.at = np.arange(lanes) * room

    def _move(self, lane: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lane]
        self.out[at] = low >> 46
        self.at[lane] = at + 1

    def _move_all(self, low: np.ndarray, by: np.ndarray, shift: np.ndarray) -> None:
        self.out[self.at] = low >> 46  # what doesn't go is written over later
        self.at += by

    def code(self, p16: np.ndarray, hit: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Code whether the prediction holds and, where it doesn't, the id at ``start`` of order 0."""
        one = (self.range >> 16) * p16
        self._take(hit, one, (self.range - one) >> _UNIT, start, size)

    def finish(self) -> list[bytes]:
        for shift in (46, 30, 14):
            self.out[self.at] = (self.low >> shift) & 0xFFFF
            self.at += 1
        self.out[self.at] = (self.low << 2) & 0xFFFF
        self.at += 1
        raw = self.out.astype("<u2")
        return [raw[k * self.room : n].tobytes() for k, n in enumerate(self.at)]


class Decoder(_Coder):
    def __init__(self, payload: list[bytes]):
        super().__init__(len(payload))
        sizes = np.array([len(p) // 2 for p in payload]) + 8
        data = np.frombuffer(b"".join(p + bytes(16) for p in payload), "<u2")
        at = np.cumsum(sizes) - sizes
        # 62 bits are 3 words and 14 bits; the last two bits of a word go with the next
        self.data = np.append(np.uint16(0), (data[:-1] & 3) << 14) | (data >> 2)
        first = data.astype(np.int64)
        self.code_at = (first[at] << 46) | (first[at + 1] << 30) | (first[at + 2] << 14) | (first[at + 3] >> 2)
        self.at = at + 4

    def _move(self, lane: np.ndarray, low: np.ndarray) -> None:
        at = self.at[lane]
        self.code_at[lane] = ((self.code_at[lane] << 16) & _MASK) | self.data[at]
        self.at[lane] = at + 1

    def _move_all(self, low: np.ndarray, by: np.ndarray, shift: np.ndarray) -> None:
        more = self.data.take(self.at, mode="clip").astype(np.int64)
        more *= by
        self.code_at <<= shift
        self.code_at &= _MASK
        self.code_at |= more
        self.at += by

    def code(self, p16: np.ndarray, guess: np.ndarray, order0: Frequencies) -> tuple[np.ndarray, np.ndarray]:
        """Whether the prediction held, and the id."""
        one = (self.range >> 16) * p16
        part = (self.range - one) >> _UNIT
        left = self.code_at - self.low - one
        hit = left < 0
        # where the prediction held, what is left is below 0 and the id found is of no use
        got = order0.id_at.take((left.view(np.uint64) // part.view(np.uint64)).view(np.int64), mode="clip")
        span = order0.span.take(got, mode="clip")
        self._take(hit, one, part, span >> 20, span & 0xFFFFF)
        return hit, _either(hit, guess, got)


def _either(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a`` where ``first`` holds, else ``b``, of 32 bits, by bits."""
    out = a ^ b
    out &= -first.astype(np.int32)
    out ^= b
    return out


#: Steps for which an encoder works out together what depends on the ids alone.
_AHEAD = 8


def _slots(a: np.ndarray, b: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the id that followed ``a``, and that which followed ``b`` and ``a``, are kept; of the 16-bit hashes the upper 11 bits count."""
    a, b = a.astype(np.uint16), b.astype(np.uint16)
    one = a * np.uint16(40503)
    two = one + b * np.uint16(26544)
    return _places(one >> 5, lane), _places(two >> 5, lane)


def _places(row: np.ndarray, lane: np.ndarray) -> np.ndarray:
    at = row.astype(np.int64)
    at *= len(lane)
    at += lane
    return at


def _run(coder: Encoder | Decoder, order0: Frequencies, lanes: int, steps: int, ids: np.ndarray | None) -> np.ndarray | None:
    """Code ``steps`` ids of each lane; ``ids`` [lane, step] when encoding, else they are returned as [step, lane].

    Two steps of id 0 stand before the first.
    """
    out = np.zeros((steps + 2, lanes), np.int32) if ids is None else None
    lane = np.arange(lanes)
    next2 = np.full(_SLOTS * lanes, _NONE << 4, np.int32)  # what last followed, and how often in a row
    next1 = np.full(_SLOTS * lanes, _NONE << 4, np.int32)
    chance = np.full(64 * lanes, 1 << 15, np.int32)  # by confidence, order and agreement of the prediction
    w_chance, w_zero = (np.full(lanes, w, np.int32) for w in (52_000, 14_000))
    for t in range(steps):
        if ids is None:
            at1, at2 = _slots(out[t + 1], out[t], lane)
        else:
            k = t % _AHEAD
            if not k:
                before = ahead[-2:] if t else np.zeros((2, lanes), np.int32)
                ahead = np.concatenate([before, ids[:, t : t + _AHEAD].T])
                all1, all2 = _slots(ahead[1:-1], ahead[:-2], lane)
                starts, sizes = order0.start.take(ahead[2:], mode="clip"), order0.size.take(ahead[2:], mode="clip")
            at1, at2 = all1[k], all2[k]
        e1, e2 = next1[at1], next2[at2]
        g1, g2 = e1 >> 4, e2 >> 4
        no2 = g2 == _NONE
        pick = _either(no2, e1, e2)
        guess = pick >> 4
        at_c = _places((pick & 15).astype(np.int8) | (no2.view(np.int8) << 4) | ((g1 == guess).view(np.int8) << 5), lane)
        pc = chance[at_c]
        sc, sz = _STRETCH.take(pc >> 4, mode="clip"), order0.stretched.take(guess, mode="clip")
        p = _SQUASH.take(((w_chance * sc + w_zero * sz) >> 16) + 2047, mode="clip")
        if ids is None:
            hit, now = coder.code(p << 4, guess, order0)
            out[t + 2] = now
        else:
            now = ahead[k + 2]
            hit = now == guess
            coder.code(p << 4, hit, starts[k], sizes[k])
        coder.settle()
        held = hit.astype(np.int32)
        err = ((held << 12) - p) * np.int32(6)
        w_chance += (sc * err + 0x8000) >> 16
        w_zero += (sz * err + 0x8000) >> 16
        chance[at_c] = pc + ((held * np.int32(65535) - pc) >> 5)
        coded = now << 4
        next1[at1] = coded | np.minimum((e1 & 15) + 1, 15) * (g1 == now)
        next2[at2] = coded | np.minimum((e2 & 15) + 1, 15) * (g2 == now)
    return None if out is None else out[2:]


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> tuple[bytes, list[bytes], list[int]]:
    """Order-0 frequencies, coded blocks of ``ids`` (below 65,535) and the CRC-32 of each block's ids."""
    if not len(ids):
        return b"", [], []
    if int(ids.max()) >= _NONE:
        raise ValueError(f"ids from {_NONE} on have no code")
    blocks = -(-len(ids) // block_ids)
    steps = min(block_ids, len(ids))
    # a last block that is short is filled up with its own first id
    grid = np.full(blocks * steps, ids[(blocks - 1) * block_ids], np.int32)
    grid[: len(ids)] = ids
    order0, out = Frequencies.of(ids), []
    for part in np.array_split(grid.reshape(blocks, steps), -(-blocks // LANES)):
        coder = Encoder(len(part), 2 * steps + 16)
        _run(coder, order0, len(part), steps, part)
        out += coder.finish()
    raw = ids.astype("<u4")
    return order0.to_bytes(), out, [zlib.crc32(raw[a : a + block_ids].tobytes()) for a in range(0, len(ids), block_ids)]


def decode(order0: bytes, payload: list[bytes], crcs: list[int], n_ids: int, block_ids: int = BLOCK_IDS) -> np.ndarray:
    """The ids again; a block whose checksum differs is an error."""
    if not payload:
        return np.empty(0, np.uint32)
    steps = min(block_ids, n_ids)
    frequencies, n_lots = Frequencies.from_bytes(order0), -(-len(payload) // LANES)
    lots = [payload[len(payload) * k // n_lots : len(payload) * (k + 1) // n_lots] for k in range(n_lots)]
    ids = np.concatenate([_run(Decoder(lot), frequencies, len(lot), steps, None).T.ravel() for lot in lots])[:n_ids].astype("<u4")
    for k, crc in enumerate(crcs):
        if zlib.crc32(ids[k * block_ids : (k + 1) * block_ids].tobytes()) != crc:
            raise ValueError(f"block {k}: checksum differs")
    return ids
