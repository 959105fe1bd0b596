"""Texts as lists of pieces, so that an edit costs what it changes.

A text is cut into pieces of bounded size. Where a place lies is found from the pieces'
lengths and line counts; an edit takes apart the pieces at its two ends, and only those.
The text is joined once, when it is asked for. A store of pieces may be kept elsewhere (a
state of a stream): pieces are then read when an edit touches them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Characters of a piece at most when a text is cut; small neighbours are joined below half of it.
PIECE_CHARS = 4096


class Pieces:
    """A text in pieces.

    ``names``, ``chars`` and ``lines`` say for each piece in order its name, its characters
    and its newlines. ``read`` gives the text of a piece that is not held yet. ``changed``
    and ``gone`` gather what a store has to write and remove.
    """

    def __init__(self, names=(), chars=(), lines=(), read: Callable[[int], str] | None = None, next_name: int = 0, size: int = PIECE_CHARS):
        self.names, self.chars, self.lines = list(names), np.array(chars, np.int64), np.array(lines, np.int64)
        self.read, self.next_name, self.size = read, next_name, size
        self.held: dict[int, str] = {}
        self.changed: set[int] = set()
        self.gone: set[int] = set()

    def piece(self, i: int) -> str:
        name = self.names[i]
        if name not in self.held:
            self.held[name] = self.read(name)
        return self.held[name]

    def text(self) -> str:
        return "".join(self.piece(i) for i in range(len(self.names)))

    def _put(self, first: int, last: int, text: str) -> None:
        """Pieces first..last (exclusive) are replaced by ``text``, cut anew."""
        parts = [text[k : k + self.size] for k in range(0, len(text), self.size)]
        for name in self.names[first:last]:
            self.held.pop(name, None)
            self.changed.discard(name)
            self.gone.add(name)
        new = list(range(self.next_name, self.next_name + len(parts)))
        self.next_name += len(parts)
        self.held.update(zip(new, parts, strict=True))
        self.changed.update(new)
        self.names[first:last] = new
        self.chars = np.concatenate([self.chars[:first], np.array([len(p) for p in parts], np.int64), self.chars[last:]])
        self.lines = np.concatenate([self.lines[:first], np.array([p.count("\n") for p in parts], np.int64), self.lines[last:]])

    def replace(self, text: str) -> None:
        """The whole text becomes ``text``."""
        self._put(0, len(self.names), text)

    def _place(self, line: int, col: int) -> tuple[int, int]:
        """Piece and offset of a place; places beyond a line or the text fall on its end."""
        line, col = max(0, line), max(0, col)
        ends = np.cumsum(self.lines)
        if line == 0:
            i, at = 0, 0
        elif not len(ends) or ends[-1] < line:
            return len(self.names), 0
        else:
            # after the newline that begins the line
            i = int(np.searchsorted(ends, line))
            piece, at = self.piece(i), 0
            for _ in range(int(line - (ends[i] - self.lines[i]))):
                at = piece.index("\n", at) + 1
        while i < len(self.names):
            piece = self.piece(i)
            end = piece.find("\n", at)
            within = (len(piece) if end < 0 else end) - at
            if col <= within and (end >= 0 or col < within or i == len(self.names) - 1):
                return i, at + col
            if end >= 0:
                return i, end
            i, at, col = i + 1, 0, col - within
        return len(self.names), 0

    def splice(self, start: tuple[int, int], end: tuple[int, int], text: str) -> None:
        """The characters between two places become ``text``; an end before the start counts as the start."""
        first, a = self._place(*start)
        last, b = max((first, a), self._place(*end))
        head = self.piece(first)[:a] if first < len(self.names) else ""
        tail = self.piece(last)[b:] if last < len(self.names) else ""
        last = min(last + 1, len(self.names))
        text = head + text + tail
        # a short neighbour is taken in, so that pieces stay few
        if first and len(text) + self.chars[first - 1] < self.size // 2:
            first -= 1
            text = self.piece(first) + text
        self._put(first, max(first, last), text)
