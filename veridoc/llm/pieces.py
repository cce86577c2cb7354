"""Splits texts at single spaces and line ends and remembers what each distinct piece encodes to.

A byte-level vocabulary never joins a word to the space-led or newline-led word after it, so a text's ids
are those of its pieces in order. Texts are full of repeats: pieces are numbered as they come up, each new one
is encoded once, and the ids of whole texts are gathered from one pool by array operations.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_JOINT = re.compile(r"[ \n]\S+")
UNSAFE = -1


def spaced_split(text: str) -> list[str]:
    """Cuts before each single space that stands between two non-space characters."""
    return _SAFE.split(text) if text else []


class _Numbers(dict):
    """Numbers of pieces; a piece not seen before gets the next one."""

    def __init__(self, memo: PieceMemo, lead: str = "", sure: bool = False):
        super().__init__()
        self.memo, self.lead, self.sure = memo, lead, sure

    def __missing__(self, piece: str) -> int:
        memo = self.memo
        n = self[piece] = memo.count
        memo.count = n + 1
        memo.fresh.append(piece if piece[:1] == "\n" else self.lead + piece)
        if self.sure:
            memo.sure.add(n)
        return n


class PieceMemo:
    """Ids or numbers of tokens of texts, encoding only pieces not seen before.

    encode: (tokens of each piece, all their ids or None if only numbers are wanted) of two lists of pieces, the
    first of which can be made one text: each is a space or newline and characters that are no white space.
    limit, chars: pieces remembered, and their code points; beyond either only those used most stay, so that the
    memory is bounded by these and what one call brings.
    """

    def __init__(self, encode: Callable, limit: int = 1_000_000, chars: int = 1 << 25):
        self.encode, self.limit, self.chars = encode, limit, chars
        self._reset()

    def _reset(self) -> None:
        # pieces behind a space or newline; beginnings of texts; pieces of texts cut by spaced_split
        self.tail, self.whole, self.odd = _Numbers(self, " "), _Numbers(self), _Numbers(self, sure=True)
        self.sure: set[int] = set()
        self.fresh: list[str] = []
        self.count = 1  # number 0 stands for nothing
        self.sizes, self.starts, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.filled = np.zeros(1 << 14, np.uint32), 0
        self.whole[""] = self.held = 0

    def _learn(self) -> None:
        """Encodes the pieces numbered since the last call. A piece that can't be cut off safely, as white
        space ends it or follows its leading space, gets the size UNSAFE."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return
        self.held += sum(map(len, fresh))
        match = _JOINT.fullmatch
        plain = np.fromiter((match(p) is not None for p in fresh), bool, len(fresh))
        joint, single = np.flatnonzero(plain), np.flatnonzero(~plain)
        alone = [fresh[i] for i in single]
        lengths, ids = self.encode([fresh[i] for i in joint], alone)
        grow = lambda a, n: np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)]) if n > len(a) else a
        self.sizes, self.starts, self.uses = (grow(a, self.count) for a in (self.sizes, self.starts, self.uses))
        at = self.count - len(fresh) + np.concatenate([joint, single])
        self.sizes[at] = lengths
        if ids is not None:
            self.starts[at] = self.filled + np.cumsum(lengths) - lengths
            self.pool = grow(self.pool, self.filled + len(ids))
            self.pool[self.filled : self.filled + len(ids)] = ids
            self.filled += len(ids)
        for p, n in zip(alone, at[len(joint) :].tolist(), strict=True):
            if n not in self.sure and (p[-1].isspace() or p[0] in " \n" and not p[1:2].strip()):
                self.sizes[n] = UNSAFE

    def _shrink(self) -> None:
        """Goes on with the pieces used most, half of the limit at most, and what is known of them."""
        uses = self.uses[: self.count]
        half = min(max(1, self.limit // 2), len(uses))
        least = max(2, int(np.partition(uses, -half)[-half]) + 1)
        room = max(1, self.chars // (2 * half))  # longer pieces are cheap to learn again for what they hold
        often = (uses >= least).tolist()
        kept = [[(p, n) for p, n in d.items() if n and often[n] and len(p) <= room] for d in (self.tail, self.whole, self.odd)]
        sizes, starts, pool = self.sizes, self.starts, self.pool[: self.filled]
        self._reset()
        for d, pieces in zip((self.tail, self.whole, self.odd), kept, strict=True):
            first, self.count = self.count, self.count + len(pieces)
            d.update(zip((p for p, _ in pieces), range(first, self.count), strict=True))
            self.held += sum(len(p) if p[:1] == "\n" else len(d.lead) + len(p) for p, _ in pieces)
            if d.sure:
                self.sure.update(range(first, self.count))
        old = np.fromiter((n for pieces in kept for _, n in pieces), np.int64, self.count - 1)
        spare = np.zeros(1 << 12, np.int64)
        self.sizes = np.concatenate([[0], sizes[old], spare])
        self.starts, self.uses = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), np.int64)
        if len(pool):
            lengths = np.maximum(sizes[old], 0)
            ends = np.cumsum(lengths)
            self.starts[1 : self.count] = ends - lengths
            self.filled = int(lengths.sum())
            self.pool = np.concatenate([pool[np.repeat(starts[old] - ends + lengths, lengths) + np.arange(self.filled)], np.zeros(1 << 14, np.uint32)])

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of all texts in order, and how many pieces each text has."""
        if self.count > self.limit or self.held > self.chars:
            self._shrink()
        rows = [(t or "").replace("\n", " \n").split(" ") for t in texts]
        n = np.fromiter(map(len, rows), np.int64, len(rows))
        heads = np.array([self.whole[r[0]] for r in rows], np.int64)
        rest = np.fromiter(map(self.tail.__getitem__, chain.from_iterable([r[1:] for r in rows])), np.int64, int(n.sum()) - len(rows))
        first = np.cumsum(n) - n
        flat = np.insert(rest, first - np.arange(len(rows)), heads)
        self._learn()
        bad = self.sizes[flat] < 0
        if bad.any():
            parts = np.split(flat, first[1:])
            for i in np.unique(np.repeat(np.arange(len(rows)), n)[bad]).tolist():
                parts[i] = np.array([self.odd[p] for p in spaced_split(texts[i] or "")], np.int64)
                n[i] = len(parts[i])
            flat = np.concatenate(parts)
            self._learn()
        used = np.bincount(flat, minlength=self.count)
        self.uses[: len(used)] += used
        return flat, n

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        if not texts:
            return np.zeros(0, np.int64)
        flat, n = self.numbers(texts)
        total = np.append(0, np.cumsum(self.sizes[flat]))
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        flat, n = self.numbers(texts)
        lengths = self.sizes[flat]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[flat] - ends + lengths, lengths)
        at += np.arange(len(at))
        total, last = np.append(0, ends), np.cumsum(n)
        return self.pool[at], total[last] - total[last - n]


def joined(pieces: list[str]) -> str:
    """Pieces made one text, each led by a newline, which is always a token of its own."""
    return "".join([p if p[0] == "\n" else "\n" + p for p in pieces])
