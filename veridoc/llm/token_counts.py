"""Token counts by rank-synchronous merging of ragged numpy arrays.

All distinct pre-tokens of a batch lie in one array of symbols. In each round every sequence applies its
own lowest-ranked adjacent pair, at all places at once; sequences without a ranked pair are finished, and
the symbols that survive are its tokens.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, lean, remembered
from veridoc.llm.pieces import PieceMemo, joined

NO_RANK = np.int32(2**31 - 1)
#: Bytes of a pre-token beyond which it is merged by an agenda instead of in rounds.
LONG = 1000
#: Pieces that a worker remembers.
MEMO = 400_000
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand
    for themselves, the others for code points from 256 in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairTable:
    """Rank and merged id of adjacent symbol pairs, by open addressing in numpy arrays."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        size = 1 << self.BITS
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.rank = np.full(size, NO_RANK, np.int32)
        self.merged = np.zeros(size, np.int32)
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            slot = (self._slot(keys[todo]) + self.probes) % size
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            take = first[free[first]]
            self.keys[slot[take]] = keys[todo[take]]
            self.rank[slot[take]] = todo[take]
            self.merged[slot[take]] = merged[todo[take]]
            todo = np.delete(todo, take)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        rank, at = np.full(len(keys), NO_RANK, np.int32), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for probe in range(self.probes):
            where = (slot[open_] + probe) % len(self.keys)
            found = self.keys[where]
            same = found == keys[open_]
            rank[open_[same]], at[open_[same]] = self.rank[where[same]], where[same]
            open_ = open_[~same & (found != np.uint64(2**64 - 1))]
            if not len(open_):
                break
        return rank, self.merged[at]


def merge_all(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols left in each sequence when no ranked pair remains.

    A round costs the symbols that are left in sequences not yet finished, and a sequence takes as many rounds
    as it applies different merges: a few for words. Sequences beyond LONG symbols, whose rounds could be as
    many as the vocabulary's merges, go to merge_long instead."""
    left = lengths.astype(np.int64).copy()
    long = np.flatnonzero(lengths > LONG)
    seq = np.repeat(np.arange(len(lengths)), lengths)
    if len(long):
        ends = np.cumsum(lengths)
        for i in long.tolist():
            left[i] = merge_long(symbols[ends[i] - lengths[i] : ends[i]], table)
        keep = (lengths <= LONG)[seq]
        symbols, seq = symbols[keep], seq[keep]
    if len(symbols) < 2:
        return left
    last = np.append(seq[1:] != seq[:-1], True)
    rank, merged = table.find(symbols, np.append(symbols[1:], 0))
    rank[last] = NO_RANK
    while len(symbols):
        starts = np.flatnonzero(np.append(True, last[:-1]))
        best = np.minimum.reduceat(rank, starts)
        spans = np.diff(np.append(starts, len(symbols)))
        at = np.flatnonzero((rank == np.repeat(best, spans)) & (rank < NO_RANK))
        if not len(at):
            break
        fresh = np.append(True, np.diff(at) != 1)  # in a run of overlapping pairs every second one merges
        if not fresh.all():
            run = np.flatnonzero(fresh)
            order = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[order % 2 == 0]
        left -= np.bincount(seq[at], minlength=len(left))
        symbols[at] = merged[at]
        last[at] = last[at + 1]
        keep = np.repeat(best < NO_RANK, spans)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        at = place[at]
        symbols, seq, last, rank, merged = symbols[keep], seq[keep], last[keep], rank[keep], merged[keep]
        before = at[at > 0] - 1  # only pairs that a merge touched are looked up again
        todo = np.concatenate([at, before[~last[before]]])
        todo = todo[~last[todo]]
        rank[at[last[at]]] = NO_RANK
        rank[todo], merged[todo] = table.find(symbols[todo], symbols[todo + 1])
    return left


def merge_long(symbols: np.ndarray, table: PairTable) -> int:
    """Symbols left of one long sequence, by an agenda of pairs, lowest rank and leftmost first."""
    value, n = symbols.tolist(), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank, merged = table.find(symbols[:-1], symbols[1:])
    queue = [(r, i, m, value[i], value[i + 1]) for i, (r, m) in enumerate(zip(rank.tolist(), merged.tolist(), strict=True)) if r < NO_RANK]
    heapq.heapify(queue)
    known: dict[tuple[int, int], tuple[int, int]] = {}
    left = n

    def push(i: int) -> None:
        pair = (value[i], value[after[i]])
        if pair not in known:
            r, m = table.find(np.array(pair[:1]), np.array(pair[1:]))
            known[pair] = int(r[0]), int(m[0])
        r, m = known[pair]
        if r < NO_RANK:
            heapq.heappush(queue, (r, i, m, *pair))

    while queue:
        _, i, m, a, b = heapq.heappop(queue)
        j = after[i]
        if value[i] != a or j >= n or value[j] != b:
            continue  # one of the two has merged since
        value[i], value[j] = m, -1
        after[i] = after[j]
        left -= 1
        if after[i] < n:
            before[after[i]] = i
            push(i)
        if before[i] >= 0:
            push(before[i])
    return left


class MergeCounter:
    """Counts the tokens of distinct pieces under a byte-level merge vocabulary (a tokenizers .json)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = lambda xs: np.fromiter((vocab[x] for x in xs), np.int64)
        self.table = PairTable(ids(a for a, _ in pairs), ids(b for _, b in pairs), ids(a + b for a, b in pairs))
        self.byte_id = ids(byte_symbols()).astype(np.int32)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.newline = int(self.byte_id[10])

    def __call__(self, joint: list[str], alone: list[str]) -> tuple[np.ndarray, None]:
        """Tokens of pieces, the joint ones cut into pre-tokens as one text."""
        text = joined(joint)
        if self.special and self.special.search(text):
            apart = np.array([self.special.search(p) is not None for p in joint])
            some = [p for p, a in zip(joint, apart, strict=True) if a]
            found = self([p for p, a in zip(joint, apart, strict=True) if not a], some + alone)[0]
            order = np.concatenate([np.flatnonzero(~apart), np.flatnonzero(apart)])
            out = np.zeros(len(joint), np.int64)
            out[order] = found[: len(joint)]
            return np.concatenate([out, found[len(joint) :]]), None
        words, owner, extra = self.pattern.findall(text), [], np.zeros(len(alone), np.int64)
        n_words = len(words)
        for i, piece in enumerate(alone):
            parts = self.special.split(piece) if self.special else [piece]
            extra[i] = len(parts) - 1  # a special string is one token
            own = [w for part in parts for w in self.pattern.findall(part)]
            words += own
            owner += [i] * len(own)
        if not words:
            return extra, None
        raw = "".join(words).encode()
        lengths = np.fromiter(map(len, words if len(raw) == sum(map(len, words)) else map(str.encode, words)), np.int64, len(words))
        symbols = self.byte_id[np.frombuffer(raw, np.uint8)]
        firsts = symbols[np.cumsum(lengths) - lengths]
        sizes = merge_all(symbols, lengths, self.table)
        extra += np.bincount(owner, sizes[n_words:], len(alone)).astype(np.int64) if owner else 0
        # pre-tokens of joint pieces lie between newlines; a piece's own newline counts, one put before it doesn't
        breaks = np.flatnonzero((firsts[:n_words] == self.newline) & (lengths[:n_words] == 1))
        if len(breaks) != len(joint):
            raise ValueError("a newline is not a pre-token of its own")
        total = np.append(0, np.cumsum(sizes[:n_words]))
        own = np.fromiter((p[0] == "\n" for p in joint), bool, len(joint))
        return np.concatenate([np.diff(total[np.append(breaks, n_words)]) - ~own if len(joint) else own.astype(np.int64), extra]), None


@remembered
def counter(path: str) -> PieceMemo:
    return PieceMemo(MergeCounter(path), MEMO)


def count_texts(texts: list[str | None], path: str) -> list[int]:
    """Tokens of each text; null and empty texts have none."""
    count = counter(path)
    return [n for a, b in blocks(texts, 1 << 21) for n in count.counts(texts[a:b]).tolist()]


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, without special tokens of its own.

    Null texts count as empty: 0 bytes, 0 tokens. Whole texts are counted whatever their length; repeated
    rows stay; other columns are left out, so their names cannot clash; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            n_bytes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(count_texts(texts, tokenizer), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run, remembers=True), f"doc_id {kind}, n_bytes long, n_tokens long")
