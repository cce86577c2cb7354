"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Items are placed in descending order, each into the open bin that it
fills best; where none fits, a bin is opened at the length that costs least for each token it is expected to
hold, judged by filling it with what is still to be placed. Finally each bin shrinks to the smallest permitted
length that holds its contents.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import stored

#: What a sequence of c tokens costs: its place in a batch, its tokens, and attention over their pairs.
BIN_COST, ATTENTION = 16, 32_768
#: Documents that are packed together; a few thousand fill bins as well as any number.
GROUP_ROWS = 4096


class _Multiset:
    """Values up to a bound with the largest at most x and the least at least x, by a bit set."""

    def __init__(self):
        self.bits, self.held = 0, {}

    def add(self, value: int, item) -> None:
        self.bits |= 1 << value
        self.held.setdefault(value, []).append(item)

    def pop(self, value: int):
        items = self.held[value]
        item = items.pop()
        if not items:
            self.bits &= ~(1 << value)
        return item

    def at_most(self, x: int) -> int:
        return (self.bits & ((1 << (x + 1)) - 1)).bit_length() - 1

    def at_least(self, x: int) -> int:
        rest = self.bits >> x
        return x + (rest & -rest).bit_length() - 1 if rest else -1


def _projected(counts: np.ndarray, bits: int, size: int, capacity: int) -> int:
    """Tokens that a bin of this capacity would hold, opened for an item and filled with the largest that
    fit of the items still to be placed."""
    used, taken = size, {}
    while used < capacity:
        v = (bits & ((1 << (capacity - used + 1)) - 1)).bit_length() - 1
        while v > 0 and counts[v] <= taken.get(v, 0):
            v = (bits & ((1 << v) - 1)).bit_length() - 1
        if v <= 0:
            break
        take = min(int(counts[v]) - taken.get(v, 0), (capacity - used) // v)
        used += take * v
        taken[v] = taken.get(v, 0) + take
    return used


def pack(lengths: list[int], capacities: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(item, piece, tokens, bin, offset, bin length) of every piece.

    An item beyond the largest capacity is cut into pieces that fill such bins, and a rest; an item of
    length 0 has one piece of 0 tokens."""
    capacities = sorted(capacities)
    largest = capacities[-1]
    out, pieces, bins = [], [], 0
    for i, n in enumerate(lengths):
        full, rest = divmod(n, largest)
        for k in range(full):
            out.append((i, k, largest, bins, 0, largest))
            bins += 1
        if rest or not full:
            pieces.append((rest, i, full))
    pieces.sort(key=lambda p: (-p[0], p[1]))
    counts = np.bincount([p[0] for p in pieces], minlength=largest + 1) if pieces else np.zeros(largest + 1, np.int64)
    bits = sum(1 << int(v) for v in np.flatnonzero(counts) if v)
    room = _Multiset()
    used: dict[int, int] = {}
    placed: list[tuple[int, int, int, int, int]] = []
    for size, item, piece in pieces:
        if size:
            counts[size] -= 1
            if not counts[size]:
                bits &= ~(1 << size)
        best = room.at_least(size)
        if best < 0:
            options = [c for c in capacities if c >= size]
            capacity = min(options, key=lambda c: (_price(counts, bits, size, c, capacities), c))
            target, left, used[bins] = bins, capacity, 0
            bins += 1
        else:
            target, left = room.pop(best), best
        placed.append((item, piece, size, target, used[target]))
        used[target] += size
        room.add(left - size, target)
    shrunk = {b: next(c for c in capacities if c >= n) for b, n in used.items()}
    return out + [(*p, shrunk[p[3]]) for p in placed]


def _price(counts: np.ndarray, bits: int, size: int, capacity: int, capacities: list[int]) -> float:
    held = max(1, _projected(counts, bits, size, capacity))
    length = next(c for c in capacities if c >= held)
    return (BIN_COST + length + length * length / ATTENTION) / held


PACKED = "piece int, piece_start long, piece_tokens int, bin_id string, bin_offset int, bin_length int"


def pack_documents(docs: DataFrame, length_col: str = "n_tokens", capacities: tuple[int, ...] = (512, 1024, 2048, 4096), id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, PACKED's columns): a row for each piece of each document.

    Ids and lengths are written to the shared folder first, so lengths are counted once and a repeated task deals
    the same rows the same way. They are dealt at random (by a hash of id, length and place in that table) to
    groups of about ``group_rows``, so the size of a group is bounded whatever ids repeat, and each group is packed
    by itself. Null and negative lengths count as 0; rows with equal ids and null ids stay rows of their own; ties
    are packed by ascending id; other columns are left out; an empty table gives no rows.
    """
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), F.greatest(F.coalesce(F.col(length_col), F.lit(0)), F.lit(0)).cast("long").alias("n")), "lengths")
    groups = max(1, math.ceil(rows.count() / group_rows))
    rows = rows.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "n", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    largest, allowed = max(capacities), list(capacities)

    def run(part: pa.Table) -> pa.Table:
        # ids stay Arrow values: pandas would turn whole numbers beside a null into floats
        part = part.sort_by([("n", "descending"), ("doc_id", "ascending")])
        group = part.column("pack_group")[0].as_py()
        item, piece, n, b, at, size = (list(x) for x in zip(*pack(part.column("n").to_pylist(), allowed), strict=True))
        columns = (piece, [p * largest for p in piece], n, [f"{group}-{x}" for x in b], at, size)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        names = ["piece", "piece_start", "piece_tokens", "bin_id", "bin_offset", "bin_length"]
        return pa.table([part.column("doc_id").take(pa.array(item)), *map(pa.array, columns, kinds)], ["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("pack_group").applyInArrow(run, f"doc_id {kind}, {PACKED}")
