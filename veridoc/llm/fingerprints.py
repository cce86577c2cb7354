"""Document fingerprints by locally consistent parsing.

Each level collapses runs of one symbol, labels every symbol by deterministic coin tossing against its left
neighbour (which shrinks the labels to a handful), cuts phrases at local maxima of the labels, and names
each phrase by a hash of its symbols. A cut depends on a few symbols around it only, so equal substrings get
the same phrases inside, wherever they stand. The fingerprint is a one-permutation min-hash sketch of the
phrase names of levels 2 and 3; likeness estimates the Jaccard similarity of two documents' phrase sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import NO_ID, blocks, compressed, mix, range_bounds, unpacked

BINS = 128
EMPTY = 0xFFFF
LEVELS = 3
#: Code points in one numpy pass: its arrays stay in a core's cache.
PASS_CHARS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """2 x the lowest bit in which a label differs from its left neighbour, plus that bit of its own, as
    8-bit numbers."""
    other = np.empty_like(label)
    other[1:] = label[:-1]
    other[first] = ~label[first]
    differ = label ^ other
    low = differ & (~differ + label.dtype.type(1))
    bit = np.bitwise_count(low - label.dtype.type(1))
    return bit + bit + ((label & low) != 0)


def _phrases(names: np.ndarray, sizes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Names of the next level's phrases and their number by document; every document has a symbol at least."""
    n = len(names)
    first = np.cumsum(sizes) - sizes
    begins = np.zeros(n, bool)
    begins[first] = True
    change = begins.copy()
    change[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(change)
    symbol = names if len(at) == n else names[at]
    begins = begins[at]
    first = np.flatnonzero(begins)
    label = _toss(_toss(_toss(symbol, first), first), first)
    cut = np.empty(len(label), bool)
    cut[0] = True
    cut[1:] = label[1:] > label[:-1]
    cut[:-1] &= label[:-1] > label[1:]
    cut[np.append(first[1:], len(label)) - 1] = False
    cut[first] = True
    start = np.flatnonzero(cut)
    length = np.diff(np.append(start, len(symbol)))
    powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
    value = symbol.astype(np.uint64)
    if len(at) < n:
        value += (np.diff(np.append(at, n)) - 1).astype(np.uint64) * _STEP  # a run is named by its symbol and length
    joined = np.add.reduceat((value + np.uint64(1)) * powers[np.arange(len(symbol)) - np.repeat(start, length)], start)
    counts = np.diff(np.searchsorted(start, np.append(first, len(symbol))))
    return mix(joined + np.uint64(level)), counts


def sketches(texts: list[str | None]) -> np.ndarray:
    """A row of BINS 16-bit values for each text; empty and null texts have EMPTY throughout."""
    out = np.full((len(texts), BINS), EMPTY, np.uint16)
    for lo, hi in blocks(texts, PASS_CHARS):
        some = [i for i in range(lo, hi) if texts[i]]
        if not some:
            continue
        names = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), "<u4")
        sizes = np.array([len(texts[i]) for i in some])
        owner, found = [], []
        for level in range(1, LEVELS + 1):
            names, sizes = _phrases(names, sizes, level)
            if level > 1:
                owner.append(np.repeat(some, sizes))
                found.append(names)
        names, owner = np.concatenate(found), np.concatenate(owner)
        slot = owner * BINS + (names & np.uint64(BINS - 1)).astype(np.int64)
        order = np.argsort(names)[::-1]  # the smallest name of a slot is written last
        out.ravel()[slot[order]] = np.minimum((names[order] >> np.uint64(8)) & np.uint64(0xFFFF), EMPTY - 1)
    return out


def as_text(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins among those that either row fills; 1 for two empty rows."""
    used = (a != EMPTY) | (b != EMPTY)
    filled = used.sum(axis=1)
    return np.where(filled == 0, 1.0, ((a == b) & used).sum(axis=1) / np.maximum(filled, 1))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row.

    Null and empty texts have the fingerprint of all-empty bins; long texts are parsed whole; repeated rows
    stay; other columns are left out, so their names cannot clash; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = pa.array([len(t or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), sizes, pa.array(as_text(sketches(texts)), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (its second half replaced by the start of the next
    document's, by ascending id, the first following the last) and how like they are.

    Null texts count as empty. Ranges of ids are dealt to tasks; the first document of each range also goes
    to the range before it, so no task needs more than its own rows. Ids must be whole numbers above -2^63; rows
    with equal ids follow each other by their compressed text; null ids come first, and stay null. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = range_bounds(rows, "doc_id", n)
    limits = np.array(bounds, np.int64)
    numbers = lambda column: column.fill_null(NO_ID).to_numpy(zero_copy_only=False)

    def least(batches):
        for b in batches:
            keys = numbers(b.column(0))
            part = np.searchsorted(limits, keys)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(keys, pa.int64())], ["part", "key"])

    # one row for each range: its first id
    firsts = sorted(map(tuple, rows.select("doc_id").mapInArrow(least, "part int, key long").groupBy("part").agg(F.min("key")).collect()))
    if not firsts:
        return spark.createDataFrame([], EDITED)
    opening = np.array([k for _, k in firsts], np.int64)
    before = np.array([firsts[i - 1][0] for i in range(len(firsts))], np.int32)

    def deal(batches):
        for b in batches:
            keys, blobs = numbers(b.column("doc_id")), pa.array(compressed(b.column("text").to_pylist()), pa.binary())
            at = np.minimum(np.searchsorted(opening, keys), len(opening) - 1)
            also = np.flatnonzero(opening[at] == keys)
            part = np.concatenate([np.searchsorted(limits, keys).astype(np.int32), before[at[also]]])
            rows_ = np.concatenate([np.arange(len(keys)), also])
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.arange(len(rows_)) >= len(keys)), pa.array(keys[rows_]), blobs.take(pa.array(rows_))], ["part", "extra", "key", "blob"])

    dealt = rows.mapInArrow(deal, "part int, extra boolean, key long, blob binary")
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("extra", "key", "blob")

    def run(batches):
        held: tuple | None = None
        done = False
        for b in batches:
            keys, extra, blobs = b.column("key").to_pylist(), b.column("extra").to_pylist(), b.column("blob")
            for lo in range(0, len(keys), 256):
                texts = [t or "" for t in unpacked(blobs.slice(lo, 256).to_pylist())]
                names, ends = keys[lo : lo + 256], extra[lo : lo + 256]
                marks = sketches(texts)
                if held:
                    names, texts, ends, marks = [held[0], *names], [held[1], *texts], [False, *ends], np.vstack([held[2][None], marks])
                stop = next((i for i, e in enumerate(ends) if e), len(names) - 1)
                if not done and stop:
                    yield _edited(names, texts, marks, stop)
                done = done or ends[stop]
                held = None if done else (names[-1], texts[-1], marks[-1])

    return dealt.select("key", "extra", "blob").mapInArrow(run, EDITED)


def _edited(names: list, texts: list[str], marks: np.ndarray, n: int) -> pa.RecordBatch:
    """The first n rows, each with the row after it as its next document."""
    edited = [t[: len(t) - len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts[:n], texts[1 : n + 1], strict=True)]
    other = sketches(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([None if k == NO_ID else k for k in names[:n]], pa.int64()),
            pa.array([len(t) for t in texts[:n]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(as_text(marks[:n]), pa.string()),
            pa.array(as_text(other), pa.string()),
            pa.array(likeness(marks[:n], other)),
            pa.array(likeness(marks[:n], marks[1 : n + 1])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
