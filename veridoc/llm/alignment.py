"""Alignment of two tokenizers' tokens by merge-path partitioning.

The tokens of a text under tokenizer A and under tokenizer B cover the same bytes, so each side is an ascending list
of byte offsets where tokens end. Merging the two lists shows which tokens overlap and where both end. The merge
path of a block of texts is cut by diagonals into pieces of equally many steps; a binary search on each diagonal
finds where its piece begins in either list, and all pieces then merge side by side, one step at a time, as lanes
of numpy arrays. Each piece emits the overlaps that it meets; a piece that begins at an offset which its
predecessor has emitted leaves it out, and groups that lie across pieces are stitched by the pieces' group counts.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, discard, stored
from veridoc.llm.piece_bpe import MARK, PieceBpe, SegmentMemo
from veridoc.llm.pieces import PieceMemo
from veridoc.llm.simple8b import LibraryEncoder
from veridoc.llm.token_counts import byte_symbols

#: Pieces that a block's merge path is cut into.
PIECES = 2048
#: Code points of texts that are aligned at once.
BLOCK_CHARS = 1 << 19
#: Pairs whose counts are broadcast, those of most documents; the others are joined.
BROADCAST_PAIRS = 1 << 20
#: Pieces that a worker remembers for each tokenizer.
MEMO = 400_000


def diagonal_starts(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of a's ends come before each diagonal of the merge of a and b, where a's come first among equals."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = open_ & (a[np.minimum(mid, len(a) - 1)] <= b[np.clip(diagonals - mid - 1, 0, len(b) - 1)])
        low, high = np.where(before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def overlaps(a: np.ndarray, b: np.ndarray, pieces: int = PIECES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token of A, token of B, group) of all overlapping pairs in order, from the strictly ascending ends of the
    tokens of each side, whose last is the same. A group ends where both sides end."""
    total = len(a) + len(b)
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none
    steps = -(-total // pieces)
    diagonals = np.arange(0, total, steps)
    i = diagonal_starts(a, b, diagonals)
    j = diagonals - i
    never = np.iinfo(np.int64).max
    ends_a, ends_b = np.concatenate([[-1], a, [never] * 2]), np.concatenate([b, [never] * 2])
    at_a, at_b = np.empty((2, steps, len(i)), np.int64)
    new, both = np.zeros((2, steps, len(i)), bool)
    for s in range(steps):
        x, y = ends_a[i + 1], ends_b[j]
        first = x <= y
        at_a[s], at_b[s] = i, j
        new[s] = (first | (ends_a[i] != y)) & (diagonals + s < total)
        both[s] = first & (x == y) & new[s]
        i, j = np.minimum(i + first, len(a)), np.minimum(j + ~first, len(b))
    closed = both.cumsum(0)  # groups that each piece has closed, and those of all pieces before it
    group = closed - both + (np.cumsum(closed[-1]) - closed[-1])
    order = lambda m: m.T[new.T]
    return order(at_a), order(at_b), order(group)


class Side:
    """One tokenizer: ids of texts, and the bytes of each id."""

    def __init__(self, encode, raw: list[bytes]):
        self.encode, self.raw = encode, raw
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts, self.pool = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(raw), np.uint8)
        width = len(str(len(raw))) + 1
        self.digits = np.frombuffer(b"".join(b"%d" % k + b"," * (width - len(str(k))) for k in range(len(raw))), np.uint8).reshape(-1, width)
        self.written = np.fromiter((len(str(k)) + 1 for k in range(len(raw))), np.int64, len(raw))

    def spells(self, ids: np.ndarray, counts: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Whether the tokens of each text, of which there are so many, are its bytes."""
        sizes = self.sizes[ids]
        total = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        good = np.diff(total) == np.fromiter(map(len, raw), np.int64, len(raw))
        kept = np.repeat(good, counts)
        sizes, ends = sizes[kept], np.cumsum(sizes[kept])
        held = self.pool[np.repeat(self.starts[ids[kept]] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        wrong = np.flatnonzero(held != np.frombuffer(b"".join(r for r, ok in zip(raw, good, strict=True) if ok), np.uint8))
        at = np.flatnonzero(good)
        good[at[np.searchsorted(np.cumsum(np.diff(total)[at]), wrong, "right")]] = False
        return good


class LibraryPieces(PieceBpe):
    """Segments as the library encodes them."""

    def encode_segments(self, pieces: list[str]) -> list[bytes]:
        ids = self.library.encode(pieces, num_threads=1) if pieces else []
        mark = [self.ids[MARK]]
        return [array("I", x[1:] if p[:1] == "\n" else x if p else mark).tobytes() for p, x in zip(pieces, ids, strict=True)]


@lru_cache(maxsize=2)
def byte_side(path: str) -> Side:
    """A byte-level vocabulary (a tokenizers .json) over a space and the text; special strings are plain text."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    raw = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        if all(c in byte_of for c in piece):
            raw[i] = bytes(byte_of[c] for c in piece)
    memo = PieceMemo(LibraryEncoder(path, plain=True), MEMO)
    return Side(lambda texts: memo.ids([" " + t for t in texts]), raw)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A piece vocabulary (a sentencepiece .model), which puts a space before the text itself."""
    bpe = LibraryPieces(path, check=False)
    raw = []
    for i in range(bpe.library.get_piece_size()):
        piece = bpe.library.id_to_piece(i)
        raw.append(bytes([int(piece[1:-1], 16)]) if bpe.library.is_byte(i) else b"" if bpe.library.is_control(i) or bpe.library.is_unknown(i) else piece.replace(MARK, " ").encode())
    memo = SegmentMemo(bpe, MEMO)

    def encode(texts):
        ids = memo(texts)
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))

    return Side(encode, raw)


def align_texts(texts: list[str], a: Side, b: Side, pieces: int = PIECES) -> list[tuple]:
    """(tokens of A, of B, groups, links, groups as text, distinct pairs of ids, links of each) of each text.

    A text that is empty, or whose tokens on either side are not the bytes of a space and the text, has no tokens."""
    out = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(texts)
    some = [k for k, t in enumerate(texts) if t]
    if not some:
        return out
    raw = [b" " + texts[k].encode() for k in some]
    (ids_a, n_a), (ids_b, n_b) = (side.encode([texts[k] for k in some]) for side in (a, b))
    good = a.spells(ids_a, n_a, raw) & b.spells(ids_b, n_b, raw)
    if not good.any():
        return out
    some = [k for k, ok in zip(some, good, strict=True) if ok]
    ids_a, ids_b = ids_a[np.repeat(good, n_a)].astype(np.int64), ids_b[np.repeat(good, n_b)].astype(np.int64)
    n_a, n_b = n_a[good], n_b[good]
    at_a, at_b, group = overlaps(np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b]), pieces)
    of_text = np.repeat(np.arange(len(some)), n_a)[at_a]
    group_a, group_b = np.empty(len(ids_a), np.int64), np.empty(len(ids_b), np.int64)
    group_a[at_a], group_b[at_b] = group, group
    # each token's place where all groups are written one after the other, A's tokens first
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    place_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[group_a]
    place_b = np.arange(len(ids_b)) + np.cumsum(count_a)[group_b]
    width = max(a.digits.shape[1], b.digits.shape[1])
    written, sizes = np.zeros((len(ids_a) + len(ids_b), width), np.uint8), np.empty(len(ids_a) + len(ids_b), np.int64)
    for side, ids, places, groups, mark in ((a, ids_a, place_a, group_a, b"|"), (b, ids_b, place_b, group_b, b";")):
        written[places, : side.digits.shape[1]], sizes[places] = side.digits[ids], side.written[ids]
        last = np.append(groups[1:] != groups[:-1], True)
        written[places[last], side.written[ids[last]] - 1] = mark[0]
    line = written[np.arange(width) < sizes[:, None]].tobytes()
    ends = np.append(0, np.cumsum(sizes)[np.cumsum(n_a + n_b) - 1]).tolist()
    closes = np.append(group[1:] != group[:-1], True)
    n_groups = np.bincount(of_text[closes], minlength=len(some))
    n_links = np.bincount(of_text, minlength=len(some))
    wide = len(a.raw) * len(b.raw)
    pairs, times = np.unique(of_text * wide + ids_a[at_a] * len(b.raw) + ids_b[at_b], return_counts=True)
    cut = np.searchsorted(pairs, np.arange(1, len(some)) * wide)
    per_pairs, per_times = np.split(pairs % wide, cut), np.split(times.astype(np.int32), cut)
    for m, k in enumerate(some):
        text = line[ends[m] : ends[m + 1] - 1].decode()
        out[k] = (int(n_a[m]), int(n_b[m]), int(n_groups[m]), int(n_links[m]), text, per_pairs[m], per_times[m])
    return out


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    groups writes each group as A's ids, a bar and B's ids, joined by semicolons. pairs are the distinct pairs of
    ids that are linked, as A's id times the size of B's vocabulary plus B's id, and times how many links each has.

    Null and empty texts, and texts whose tokens on either side do not spell a space and the text, have zeros, '' and
    empty arrays. Texts are read whole whatever their length; repeated rows and null ids stay; other columns are left
    out, so their names cannot clash; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = [pa.int64()] * 4 + [pa.string()]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def lists(parts, kind):
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), kind))

    def run(batches):
        a, b = byte_side(byte_path), piece_side(piece_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo, hi in blocks(texts, BLOCK_CHARS):
                found = list(zip(*align_texts(texts[lo:hi], a, b), strict=True))
                plain = [pa.array(x, k) for x, k in zip(found[:5], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), *plain, lists(found[5], pa.int64()), lists(found[6], pa.int32())], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")


def vocabulary_size(piece_path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()


def link_statistics(docs: DataFrame, byte_path: str, piece_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row; edge cases as in align.

    A pair's count is the number of rows that hold it linked; n_best counts the links whose pair has the largest
    count of all pairs of its A id, ties included; count_sum adds up the counts of all links.

    The counts of the most frequent pairs, at most broadcast_pairs of them, and the largest count of each A id, at
    most one for each id of the vocabulary, are broadcast. Rarer pairs are joined: since every frequent pair is
    among the others, no key of that join is hot."""
    spark, size = docs.sparkSession, vocabulary_size(piece_path)
    aligned = align(docs, byte_path, piece_path)
    kept = aligned.withColumn("groups_sha256", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))).drop("groups")
    rows = stored(kept.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    level = F.floor(F.log2("n") * 8)
    upto, least = 0, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("n")).orderBy(F.desc("level")).collect():
        upto += r["k"]
        if upto > broadcast_pairs:
            break
        least = r["n"]
    frequent = counts.filter(F.col("n") >= (2**63 - 1 if least is None else least)).orderBy("pair").toArrow()
    best_of = counts.groupBy(F.floor(F.col("pair") / size).alias("a")).agg(F.max("n").alias("best"))
    best_rows = best_of.toArrow()
    top = np.zeros(max(best_rows.column("a").to_pylist(), default=0) + 1, np.int64)
    top[best_rows.column("a").to_numpy()] = best_rows.column("best").to_numpy()
    shared = spark.sparkContext.broadcast((frequent.column("pair").to_numpy(), frequent.column("n").to_numpy(), top))

    def run(batches):
        known, n, top = shared.value
        for b in batches:
            pairs, times = (b.column(c).flatten().to_numpy() for c in ("pairs", "times"))
            held = b.column("pairs").value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(held)), held)
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            count = n[at[hit]]
            add = lambda x: pa.array(_sums(owner[hit], x, len(held)))
            rest = np.bincount(owner[~hit], minlength=len(held))
            cuts = pa.array(np.append(0, np.cumsum(rest)), pa.int32())
            columns = [b.column(c) for c in names] + [add(times[hit] * (count == top[pairs[hit] // size])), add(times[hit] * count)]
            columns += [pa.ListArray.from_arrays(cuts, pa.array(pairs[~hit])), pa.ListArray.from_arrays(cuts, pa.array(times[~hit]))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_best", "count_sum", "pairs", "times"])

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    summed = stored(rows.select(*names, "pairs", "times").mapInArrow(run, f"{schema}, n_best long, count_sum long, pairs array<long>, times array<int>"), "link-sums")
    discard(rows)
    rest = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rare = counts.withColumn("a", F.floor(F.col("pair") / size)).join(F.broadcast(best_of), "a")
    more = rest.join(rare, "pair").groupBy("row").agg(F.sum(F.col("times") * (F.col("n") == F.col("best")).cast("long")).alias("best_too"), F.sum(F.col("times") * F.col("n")).alias("sum_too"))
    return summed.drop("pairs", "times").join(more, "row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        (F.col("n_best") + F.coalesce("best_too", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("sum_too", F.lit(0))).alias("count_sum"),
        "groups_sha256",
    )


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by ascending owner."""
    total = np.append(0, np.cumsum(values.astype(np.int64)))
    ends = np.searchsorted(owner, np.arange(n + 1))
    return total[ends[1:]] - total[ends[:-1]]
