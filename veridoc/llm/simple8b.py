"""Token-id files in Simple-8b, a word-aligned code.

Each 64-bit word holds a 4-bit selector and as many ids as fit in 60 bits at the selector's width. Each document's
ids are cut into blocks of 512; a word never crosses a block, and the number of words of each block is kept, so
blocks decode independently and whole files decode as array operations. An id of more than 60 bits is an escape:
its word holds an index into a list of raw ids.

File layout, all little-endian and 8-byte aligned: magic; counts of documents, ids, blocks, words and escapes;
document ids; ids by document; words of each block; words; escapes.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridoc.llm.common import NO_ID, blocks, range_bounds
from veridoc.llm.pieces import PieceMemo, joined

MAGIC = 0x3142385350444956
BLOCK = 512
#: Ids in a word and bits of each, by selector; selector 0 is the escape.
COUNT = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: A file is closed once it holds this many ids.
FILE_IDS = 1 << 22


_SHORT_BITS = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 16 at a time."""
    out = _SHORT_BITS[(ids & np.uint64(0xFFFF)).astype(np.uint16)]
    for shift in (16, 32, 48):
        rest = ids >> np.uint64(shift)
        if not rest.any():
            break
        out = np.where(rest > 0, _SHORT_BITS[(rest & np.uint64(0xFFFF)).astype(np.uint16)] + np.uint8(shift), out)
    return out


def block_sizes(counts: np.ndarray) -> np.ndarray:
    """Ids in each block of documents of so many ids each."""
    counts = np.asarray(counts, np.int64)
    blocks_ = -(-counts // BLOCK)
    out = np.full(int(blocks_.sum()), BLOCK, np.int64)
    some = counts > 0
    out[np.cumsum(blocks_)[some] - 1] = counts[some] - (blocks_[some] - 1) * BLOCK
    return out


def encode_ids(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each block, words, escapes) of unsigned 64-bit ids in blocks of the given sizes."""
    ids = np.asarray(ids, np.uint64)
    if not len(ids):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pad = int(COUNT.max())
    # zero ids follow each block, so that no word reads the next one
    begins = np.cumsum(sizes + pad) - sizes - pad
    flat = np.zeros(int((sizes + pad).sum()), np.uint64)
    flat[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)) * pad, sizes)] = ids
    power, span = _bits(flat), 1
    best = np.zeros(len(flat), np.uint8)
    for s in range(15, 0, -1):  # from few wide ids to many narrow ones; the last that fits holds most
        while span * 2 <= COUNT[s]:
            power, span = np.maximum(power[:-span], power[span:]), span * 2
        shift = int(COUNT[s]) - span
        widest = np.maximum(power[: len(power) - shift], power[shift:])
        best[: len(widest)][widest <= WIDTH[s]] = s
    at, end = begins.copy(), begins + sizes
    found, live = [], np.arange(len(sizes))
    while len(live):  # all blocks step on together
        here = at[live]
        found.append(here)
        at[live] = here + COUNT[best[here]]
        live = live[at[live] < end[live]]
    start = np.sort(np.concatenate(found))
    sel = best[start]
    words = sel.astype(np.uint64) << np.uint64(60)
    escapes = np.zeros(0, np.uint64)
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        if s == 0:
            escapes = flat[start[of]]
            words[of] |= np.arange(len(of), dtype=np.uint64)
        elif WIDTH[s]:
            held = flat[start[of]]
            for k in range(1, COUNT[s]):
                held |= flat[start[of] + k] << np.uint64(k * WIDTH[s])
            words[of] |= held
    return np.diff(np.append(np.searchsorted(start, begins), len(start))).astype(np.uint64), words, escapes


def decode_ids(held: np.ndarray, words: np.ndarray, escapes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids in blocks of the given sizes; held: words of each block."""
    out = np.zeros(int(sizes.sum()), np.uint64)
    if not len(out):
        return out
    sel = (words >> np.uint64(60)).astype(np.int64)
    held = held.astype(np.int64)
    first = np.cumsum(held) - held
    upto = np.cumsum(COUNT[sel]) - COUNT[sel]
    block = np.repeat(np.arange(len(held)), held)
    begins = np.cumsum(sizes) - sizes
    start = upto + (begins - upto[first])[block]
    end = (begins + sizes)[block]
    for s in np.unique(sel):
        of = np.flatnonzero(sel == s)
        if s == 0:
            out[start[of]] = escapes[(words[of] & np.uint64(2**60 - 1)).astype(np.int64)]
        elif WIDTH[s]:
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            for k in range(COUNT[s]):
                to = start[of] + k
                ok = to < end[of]
                out[to[ok]] = (words[of[ok]] >> np.uint64(k * WIDTH[s])) & mask
    return out


class TokenFile:
    """Takes coded documents one after the other and gives a file of them."""

    def __init__(self):
        self.docs, self.counts, self.held, self.words, self.escapes = [], [], [], [], []
        self.n_escapes = self.total = 0

    def add(self, doc_id: int | None, count: int, held: np.ndarray, words: np.ndarray, escapes: np.ndarray) -> None:
        if len(escapes):  # their words count on from those of the documents before
            words = words + np.where(words >> np.uint64(60) == 0, np.uint64(self.n_escapes), np.uint64(0))
            self.escapes.append(escapes)
            self.n_escapes += len(escapes)
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.counts.append(count)
        self.held.append(held)
        self.words.append(words)
        self.total += count

    def pack(self) -> bytes:
        whole = lambda parts: np.concatenate([np.zeros(0, np.uint64), *parts])
        held, words, escapes = whole(self.held), whole(self.words), whole(self.escapes)
        head = np.array([MAGIC, len(self.docs), self.total, len(held), len(words), len(escapes)], np.uint64)
        parts = [head, np.array(self.docs, np.int64).view(np.uint64), np.array(self.counts, np.uint64), held, words, escapes]
        return np.concatenate(parts).astype("<u8").tobytes()


def unpack_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, ids by document, all ids) of a file."""
    data = np.frombuffer(raw, "<u8")
    if not len(data) or data[0] != MAGIC:
        raise ValueError("not a token-id file")
    docs, n, held, words, escapes = (int(x) for x in data[1:6])
    cuts = np.cumsum([6, docs, docs, held, words, escapes])
    named, counts, in_blocks, coded, raw_ids = (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
    ids = decode_ids(in_blocks, coded, raw_ids, block_sizes(counts))
    if len(ids) != n:
        raise ValueError("a token-id file is damaged")
    return named.view(np.int64), counts.astype(np.int64), ids


class LibraryEncoder:
    """Ids of pieces by the tokenizers library, many pieces to a text where they can be joined.

    plain: special strings inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special and not plain else None
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def __call__(self, joint: list[str], alone: list[str]) -> tuple[np.ndarray, np.ndarray]:
        groups = [joint[k : k + 500] for k in range(0, len(joint), 500)]
        texts = [joined(g) for g in groups]
        # a special string, even one that two joined pieces make, must not swallow a newline
        if len(self.newline) != 1 or (self.special and any(map(self.special.search, texts))):
            groups = texts = []
            alone = joint + alone
            joint = []
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.frombuffer(array("I", e.ids), np.uint32)
            breaks = np.flatnonzero(ids == self.newline[0])
            if len(breaks) != len(g):
                raise ValueError("the tokenizer does not keep a newline as a token of its own")
            put = np.fromiter((p[0] != "\n" for p in g), bool, len(g))
            sizes.append(np.diff(np.append(breaks, len(ids))) - put)
            flat.append(np.delete(ids, breaks[put]))
        for lo in range(0, len(alone), 500):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(alone[lo : lo + 500], add_special_tokens=False)]
            sizes.append(np.array([len(x) for x in found], np.int64))
            flat.append(np.array([i for x in found for i in x], np.uint32))
        return np.concatenate(sizes), np.concatenate(flat)


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceMemo:
    return PieceMemo(LibraryEncoder(path), limit=1_000_000)


def coded_documents(docs: DataFrame, tokenizer: str, end_id: int | None, bounds: list) -> DataFrame:
    """(doc_id, part, n_tokens, held, words, escapes) of each row of (doc_id, text): its ids in Simple-8b, and the
    range of ids that it lies in."""
    tail = [] if end_id is None else [end_id]
    limits = np.array(bounds, np.int64)

    def run(batches):
        memo = encoder(tokenizer)
        for b in batches:
            keys, texts = b.column("doc_id"), b.column("text").to_pylist()
            for lo, hi in blocks(texts, 1 << 20):
                ids, counts = memo.ids(texts[lo:hi])
                if tail:
                    ids = np.insert(ids, np.cumsum(counts), tail[0])
                    counts = counts + 1
                sizes = block_sizes(counts)
                held, words, escapes = encode_ids(ids, sizes)
                # blocks and words of each document
                last_block = np.cumsum(-(-counts // BLOCK))
                ends = np.append(0, np.cumsum(held.astype(np.int64)))[last_block]
                marks = np.append(0, np.cumsum(words >> np.uint64(60) == 0))[ends]
                raw = [(held.astype("<u2"), last_block), (words, ends), (escapes, marks)]
                cols = [[x[a:z].tobytes() for a, z in zip([0, *at[:-1].tolist()], at.tolist(), strict=True)] for x, at in raw]
                if len(escapes):  # indices begin anew for each document
                    cols[1] = [_rebased(w, int(m)) for w, m in zip(cols[1], [0, *marks[:-1].tolist()], strict=True)]
                own = keys.slice(lo, hi - lo)
                part = np.searchsorted(limits, own.fill_null(NO_ID).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([own, pa.array(part, pa.int32()), pa.array(counts), *[pa.array(c, pa.binary()) for c in cols]], CODED.names)

    return docs.mapInArrow(run, "doc_id long, part int, n_tokens long, held binary, words binary, escapes binary")


CODED = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("n_tokens", pa.int64()), ("held", pa.binary()), ("words", pa.binary()), ("escapes", pa.binary())])


def _rebased(words: bytes, before: int) -> bytes:
    w = np.frombuffer(words, "<u8")
    return np.where(w >> np.uint64(60) == 0, w - np.uint64(before), w).tobytes()


def _save(root: str, name: str, data: bytes) -> None:
    """Writes a file under a name of its own, which only a finished task's index row makes count."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


INDEX = "part int, number int, file string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes token ids of all rows below ``root`` in ascending doc_id order, and an index of the files.

    Returns the index: INDEX's columns and start, the ids in all files before it. Ids of a document follow each
    other, with ``end_id`` after each if given. Null texts count as empty; a null doc_id comes first; rows with
    equal ids stay, ordered by their coded ids; other columns are left out, so their names cannot clash; an empty
    table writes an empty index. ``root`` must be in storage that all executors share. Texts are encoded where they
    are read; only coded ids are shuffled, to ranges of doc_id. A repeated task writes files of other names; those
    that no index row names are ignored.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = range_bounds(rows, "doc_id", n)
    dealt = coded_documents(rows, tokenizer, end_id, bounds).repartitionById(len(bounds) + 1, F.col("part"))

    def run(batches):
        number, part, held = 0, 0, TokenFile()

        def flush():
            nonlocal number, held
            name = f"ids-{part:08d}-{number:06d}-{uuid.uuid4().hex}.s8b"
            _save(f"{root}/files", name, held.pack())
            row = {"part": [part], "number": [number], "file": [name], "n_docs": [len(held.docs)], "n_tokens": [held.total]}
            number, held = number + 1, TokenFile()
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

        for b in batches:
            cols = [b.column(c) for c in ("doc_id", "part", "n_tokens", "held", "words", "escapes")]
            for lo in range(0, b.num_rows, 512):
                for doc_id, part, count, blocks_, words, escapes in zip(*[c.slice(lo, 512).to_pylist() for c in cols], strict=True):
                    held.add(doc_id, count, np.frombuffer(blocks_, "<u2").astype(np.uint64), np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8"))
                    if held.total >= file_ids:
                        yield flush()
        if held.docs:
            yield flush()

    dealt.sortWithinPartitions("doc_id", "words", "held", "escapes").mapInArrow(run, INDEX).write.mode("overwrite").parquet(f"{root}/index")
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    # ids before a range of documents, of which there are as many as shuffle partitions; then before a file of it
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return index.join(parts, "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("before")


def read_token_files(spark: SparkSession, root: str, index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of each document from the files; ids are little-endian
    unsigned 32-bit, start counts the ids of all documents before. An empty index gives no rows; files that it
    does not name are left out."""
    if index.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(f"{root}/files")
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # the index has a short row for each file; whether to broadcast it is left to its measured size
    return named.join(index.select("file", F.col("start").alias("base")), "file").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids binary")


def _documents(batches):
    for b in batches:
        for raw, base in zip(b.column("content"), b.column("base").to_pylist(), strict=True):
            named, counts, ids = unpack_file(raw.as_py())
            wide = ids.astype("<u4").tobytes()
            ends = np.cumsum(counts)
            starts = ends - counts
            for lo in range(0, len(named), 2000):
                part = slice(lo, lo + 2000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if d == NO_ID else d for d in named[part].tolist()], pa.int64()),
                        pa.array(starts[part] + base),
                        pa.array(counts[part]),
                        pa.array([wide[4 * s : 4 * e] for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def with_crc(rows: DataFrame) -> DataFrame:
    """Adds ids_crc32, the unsigned crc32 of each row's ids."""
    return rows.withColumn("ids_crc32", F.crc32("ids"))


def crc32_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())
