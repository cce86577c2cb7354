"""Helpers that several training-data operators share: shared storage, text blocks and word hashes."""

from __future__ import annotations

import ctypes
import math
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points that a numpy pass holds at once; a longer text is a block of its own.
BLOCK_CHARS = 1 << 19
#: Stands for a null id where rows are ordered by number.
NO_ID = -(2**63)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; where that is unset, a temporary one if driver and executors
    are one process, and an error otherwise."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'veridoc-shared')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage durably."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by ``stored`` that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: What a worker remembers from task to task; see remembered.
_MEMOS: list = []


def remembered(make: Callable) -> Callable:
    """lru_cache of the last two memos that a worker goes on with, until it takes up a task of another kind (see lean)."""
    memo = lru_cache(maxsize=2)(make)
    _MEMOS.append(memo)
    return memo


def forget() -> None:
    """Drops what this worker remembers, and gives its memory back."""
    if any(m.cache_info().currsize for m in _MEMOS):
        for m in _MEMOS:
            m.cache_clear()
        give_back()


def give_back() -> None:
    """Returns freed memory, which Arrow's pool and the allocator would keep, to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim:
        trim(0)


def lean(run: Callable, remembers: bool = False) -> Callable:
    """run, a function for mapInArrow, whose worker gives its free memory back when a task ends: workers wait for
    later stages, and what each kind of task once needed would add up. Unless run itself ``remembers``, the
    worker's memos are dropped first."""

    def lean_run(batches):
        if not remembers:
            forget()
        try:
            yield from run(batches)
        finally:
            give_back()

    return lean_run


#: A key of more than one row in so many is hot: there are at most so many hot keys.
HOT_SHARE = 1000


def salted_join(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """rows joined with table, which has few rows for each key, so that no key is the work of one task.

    counts has the number ``n`` of rows for each key (counted here with partial sums if not given; rows should be
    cheap to read again then). A key with more than one in HOT_SHARE of all rows is hot: its rows are dealt, by a
    hash of the columns ``by``, to as many salts as they are HOT_SHARE-ths, and its rows of table are repeated for
    each. So there are at most HOT_SHARE hot keys; each with its number of salts, these are broadcast. Where no key is
    hot the join is a plain one."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n")) if counts is None else counts
    total, most = counts.agg(F.sum("n"), F.max(F.when(F.col(key).isNotNull(), F.col("n")))).first()
    limit = math.ceil((total or 0) / HOT_SHARE) + 1
    if (most or 0) <= limit:
        return rows.join(table, [key])
    hot = F.broadcast(counts.filter((F.col("n") > limit) & F.col(key).isNotNull()).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / limit).cast("int").alias("_salts")))
    spread = rows.join(hot, rows[key] == hot["_hot"], "left")
    salt = F.pmod(F.xxhash64(*(by or [c for c in rows.columns if c != key])), F.col("_salts"))
    spread = spread.withColumn("_salt", F.coalesce(salt, F.lit(0)).cast("int")).drop("_hot", "_salts")
    wide = table.join(hot, table[key] == hot["_hot"], "left")
    wide = wide.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_hot", "_salts")
    return spread.join(wide, [key, "_salt"]).drop("_salt")


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` code points each, at least one text in each."""
    start = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift and odd multipliers)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def packed(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """(key, blob) and further columns, with each text compressed, so that a shuffle moves less; null stays null."""
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), *more)

    def run(batches):
        for b in batches:
            blobs = pa.array(compressed(b.column("text").to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), blobs, *map(b.column, more)], ["key", "blob", *more])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"key {kind('key')}, blob binary", *[f"{c} {kind(c)}" for c in more]]))


def compressed(texts: list[str | None]) -> list[bytes | None]:
    z = zstandard.ZstdCompressor(level=5)
    return [None if t is None else z.compress(t.encode()) for t in texts]


def unpacked(blobs: list[bytes | None]) -> list[str | None]:
    z = zstandard.ZstdDecompressor()
    return [None if b is None else z.decompress(b).decode() for b in blobs]


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """Upper bounds of ascending ranges of a numeric key, at most n, of about equal numbers of rows. It reads
    only the key; nulls belong to the first range."""
    points = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(key, points, max(10_000, 20 * n)).alias("b")).first() if points else None
    return sorted(set(row["b"] or [])) if row else []


#: Byte classes: 0 between words, 1 in words, 2 punctuation. Bytes of multi-byte characters are in words.
_SPACED = np.ones(256, np.uint8)
_SPACED[[9, 10, 11, 12, 13, 32]] = 0
_CLASSED = _SPACED.copy()
_CLASSED[[b for b in range(33, 128) if not chr(b).isalnum()]] = 2
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str | None], punctuation: bool = False, lower: bool = True, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    Words stand between ASCII white space; with ``punctuation``, runs of ASCII punctuation are words of their
    own. For each length in ``prefixes`` an array of hashes of the words' first bytes follows. Null counts as
    empty."""
    raw = [((t or "").lower() if lower else t or "").encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    kind = (_CLASSED if punctuation else _SPACED)[data]
    starts = np.flatnonzero((kind > 0) & np.append(True, kind[1:] != kind[:-1]))
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, np.zeros(len(raw), np.int64), *[none for _ in prefixes]
    at = starts[0]
    spans = np.diff(np.append(starts, len(data)))
    powers = np.cumprod(np.full(int(spans.max()), _BASE, np.uint64))
    within = np.arange(at, len(data)) - np.repeat(starts, spans)
    values = (data[at:].astype(np.uint64) + np.uint64(1)) * powers[within]
    values[kind[at:] == 0] = 0
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    short = [mix(np.add.reduceat(np.where(within < k, values, np.uint64(0)), starts - at)) for k in prefixes]
    return mix(np.add.reduceat(values, starts - at)), counts, *short


def shingle_hashes(texts: list[str | None], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``words`` words of each text, and their number by text. A text of fewer
    words, but at least one, has one shingle of all its words; a text without words has none."""
    hashes, counts = word_hashes(texts)
    total = len(hashes)
    if not total:
        return hashes, counts
    last = np.cumsum(counts)
    left = np.repeat(last, counts) - np.arange(total)
    out = np.zeros(total, np.uint64)
    for j in range(min(words, int(counts.max()))):
        part = mix(hashes[j:] + np.uint64((j + 1) * int(_BASE) % 2**64))
        part[left[: total - j] <= j] = 0
        out[: total - j] += part
    first = np.zeros(total, bool)
    first[(last - counts)[counts > 0]] = True
    keep = (left >= words) | first
    return mix(out[keep]), np.where(counts > 0, np.maximum(counts - words + 1, 1), 0)
