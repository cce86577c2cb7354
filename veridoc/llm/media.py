"""Media columns with content-defined chunks.

A rolling gear hash cuts each payload where the hash has zeros in its top bits, so an insertion moves only
the cuts around it. Chunks that occur once stay inside their payload's row; a chunk that occurs more often is
stored by one owner, the first payload that holds it, and other rows name it by digest. Spark joins find the
shared digests and bring their bytes back; the ordered chunk list that is stored with each row rebuilds its
payload, and each chunk's digest is verified as it is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm.common import discard, mix, packed, salted_join, shared_dir, stored, unpacked

LEAST, MOST = 256, 4096
TOP_BITS = 10
WINDOW = 32
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
INLINE, OWNED, NAMED = 0, 1, 2
MAGIC = b"VCDC0001"


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))


def cut_points(payloads: list[bytes]) -> list[list[int]]:
    """Ends of the chunks of each payload."""
    out: list[list[int]] = []
    lo = 0
    while lo < len(payloads):
        hi, total = lo, 0
        while hi < len(payloads) and (hi == lo or total + len(payloads[hi]) <= 1 << 20):
            total += len(payloads[hi])
            hi += 1
        gap = b"\0" * WINDOW
        data = np.frombuffer(gap + gap.join(payloads[lo:hi]), np.uint8)
        h = GEAR[data]
        span = 1
        while span < WINDOW:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
            span *= 2
        ends = np.flatnonzero((h >> np.uint32(32 - TOP_BITS)) == 0) + 1
        at = WINDOW
        for p in payloads[lo:hi]:
            a, b = np.searchsorted(ends, [at + 1, at + len(p)])
            out.append(_spaced((ends[a:b] - at).tolist(), len(p)))
            at += len(p) + WINDOW
        lo = hi
    return out


def _spaced(ends: list[int], n: int) -> list[int]:
    """Cuts at least LEAST and at most MOST apart."""
    cuts, last = [], 0
    for e in [*ends, n]:
        while e - last > MOST:
            last += MOST
            cuts.append(last)
        if e == n or e - last >= LEAST:
            if e > last:
                cuts.append(e)
            last = e
    return cuts


def chunks_of(data: bytes, cuts: list[int]) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of each chunk."""
    last = 0
    for c in cuts:
        part = data[last:c]
        yield hashlib.blake2b(part, digest_size=16).digest(), part
        last = c


def _batches(column: pa.Array, size: int = 256) -> Iterator[tuple[int, list]]:
    for lo in range(0, len(column), size):
        yield lo, column.slice(lo, size).to_pylist()


def _occurrences(batches):
    """(mark, digest, n) of each distinct chunk of each row."""
    for b in batches:
        for lo, texts in _batches(b.column("text")):
            data = [payload(t) for t in texts]
            keys, digests, times = [], [], []
            for i, (p, cuts) in enumerate(zip(data, cut_points(data), strict=True)):
                held = Counter(digest for digest, _ in chunks_of(p, cuts))
                digests += held.keys()
                times += held.values()
                keys += [lo + i] * len(held)
            yield pa.RecordBatch.from_arrays([b.column("mark").take(pa.array(keys, pa.int64())), pa.array(digests, pa.binary()), pa.array(times, pa.int32())], ["mark", "digest", "n"])


#: The ordered chunk list (MAGIC, number of chunks, digest and length of each), the kind of each chunk's place, the bytes of inline chunks, and of owned ones.
ROW = "n_bytes long, form binary, places binary, inline binary, owned array<struct<digest:binary,bytes:binary>>"


def chunk_list(chunks: list[tuple[bytes, int]]) -> bytes:
    return MAGIC + struct.pack("<I", len(chunks)) + b"".join(d + struct.pack("<I", n) for d, n in chunks)


def listed(form: bytes) -> list[tuple[bytes, int]]:
    """(digest, length) of each chunk of a stored chunk list."""
    (n,) = struct.unpack_from("<I", form, len(MAGIC))
    at = len(MAGIC) + 4
    if form[: len(MAGIC)] != MAGIC or len(form) != at + 20 * n:
        raise ValueError("not a chunk list")
    return [(form[i : i + 16], struct.unpack_from("<I", form, i + 16)[0]) for i in range(at, len(form), 20)]


def _rows(batches):
    held = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary())]))
    for b in batches:
        for lo, blobs in _batches(b.column("blob")):
            texts = unpacked(blobs)
            shared = [{x["digest"]: x["own"] for x in s or []} for s in b.column("shared").slice(lo, len(texts)).to_pylist()]
            data = [payload(t) for t in texts]
            cols: list[list] = [[] for _ in range(5)]
            for t, p, cuts, marks in zip(texts, data, cut_points(data), shared, strict=True):
                chunks, places, inline, owned = [], bytearray(), [], {}
                for digest, part in chunks_of(p, cuts):
                    chunks.append((digest, len(part)))
                    places.append(INLINE if digest not in marks else OWNED if marks[digest] else NAMED)
                    if places[-1] == INLINE:
                        inline.append(part)
                    elif places[-1] == OWNED:
                        owned[digest] = part
                row = (len((t or "").encode()), chunk_list(chunks), bytes(places), b"".join(inline), [{"digest": d, "bytes": x} for d, x in owned.items()])
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), held]
            yield pa.RecordBatch.from_arrays([b.column(c).slice(lo, len(texts)) for c in ("key", "mark")] + list(map(pa.array, cols, kinds)), ["key", "mark", "n_bytes", "form", "places", "inline", "owned"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Stores every row's payload in the shared folder, each shared chunk once; returns the table's path.

    Null texts are empty payloads of 64 zero bytes; whole texts are stored whatever their length; repeated
    rows and null ids stay; other columns are left out, so their names cannot clash; an empty table is stored empty.

    What a row shares with others is gathered by its mark, a hash of its id and text: so many rows of one id, or
    without an id, have a set each, which is no larger than the row's own chunks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("key", "text"))
    kind = rows.schema["key"].dataType.simpleString()
    seen = stored(rows.select("mark", "text").mapInArrow(_occurrences, "mark long, digest binary, n int"), "chunk-digests")
    # counts and owners are combined before the shuffle, so a chunk of very many rows is one row for each task
    shared = stored(seen.groupBy("digest").agg(F.sum("n").alias("n"), F.min("mark").alias("first")).filter("n > 1"), "shared-digests")
    found = salted_join(seen.select("mark", "digest"), shared.select("digest", "first"), "digest", shared)
    marks = found.groupBy("mark").agg(F.collect_set(F.struct("digest", (F.col("mark") == F.col("first")).alias("own"))).alias("shared"))
    marked = packed(rows, "key", "text", "mark").join(marks, "mark", "left").select("key", "mark", "blob", "shared")
    path = shared_dir(spark, "media")
    marked.mapInArrow(_rows, f"key {kind}, mark long, {ROW}").write.option("compression", "zstd").parquet(path)
    discard(seen)
    return path


def rebuilt(chunks: list[tuple[bytes, int]], places: bytes, inline: bytes, known: dict[bytes, bytes]) -> bytes:
    """The payload that a chunk list describes; each chunk is verified."""
    parts, at = [], 0
    for (digest, n), place in zip(chunks, places, strict=True):
        if place == INLINE:
            part, at = inline[at : at + n], at + n
        else:
            part = known[digest]
        if hashlib.blake2b(part, digest_size=16).digest() != digest or len(part) != n:
            raise ValueError("a chunk differs from its digest")
        parts.append(part)
    return b"".join(parts)


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def feature(chunks: list[tuple[bytes, int]], data: bytes) -> str:
    """Number of chunks and of different ones, entropy of the bytes, and the least digest."""
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    share = share[share > 0]
    digests = {d for d, _ in chunks}
    return f"chunks={len(chunks)};distinct={len(digests)};entropy={float(-(share * np.log2(share)).sum()):.4f};least={min(digests).hex()[:16]}"


def _features(batches):
    names = ["doc_id", *[f.split()[0] for f in RESULT.split(", ")]]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        cols = {c: b.column(c) for c in b.schema.names}
        for lo in range(0, b.num_rows, 256):
            part = {c: v.slice(lo, 256).to_pylist() for c, v in cols.items() if c not in ("key", "mark")}
            out: list[tuple] = []
            for i, form in enumerate(part["form"]):
                known = {x["digest"]: x["bytes"] for x in [*(part["owned"][i] or []), *(part["fetched"][i] or [])]}
                chunks = listed(form)
                data = rebuilt(chunks, part["places"][i], part["inline"][i], known)
                out.append((part["n_bytes"][i], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(form), hashlib.sha256(form).hexdigest(), feature(chunks, data)))
            yield pa.RecordBatch.from_arrays([cols["key"].slice(lo, 256), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names)


def _asked(batches):
    """(mark, digest) of the chunks that a row names."""
    for b in batches:
        at, digests = [], []
        for i, (form, places) in enumerate(zip(b.column("form").to_pylist(), b.column("places").to_pylist(), strict=True)):
            own = {d for (d, _), p in zip(listed(form), places, strict=True) if p == NAMED}
            digests += own
            at += [i] * len(own)
        yield pa.RecordBatch.from_arrays([b.column("mark").take(pa.array(at, pa.int64())), pa.array(digests, pa.binary())], ["mark", "digest"])


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Rebuilds and verifies every payload of a stored table: doc_id and RESULT's columns. media_bytes and
    media_sha256 are of the stored chunk list.

    Rows whose chunks are all in the row itself move nowhere; for the others only the named chunks and
    what the row holds itself are shuffled. A lost or altered chunk raises ValueError; an empty table gives no rows.
    """
    table = spark.read.parquet(path)
    kind = table.schema["key"].dataType.simpleString()
    named = F.instr(F.hex("places"), f"{NAMED:02X}") > 0
    chunks = table.select(F.explode("owned").alias("c")).select("c.digest", "c.bytes").groupBy("digest").agg(F.first("bytes").alias("bytes"))
    asked = stored(table.filter(named).select("mark", "form", "places").mapInArrow(_asked, "mark long, digest binary").distinct(), "asked-digests")
    fetched = salted_join(asked, chunks, "digest").groupBy("mark").agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    far = table.filter(named).join(fetched, "mark").select(*table.columns, "fetched")
    near = table.filter(~named).withColumn("fetched", F.lit(None).cast(fetched.schema["fetched"].dataType))
    return near.unionByName(far).mapInArrow(_features, f"doc_id {kind}, {RESULT}")
