"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles; a shingle's weight is how often it occurs. Weights are
cut into dyadic intervals [0,1), [1,2), [2,4), [4,8)...; each shingle has an independent Poisson process of
points on every interval, each point with a time, a place in the interval and one of the signature's
components. A component's value is the earliest point among the intervals below the weight: whole intervals
count whole, the last one by halving down to the place. Two documents agree in a component with probability
equal to their weighted Jaccard similarity, without bias. Points are drawn up to a time by which all
components are filled, later only where one is not.

Bands of the signature name candidates; multiset overlap verifies every link. Groups are linked through hubs
rather than by all pairs, and what hubs leave open is searched as arrays: see near_duplicate_classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, compressed, lean, mix, salted_join, shingle_hashes, stored, unpacked

COMPONENTS, BAND_ROWS = 128, 4
BANDS = COMPONENTS // BAND_ROWS
SIMILAR = 0.8
WORDS = 5
#: A bucket with members of more classes than this isn't linked through hubs. A search holds about so many
#: texts, and bytes of compressed text, twice at most.
MANY, BLOCK_ROWS, BLOCK_BYTES = 8, 4096, 1 << 25
#: Words of 64 bits of a Bloom filter: 16 MB, which hold 20 million hashes with about one in 20 others taken for one.
FILTER_WORDS = 1 << 21
#: Bands by which a bucket of more than BLOCK_ROWS members is split further.
DEEPER = 3
#: Components in which a similar pair agrees, but for less than one in a million (102 on average).
AGREE = 80
#: Filled by then with probability exp(-e^-SLACK) a component on average; other documents draw on.
SLACK = 4.0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PASS_CHARS = 1 << 18


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight) of each distinct shingle, ordered by document and shingle."""
    shingles, counts = shingle_hashes(texts, WORDS)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    if not len(order):
        return owner, shingles, owner
    new = np.append(True, (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1]))
    at = np.flatnonzero(new)
    return owner[at], shingles[at], np.diff(np.append(at, len(order)))


def _bags_in_parts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same as bags, for which a pass looks at about _PASS_CHARS code points only."""
    found = [(lo, bags(texts[lo:hi])) for lo, hi in blocks(texts, _PASS_CHARS)]
    return tuple(np.concatenate(x) for x in zip(*[(owner + lo, shingles, weights) for lo, (owner, shingles, weights) in found], strict=True)) if found else bags([])


def _unit(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(owner: np.ndarray, shingles: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """A row of COMPONENTS 64-bit point names for each of n documents; rows of documents without shingles are 0."""
    out = np.zeros((n, COMPONENTS), np.uint64)
    total = np.bincount(owner, weights, n)
    # streams: one for each shingle and dyadic interval that its weight reaches
    doc, seed, rate, cells = [owner], [mix(shingles)], [np.ones(len(owner))], [np.ones(len(owner), np.int64)]
    level = 1
    while (1 << (level - 1)) < (weights.max() if len(weights) else 0):
        low = 1 << (level - 1)
        some = weights > low
        doc.append(owner[some])
        seed.append(mix(shingles[some] + np.uint64(level * int(_ODD) % 2**64)))
        rate.append(np.full(some.sum(), float(low)))
        cells.append(np.minimum(weights[some] - low, low))
        level += 1
    doc, seed, rate, cells = map(np.concatenate, (doc, seed, rate, cells))
    todo = np.flatnonzero(total > 0)
    until = np.zeros(n)
    until[todo] = COMPONENTS * (np.log(COMPONENTS) + SLACK) / total[todo]
    while len(todo):
        wanted = np.zeros(n, bool)
        wanted[todo] = True
        live = np.flatnonzero(wanted[doc])
        d, s, r, c, t = doc[live], seed[live], rate[live], cells[live], np.zeros(len(live))
        slots, times, names = [], [], []
        number, width = 0, 1
        while len(d):  # streams that go on longer draw twice as many points at a time
            steps = np.array([k * int(_ODD) % 2**64 for k in range(number + 1, number + width + 1)], np.uint64)
            point = mix(s[:, None] + steps)
            gaps = -np.log(_unit(point)) / r[:, None]
            gaps[:, 0] += t
            at = np.cumsum(gaps, axis=1)
            row, column = np.nonzero(at <= until[d][:, None])
            point, when = point[row, column], at[row, column]
            more = mix(point + _ODD)
            # the place is found by halving the interval, a coin for each step: its bits
            place = (more >> np.uint64(32)) & (r[row].astype(np.uint64) - np.uint64(1))
            inside = place < c[row].astype(np.uint64)
            slots.append((d[row] * COMPONENTS + (more & np.uint64(COMPONENTS - 1)).astype(np.int64))[inside])
            times.append(when[inside])
            names.append(point[inside])
            number, width = number + width, min(2 * width, 256)
            live = at[:, -1] <= until[d]
            d, s, r, c, t = d[live], s[live], r[live], c[live], at[live, -1]
        slot, time, name = map(np.concatenate, (slots, times, names))
        order = np.argsort(time)[::-1]  # the earliest point of a component is written last
        out.ravel()[slot[order]] = name[order]
        filled = np.zeros((n, COMPONENTS), bool)
        filled.ravel()[slot] = True
        todo = todo[~filled[todo].all(axis=1)]
        until[todo] *= 2
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    parts = rows.reshape(len(rows), BANDS, BAND_ROWS)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = mix(key * _ODD + parts[:, :, j])
    return key.view(np.int64)


def digest(text: str | None) -> bytes:
    """Names a text; null counts as empty. text_digest is the same as a column."""
    return hashlib.sha256((text or "").encode()).digest()[:16]


def text_digest(text: str):
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def _signed(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        for lo, hi in blocks(texts, _PASS_CHARS):
            part = texts[lo:hi]
            owner, shingles, weights = bags(part)
            size = np.bincount(owner, weights, hi - lo).astype(np.int64)
            rows = signatures(owner, shingles, weights, hi - lo)
            keys = [k if n else [] for k, n in zip(band_keys(rows).tolist(), size, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo), pa.array(map(digest, part), pa.binary()), pa.array(size), pa.array(keys, pa.list_(pa.int64())), pa.array([r.tobytes() for r in rows.astype("<u2")], pa.binary())],
                ["id", "key", "size", "bands", "sig"],
            )


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash its word of a filter of FILTER_WORDS words of 64 bits, and its three bits there."""
    mask = np.zeros(len(hashes), np.uint64)
    for shift in (40, 46, 52):
        mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
    return (hashes & np.uint64(FILTER_WORDS - 1)).astype(np.int64), mask


def _hashes(values: pa.Array) -> np.ndarray:
    """Band keys, and the first bytes of digests, are hashes as they are."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.frombuffer(b"".join(v[:8] for v in values.to_pylist()), "<u8")


def _filter(keys: DataFrame) -> bytes:
    """A compressed Bloom filter of the one column of keys; its size is fixed, whatever their number."""

    def run(batches):
        for b in batches:
            word, mask = _bits(_hashes(b.column(0)))
            at, inverse = np.unique(word, return_inverse=True)
            out = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(out, inverse, mask)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.view(np.int64))], ["word", "mask"])

    words = keys.mapInArrow(lean(run), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    table = np.zeros(FILTER_WORDS, np.uint64)
    table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(table.tobytes())


def _may_hold(table: bytes) -> Callable[[pa.Array], np.ndarray]:
    """Whether each value may be in a filter: of those in it all are, of others few unless it is full."""
    words = np.frombuffer(zstandard.ZstdDecompressor().decompress(table), np.uint64)

    def held(values: pa.Array) -> np.ndarray:
        word, mask = _bits(_hashes(values))
        return (words[word] & mask) == mask

    return held


def _banded(shared: bytes) -> Callable:
    """(key, size, place, band) of those bands of texts that may be shared."""

    def run(batches):
        held = _may_hold(shared)
        for b in batches:
            sizes = b.column("bands").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            bands = b.column("bands").flatten()
            owner = np.repeat(np.arange(b.num_rows), sizes)
            place = np.arange(len(bands)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(held(bands))
            rows = pa.array(owner[at])
            yield pa.RecordBatch.from_arrays([b.column("key").take(rows), b.column("size").take(rows), pa.array(place[at].astype(np.int32)), bands.take(pa.array(at))], ["key", "size", "place", "band"])

    return run


def _named_texts(wanted: bytes) -> Callable:
    """(key, blob) of the texts of a task that may be wanted, copies of one text mostly once."""

    def run(batches):
        held, known = _may_hold(wanted), set()
        for b in batches:
            if len(known) > 1_000_000:
                known.clear()
            texts = [t for t in b.column("text").to_pylist() if t]
            keys = [digest(t) for t in texts]
            fresh = {k: t for k, t, x in zip(keys, texts, held(pa.array(keys, pa.binary())), strict=True) if x and k not in known}
            known |= fresh.keys()
            yield pa.RecordBatch.from_arrays([pa.array(fresh.keys(), pa.binary()), pa.array(compressed([*fresh.values()]), pa.binary())], ["key", "blob"])

    return run


def overlap(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts; 0 where neither has a word."""
    known: dict[str | None, int] = {}
    for t in [*a, *b]:
        known.setdefault(t, len(known))
    texts = list(known)
    owner, shingles, weights = _bags_in_parts(texts)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    total = np.bincount(owner, weights, len(texts))
    out = np.zeros(len(a))
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = known[x], known[y]
        sx, sy = shingles[ends[x] : ends[x + 1]], shingles[ends[y] : ends[y + 1]]
        if not len(sx) or not len(sy):
            continue
        at = np.minimum(np.searchsorted(sx, sy), len(sx) - 1)
        both = np.minimum(weights[ends[x] + at], weights[ends[y] : ends[y + 1]])[sx[at] == sy].sum()
        out[i] = both / (total[x] + total[y] - both)
    return out


def _verified(batches):
    for b in batches:
        a, c = b.column("blob_a"), b.column("blob_b")
        for lo in range(0, b.num_rows, 128):
            pair = [unpacked(x.slice(lo, 128).to_pylist()) for x in (a, c)]
            n = len(pair[0])
            yield pa.RecordBatch.from_arrays([b.column("a").slice(lo, n), b.column("b").slice(lo, n), pa.array(overlap(*pair))], ["a", "b", "similarity"])


def components(links: DataFrame) -> DataFrame:
    """(key, label): each key's smallest connected key, from links (a, b).

    Labels pass along links and then jump to their label's label until nothing changes; every step is a
    written table. The links of a key of very many are dealt to several tasks."""
    edges = stored(links.select("a", F.col("b").alias("key")).union(links.select("b", F.col("a").alias("key"))).distinct(), "links")
    degree = stored(edges.groupBy("key").agg(F.count("*").alias("n")), "degrees")
    labels = edges.groupBy("a").agg(F.min("key").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("label"))
    labels = stored(labels, "labels")
    while True:
        near = salted_join(edges, labels, "key", degree).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["key"] == near["a"]).select("key", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("key").alias("up"), F.col("label").alias("top"))
        step = step.join(up, step["label"] == up["up"], "left").select("key", "old", F.least("label", F.coalesce("top", "label")).alias("label"))
        step = stored(step, "labels")
        labels = step.select("key", "label")
        if step.filter("label < old").isEmpty():
            return labels


PAIR = "a binary, b binary, similarity double"


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id, n_copies, kept) of every row; see near_duplicate_classes. key names the row's text,
    kept marks the rows of one text of each class: one that the class's smallest id has."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = stored(rows.mapInArrow(lean(_signed), f"id {kind}, key binary, size long, bands array<long>, sig binary"), "signatures")
    # equal texts have equal signatures, so any of them will do; copies are combined before the shuffle
    nodes = stored(signed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("size", "bands", "sig")]), "texts")
    labels = _labels(rows, nodes)
    placed = nodes.select("key", "n", "least").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = stored(placed, "placed")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("first")
    classes = stored(placed.groupBy("label").agg(F.count("*").alias("n"), F.sum("n").alias("n_copies"), first), "classes")
    known = salted_join(placed, classes.select("label", "n_copies", F.col("first.least").alias("class_id"), F.col("first.key").alias("kept")), "label", classes)
    known = stored(known.select("key", "n", "class_id", "n_copies", "kept"), "known")
    joined = salted_join(signed.select("id", "key"), known.drop("n"), "key", known)
    return joined.select("id", "key", "class_id", "n_copies", F.lower(F.hex("kept")).alias("class_key"), ((F.col("key") == F.col("kept")) & F.col("id").eqNullSafe(F.col("class_id"))).alias("kept"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_copies, class_key): the class of every row, named by its smallest id, and the class's
    rows. class_key, the digest of the text that stays of the class, tells classes apart where ids repeat or are null.

    Equal texts are one class from the start; only different texts are compared. Within a bucket (texts with one
    band key) every text is compared with the bucket's first; a similarity of SIMILAR or more links them. Where
    the texts of a bucket then lie in a few different classes, each is compared with each class's first. Pairs
    that this leaves open, and buckets of many classes, as a passage in very many documents or copies at the very
    limit make, are searched as arrays in blocks of bounded size: first by signatures, then by the texts of
    those that have a candidate in another class, which are compared until they are linked. So no bucket is
    expanded into its pairs, and none is capped.

    Words are lower-cased and stand between white space. Texts without words equal only equal texts; null
    counts as empty. A text of one to four words has one shingle. Rows with equal ids are classed each by its own
    text. Null ids take part; a class of null ids only has a null class_id. Extra columns are left out; an empty
    table gives no rows.
    """
    return classified(docs, id_col, text_col).select(F.col("id").alias("doc_id"), "class_id", "n_copies", "class_key")


def _labels(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, label) of each text that another is linked with."""
    banded = nodes.select("key", "size", F.posexplode("bands").alias("place", "band"))
    shared = stored(banded.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("hub")).filter("n > 1"), "bands")
    # most bands are one text's, and most texts share none: they are left out before anything is shuffled
    some = nodes.select("key", "size", "bands").mapInArrow(lean(_banded(_filter(shared.select("band")))), "key binary, size long, place int, band long")
    buckets = stored(salted_join(some, shared.drop("n"), "band", shared), "buckets")
    wanted = buckets.select("key").distinct()
    named = rows.select("text").mapInArrow(lean(_named_texts(_filter(buckets.select("key")))), "key binary, blob binary")
    texts = stored(named.join(wanted, "key").dropDuplicates(["key"]), "candidates")
    star = buckets.filter(F.col("key") != F.col("hub.key")).filter(_may(F.col("size"), F.col("hub.size")))
    seen = _compared(star.select(F.col("key").alias("a"), F.col("hub.key").alias("b")), texts)
    while True:
        labels = components(seen.filter(F.col("similarity") >= SIMILAR))
        placed, classes, bands = _mixed(buckets, labels)
        new = stored(_hub_pairs(placed, classes, bands.filter(F.col("classes") <= MANY)).join(seen, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        seen = stored(seen.unionByName(_compared(new, texts)), "compared")
    # of few classes only pairs of two rows that are neither their class's first are open
    left = bands.filter((F.col("classes") > MANY) | (F.col("deep") > 1))
    if left.isEmpty():
        return labels
    found = _searched(stored(salted_join(placed, left.select("band", "n"), "band", bands), "left"), nodes, texts)
    return components(seen.filter(F.col("similarity") >= SIMILAR).unionByName(found))


def _may(a, b):
    """Whether multisets of these sizes can be similar enough."""
    return F.least(a, b) >= F.greatest(a, b) * SIMILAR - 1e-9


def _compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of keys, in a written table."""
    pairs = stored(pairs.distinct(), "pairs")
    count = lambda side: pairs.groupBy(side).agg(F.count("*").alias("n"))
    one = salted_join(pairs, texts.select(F.col("key").alias("a"), F.col("blob").alias("blob_a")), "a", count("a"))
    both = salted_join(one, texts.select(F.col("key").alias("b"), F.col("blob").alias("blob_b")), "b", count("b"), ["a"])
    return stored(both.select("a", "b", "blob_a", "blob_b").mapInArrow(lean(_verified), PAIR), "compared")


def _mixed(buckets: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: the rows of all buckets with their label; the number of rows of each class of a bucket and
    its first row; and of buckets of several classes the number of rows, of classes, and of classes of several
    rows (deep)."""
    placed = buckets.select("band", "place", "key", "size").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = stored(placed, "placed")
    classes = stored(placed.groupBy("band", "label").agg(F.count("*").alias("n"), F.min(F.struct("key", "size")).alias("first")), "classes")
    bands = classes.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.sum((F.col("n") > 1).cast("int")).alias("deep"))
    return placed, classes, stored(bands.filter("classes > 1"), "mixed")


def _hub_pairs(placed: DataFrame, classes: DataFrame, bands: DataFrame) -> DataFrame:
    """Each row of the given buckets with the first rows of the other classes, fewer than MANY pairs for a row."""
    hubs = classes.join(bands.select("band"), "band").select("band", F.col("label").alias("other"), "first")
    both = salted_join(placed.select("band", "label", "key", "size"), hubs, "band", bands, ["key"])
    both = both.filter((F.col("label") != F.col("other")) & _may(F.col("size"), F.col("first.size")))
    return both.select(F.greatest("key", "first.key").alias("a"), F.least("key", "first.key").alias("b")).distinct()


def _searched(left: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (PAIR's columns) that join the classes of buckets; left: (band, place, key, size, label, n) of their
    rows, n being the number of the bucket's rows."""
    signed = left.join(nodes.select("key", "sig", "bands"), "key")
    close = stored(_close(signed.select("*", F.col("place").alias("last"), F.col("band").alias("root"))).distinct(), "close")
    rows = left.drop("n").join(close.withColumnRenamed("root", "band"), ["band", "key"]).join(nodes.select("key", "sig"), "key").join(texts, "key")
    rows = stored(rows.select("band", "place", "key", "size", "label", "sig", "blob"), "close-texts")
    sizes = stored(rows.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.octet_length("blob")).alias("bytes"), (F.min("label") < F.max("label")).alias("mixed")).filter("mixed"), "sizes")
    rows = salted_join(rows, sizes.select("band", F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES).alias("parts")), "band", sizes, ["key"])
    blocked = _blocks(rows, F.col("parts"))
    return _by_block(blocked.select("band", "low", "high", "side", "place", "key", "size", "label", "sig", "blob"), _links, PAIR)


def _close(rows: DataFrame) -> DataFrame:
    """(root, key) of rows with a candidate of another class in their bucket, which is named by its first band (root);
    a pair counts in the first band that it shares. Large buckets are split by a further band
    that members share, DEEPER times, for similar texts share many; what is large even then is searched whole."""
    columns = ["root", "place", "band", "last", "key", "size", "label", "sig", "bands", "n"]
    rows, found = stored(rows.select(*columns), "members"), None
    for level in range(DEEPER + 1):
        large = rows.filter(F.col("n") > BLOCK_ROWS) if level < DEEPER else rows.limit(0)
        small = rows.filter(F.col("n") <= BLOCK_ROWS) if level < DEEPER else rows
        blocked = _blocks(small, F.col("n") / BLOCK_ROWS)
        here = _by_block(blocked.select("band", "low", "high", "side", "root", "place", "key", "size", "label", "sig"), _candidates, "root long, key binary")
        found = here if found is None else found.unionByName(here)
        if large.isEmpty():
            break
        after = F.posexplode(F.slice("bands", F.col("last") + 2, BANDS)).alias("step", "next")
        split = large.select("root", "place", F.col("band").alias("path"), F.col("last").alias("at"), "key", "size", "label", after)
        split = stored(split.select("root", "place", F.xxhash64("path", "next").alias("band"), (F.col("at") + F.col("step") + 1).alias("last"), "key", "size", "label"), "split")
        counts = split.groupBy("band").agg(F.count("*").alias("n"), (F.min("label") < F.max("label")).alias("mixed")).filter("mixed").drop("mixed")
        counts = stored(counts, "split-sizes")
        signed = large.select("key", "sig", "bands").dropDuplicates(["key"])
        rows = stored(salted_join(split, counts, "band", counts, ["key"]).join(signed, "key").select(*columns), "members")
    return found


def _blocks(rows: DataFrame, parts) -> DataFrame:
    """rows dealt to pairs of blocks (low, high) of their band, which has so many parts: each row once for each
    block of the band, with the side that it stands on."""
    parts = F.greatest(F.ceil(parts), F.lit(1)).cast("int")
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("side", (F.col("block") == F.col("high")).cast("int"))


def _by_block(rows: DataFrame, search: Callable, schema: str) -> DataFrame:
    """What search yields for each (band, low, high), given those rows' columns after these three as lists."""
    block = ["band", "low", "high"]
    names = [c for c in rows.columns if c not in block]

    def run(batches):
        current, held = None, {c: [] for c in names}
        for b in batches:
            keys = list(zip(*[b.column(c).to_pylist() for c in block], strict=True))
            cols = {c: b.column(c).to_pylist() for c in names}
            start = 0
            for i, key in enumerate(keys):
                if key != current:
                    for c in names:
                        held[c] += cols[c][start:i]
                    if len(held["key"]) > 1:
                        yield from search(held)
                    current, start, held = key, i, {c: [] for c in names}
            for c in names:
                held[c] += cols[c][start:]
        if len(held["key"]) > 1:
            yield from search(held)

    return rows.repartition(*block).sortWithinPartitions(*block, "key").mapInArrow(lean(run), schema)


def _candidates_of(x: int, place: int, sig: np.ndarray, label: np.ndarray, size: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Rows of another class, on the other side if there are two, that agree with row x in AGREE components, and
    share no band with it before the one at ``place``."""
    agree = (sig == sig[x]).sum(axis=1)
    near = np.flatnonzero((agree >= AGREE) & (label != label[x]) & (np.minimum(size, size[x]) >= np.maximum(size, size[x]) * SIMILAR - 1e-9) & (side != side[x] if side.any() and not side.all() else True))
    first = (sig[near] == sig[x]).reshape(len(near), BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)
    near = near[first == place]
    return near[np.argsort(-agree[near], kind="stable")]


def _arrays(held: dict[str, list]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    names: dict[bytes, int] = {}
    label = np.array([names.setdefault(x, len(names)) for x in held["label"]])
    return np.frombuffer(b"".join(held["sig"]), "<u2").reshape(-1, COMPONENTS), label, np.array(held["size"]), np.array(held["side"])


def _candidates(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    sig, label, size, side = _arrays(held)
    close = np.zeros(len(label), bool)
    for x in np.flatnonzero(label != np.bincount(label).argmax()):
        near = _candidates_of(x, held["place"][0], sig, label, size, side)
        close[near] = True
        close[x] |= len(near) > 0
    at = np.flatnonzero(close).tolist()
    if at:
        yield pa.RecordBatch.from_arrays([pa.array([held["root"][i] for i in at], pa.int64()), pa.array([held["key"][i] for i in at], pa.binary())], ["root", "key"])


def _links(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
    found = list(join_classes(held))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "similarity"])


def join_classes(held: dict[str, list]) -> Iterator[tuple[bytes, bytes, float]]:
    """(larger key, smaller key, similarity) links between different classes among the rows of one block, or
    across two. A pair is looked at in the first band that it shares."""
    sig, label, size, side = _arrays(held)
    owner, shingles, weights = _bags_in_parts(unpacked(held["blob"]))
    ends = np.searchsorted(owner, np.arange(len(sig) + 1))
    for x in np.flatnonzero(label != np.bincount(label).argmax()):
        near = _candidates_of(x, held["place"][0], sig, label, size, side)
        sx, wx = shingles[ends[x] : ends[x + 1]], weights[ends[x] : ends[x + 1]]
        for y in near:
            if label[y] == label[x]:
                continue
            sy, wy = shingles[ends[y] : ends[y + 1]], weights[ends[y] : ends[y + 1]]
            at = np.minimum(np.searchsorted(sx, sy), len(sx) - 1)
            both = np.minimum(wx[at], wy)[sx[at] == sy].sum()
            similarity = both / (size[x] + size[y] - both)
            if similarity >= SIMILAR:
                a, b = held["key"][x], held["key"][y]
                yield max(a, b), min(a, b), float(similarity)
                label[label == label[x]] = label[y]


def without_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, with one text of each class: a text that the class's smallest id has.

    Of rows with that id and text all stay, so repeated rows do, and so do rows without an id where no row of
    the class has one. Null texts count as empty: all empty texts are one class. An empty table stays empty."""
    names = ["_near_id", "_near_key"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    lost = classified(docs).filter("not kept").select(F.col("id").alias(names[0]), F.col("key").alias(names[1])).distinct()
    named = docs.withColumn("_text_key_" + names[1], text_digest("text"))
    own = named["_text_key_" + names[1]]
    return named.join(lost, named["doc_id"].eqNullSafe(lost[names[0]]) & (own == lost[names[1]]), "left_anti").select(*docs.columns)
