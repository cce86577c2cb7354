"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

Each word's edits are generated as hashes and probed against blocked Bloom filters of the vocabulary, one for each
length of word and part of its words. Only edits that a filter knows are written out as strings and shuffled to a
join with the vocabulary, which removes the false ones. A pair of words is found once: the longer word deletes, and
of two words of one length that with the smaller code point replaces. Hashes are polynomials in an odd base modulo
2**64, so an edit's hash follows from its word's prefix sums without making its string, whatever the word's length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, discard, mix, stored

#: Fixed value: a run of letters, after A-Z were lower-cased.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Distinct words that one task counts before it passes them on.
HELD = 200_000
#: Words of one filter; a length with more has several, by hash.
FILTER_WORDS = 1 << 15
#: Bits of a filter for each word; each word sets eight bits of one block of 512.
WORD_BITS = 16
#: Bytes of filters that are broadcast at once; more are probed in further rounds.
ROUND_BYTES = 64 << 20
#: Lengths from here on share filters by powers of two, so that the number of kinds of filters is bounded.
LONG = 64
#: Code points of words whose edits are probed at once.
BLOCK = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))


def _shifts(longest: int) -> np.ndarray:
    """What each byte of a crc32 becomes behind so many more bytes: by length, byte and its value. A crc32 is
    linear, so that of a text and a word is that of the text, shifted, xor that of the word alone."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ table[out[n] & 255]
    return out


_SHIFTED = _shifts(LONG)


class WordCounts(dict):
    """Counts words of texts; as a dict it numbers the runs of letters seen so far.

    A run whose crc32 behind its text's id and a colon is a multiple of ``every`` loses one code point first; a
    null id is written as nothing."""

    def __init__(self, every: int = 97):
        super().__init__()
        self.every, self.edited = every, Counter()
        self.runs: list[str] = []
        self.known = 0
        self.crc, self.size, self.n = np.zeros(1 << 12, np.uint32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def __missing__(self, run: str) -> int:
        n = self[run] = len(self.runs)
        self.runs.append(run)
        return n

    def _learn(self) -> None:
        fresh = [r.encode() for r in self.runs[self.known :]]
        grow = len(self.runs) - len(self.n)
        if grow > 0:
            self.crc, self.size, self.n = (np.append(x, np.zeros(max(grow, len(x)), x.dtype)) for x in (self.crc, self.size, self.n))
        self.crc[self.known : len(self.runs)] = [zlib.crc32(r) for r in fresh]
        self.size[self.known : len(self.runs)] = [len(r) for r in fresh]
        self.known = len(self.runs)

    def add(self, texts: list[str | None], ids: list) -> None:
        found = [RUN.findall(t.encode().lower().decode()) if t else [] for t in texts]
        seeds = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(found)), np.int64, int(counts.sum()))
        self._learn()
        owner, size = np.repeat(np.arange(len(texts)), counts), self.size[at]
        long = np.flatnonzero(size > LONG)
        size[long] = 0
        seed, h = seeds[owner], self.crc[at]
        for byte in range(4):
            h ^= _SHIFTED[size, byte, (seed >> np.uint32(8 * byte)) & np.uint32(255)]
        h[long] = [zlib.crc32(self.runs[a].encode(), int(s)) for a, s in zip(at[long].tolist(), seed[long].tolist(), strict=True)]
        hit = h % np.uint32(self.every) == 0
        self.n[: self.known] += np.bincount(at[~hit], minlength=self.known)
        for a, x in zip(at[hit].tolist(), h[hit].tolist(), strict=True):
            run = self.runs[a]
            self.edited[run[: x % len(run)] + run[x % len(run) + 1 :]] += 1

    def items_of(self, shortest: int) -> tuple[list[str], list[int]]:
        """Words of at least so many code points, and how often each occurred; a word may stand twice."""
        plain = [(r, n) for r, n in zip(self.runs, self.n.tolist(), strict=False) if n and len(r) >= shortest]
        rows = plain + [(r, n) for r, n in self.edited.items() if len(r) >= shortest]
        return [r for r, _ in rows], [n for _, n in rows]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): how often each word of at least ``shortest`` code points occurs, if at least ``least`` times.

    Words are runs of letters with A-Z lower-cased, some of which lose a code point (see WordCounts). Null and
    empty texts have none; repeated rows count again; an empty table gives no rows. Tasks add up words before the
    shuffle, so a word that a third of all rows hold is one short row of each task."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        held = WordCounts(every)
        row = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held.items_of(shortest), (pa.string(), pa.int64()), strict=True)], ["word", "n"])
        for b in batches:
            ids, texts = b.column("id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in blocks(texts, 1 << 20):
                held.add(texts[lo:hi], ids[lo:hi])
                if len(held.runs) + len(held.edited) > HELD:
                    yield row()
                    held = WordCounts(every)
        yield row()

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Symbols:
    """Code points of words in one array, with what their edits' hashes need."""

    def __init__(self, words: list[str]):
        self.words = words
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(words)), self.sizes)
        self.place = np.arange(len(self.chars)) - self.first[self.owner]
        powers = np.cumprod(np.append(np.uint64(1), np.full(int(self.sizes.max(initial=0)), _BASE, np.uint64)))
        self.power = powers[self.place]
        sums = np.append(np.uint64(0), np.cumsum(self.chars * self.power))
        self.before = sums[:-1] - sums[self.first][self.owner]
        self.whole = sums[self.first + self.sizes] - sums[self.first]

    def deleted(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of words without one code point; of equal neighbours only the first is taken out."""
        at = np.flatnonzero((self.place == 0) | (self.chars != np.append(np.uint64(0), self.chars[:-1])))
        after = self.whole[self.owner[at]] - self.before[at] - self.chars[at] * self.power[at]
        return at, self.before[at] + after * _BACK

    def replaced(self, by: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of words with one smaller code point replaced."""
        at = np.flatnonzero(self.chars < np.uint64(by))
        return at, self.whole[self.owner[at]] + (np.uint64(by) - self.chars[at]) * self.power[at]


def kind_of(sizes: np.ndarray) -> np.ndarray:
    """The number of a length's filters: the length itself, or one for each power of two from LONG on."""
    return np.where(sizes < LONG, sizes, LONG + np.log2(np.maximum(sizes, 1)).astype(np.int64))


class Filters:
    """Where each length's filters lie, and the bits of those of one round.

    parts: number of filters for each kind of length. A filter has one block of 512 bits for so many words."""

    def __init__(self, parts: dict[int, int], blocks: int):
        self.parts = np.zeros(LONG + 64, np.int64)
        for kind, n in parts.items():
            self.parts[kind] = n
        self.first = np.cumsum(self.parts) - self.parts
        self.blocks, self.total = blocks, int(self.parts.sum())
        self.low = self.high = 0
        self.bits = np.zeros(0, np.uint64)

    def shards(self, hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mixed hashes, and the filter of each (-1: no word has that length)."""
        kind = kind_of(sizes)
        mixed = mix(hashes + sizes.astype(np.uint64) * _BASE)
        parts = self.parts[kind]
        shard = self.first[kind] + (mixed >> np.uint64(33)).astype(np.int64) % np.maximum(parts, 1)
        return mixed, np.where(parts > 0, shard, -1)

    def _bits_of(self, mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        again = mix(mixed ^ _BASE)
        return (again >> np.uint64(48)).astype(np.int64) * self.blocks >> 16, again

    def build(self, mixed: np.ndarray) -> bytes:
        """Bits of one filter that knows these words."""
        bits = np.zeros(self.blocks * 8, np.uint64)
        block, again = self._bits_of(mixed)
        for i in range(8):
            np.bitwise_or.at(bits, block * 8 + i, np.uint64(1) << ((again >> np.uint64(6 * i)) & np.uint64(63)))
        return bits.tobytes()

    def holds(self, mixed: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Positions of words that the filters of this round may know."""
        left = np.flatnonzero((shard >= self.low) & (shard < self.high))
        block, again = self._bits_of(mixed[left])
        at = ((shard[left] - self.low) * self.blocks + block) * 8
        for i in range(8):
            hit = np.flatnonzero((self.bits[at + i] >> ((again >> np.uint64(6 * i)) & np.uint64(63))) & np.uint64(1))
            left, at, again = left[hit], at[hit], again[hit]
        return left


def _by_block(batches, *columns):
    """Columns of batches in blocks of about BLOCK code points of the first."""
    for b in batches:
        rows = [b.column(c).to_pylist() for c in columns]
        start = total = 0
        for i, word in enumerate(rows[0]):
            total += len(word)
            if total > BLOCK or i + 1 == len(rows[0]):
                yield [r[start : i + 1] for r in rows]
                start, total = i + 1, 0


def near_pairs(words: DataFrame, filter_words: int = FILTER_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, near, m): all pairs of words that differ by exactly one edit, each once, with their counts.

    words: (word, n), each word once; it is read again in each round and should be stored. What is broadcast is
    bounded by round_bytes; a larger vocabulary takes more rounds, each stored."""
    spark = words.sparkSession
    words = words.filter(F.col("word").isNotNull())
    size = F.length("word")
    kind = F.when(size < LONG, size).otherwise(LONG + F.floor(F.log2(size)).cast("int"))
    counts = {r["k"]: r["n"] for r in words.groupBy(kind.alias("k")).agg(F.count("*").alias("n")).collect()}
    n_blocks = max(1, -(-min(filter_words, max(counts.values(), default=1)) * WORD_BITS // 512))
    filters = Filters({k: -(-n // filter_words) for k, n in counts.items()}, n_blocks)
    alphabet = sorted(ord(r["c"]) for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c != ''").distinct().collect())

    def hashes(batches):
        for (ws,) in _by_block(batches, "word"):
            s = Symbols(ws)
            mixed, shard = filters.shards(s.whole, s.sizes)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(mixed.view(np.int64))], ["shard", "h"])

    def build(group: pa.Table) -> pa.Table:
        mixed = group.column("h").to_numpy().view(np.uint64)
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "bits": pa.array([filters.build(mixed)], pa.binary())})

    known = words.select("word").mapInArrow(hashes, "shard int, h long").groupBy("shard").applyInArrow(build, "shard int, bits binary")
    built = stored(known, "word-filters")
    step = max(1, round_bytes // (n_blocks * 64))
    found = []
    for low in range(0, filters.total, step):
        high = min(low + step, filters.total)
        bits = np.zeros((high - low, n_blocks * 8), np.uint64)
        for r in built.filter(F.col("shard").between(low, high - 1)).collect():
            bits[r["shard"] - low] = np.frombuffer(r["bits"], np.uint64)
        shared = spark.sparkContext.broadcast(bits.ravel())
        found.append(stored(_positives(words, filters, shared, low, high, alphabet), "word-edits"))
        shared.destroy()
    discard(built)
    if not found:
        return words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("m")).limit(0)
    edits = found[0]
    for more in found[1:]:
        edits = edits.unionByName(more)
    return edits.join(words.select(F.col("word").alias("near"), F.col("n").alias("m")), "near").select("word", "n", "near", "m")


def _positives(words: DataFrame, filters: Filters, shared, low: int, high: int, alphabet: list[int]) -> DataFrame:
    """(word, n, near): edits that a filter of this round knows."""

    def run(batches):
        filters.low, filters.high, filters.bits = low, high, shared.value
        for ws, ns in _by_block(batches, "word", "n"):
            s = Symbols(ws)
            at, edit, by = [], [], []
            for char in (None, *alphabet):
                places, hashes = s.deleted() if char is None else s.replaced(char)
                mixed, shard = filters.shards(hashes, s.sizes[s.owner[places]] - (char is None))
                hit = filters.holds(mixed, shard)
                at.append(places[hit])
                by += ["" if char is None else chr(char)] * len(hit)
            at = np.concatenate(at)
            owner, place = s.owner[at].tolist(), s.place[at].tolist()
            edit = [(w := ws[o])[:p] + c + w[p + 1 :] for o, p, c in zip(owner, place, by, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([ws[o] for o in owner], pa.string()), pa.array([ns[o] for o in owner], pa.int64()), pa.array(edit, pa.string())], ["word", "n", "near"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, near string")


def with_roots(forms: DataFrame) -> DataFrame:
    """forms with a column root: the end of the chain of forms that a word begins, the word itself if it has none.

    forms: a stored table with word and form, each word once and no circle. Each round joins every word's pointer
    with the pointer of where it points, so a chain of k words takes about log2(k) rounds; only words with a form
    take part, and their counts double along a chain, so chains are short."""
    ahead = stored(forms.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "word-roots")
    while True:
        further = ahead.select(F.col("word").alias("to"), F.col("to").alias("next"))
        step = stored(ahead.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "word-roots")
        discard(ahead)
        ahead = step.select("word", "to")
        if step.filter("moved").isEmpty():
            break
    return forms.join(ahead.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(words: DataFrame, ratio: int = 2, filter_words: int = FILTER_WORDS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of (word, n).

    n_near counts the words one edit away. form is the one of these with the largest n, the smallest in code-point
    order among equals, if that n is at least ``ratio`` times the word's own; else it is null, as is form_n. root
    is where following forms ends. Each word stands once in words; null words are left out; an empty table gives
    no rows; words of any length take part."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")).filter(F.col("word").isNotNull()), "words")
    pairs = near_pairs(words, filter_words, round_bytes)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near"), (-F.col("m")).alias("order")), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), (-F.col("n")).alias("order")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("order", "near")).alias("best"))
    enough = -F.col("best.order") >= ratio * F.col("n")
    forms = words.join(best, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.order")).alias("form_n"),
    )
    return with_roots(stored(forms, "word-forms"))


def twin_sql(every: int = 97, shortest: int = 5, least: int = 3, ratio: int = 2) -> str:
    """count_words and variants in SQL: crc32 byte by byte, and pairs by shared patterns with one code point left out."""
    table = ",".join(str(int(_SHIFTED[1, 0, b])) for b in range(256))
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT [{table}]::UBIGINT[] AS t),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({lower}, '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
crc AS (SELECT run, n, xor(4294967295::UBIGINT, list_reduce(
    list_transform(range(len(x) // 2), lambda i: (position(x[2 * i + 1] IN '0123456789ABCDEF') * 16 + position(x[2 * i + 2] IN '0123456789ABCDEF') - 17)::UBIGINT),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT)) AS h FROM hexed, steps),
edited AS (SELECT CASE WHEN h % {every} = 0 THEN run[: (h % length(run))::BIGINT] || run[(h % length(run))::BIGINT + 2 :] ELSE run END AS word, n FROM crc),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM edited WHERE length(word) >= {shortest} GROUP BY word HAVING sum(n) >= {least}),
gaps AS (SELECT word, n, i, word[: i - 1] AS a, word[i + 1 :] AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word, y.word AS near, y.n AS m FROM gaps x JOIN gaps y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT g.word, w.word, w.n FROM gaps g JOIN words w ON w.word = g.a || g.b
    UNION SELECT w.word, g.word, g.n FROM gaps g JOIN words w ON w.word = g.a || g.b),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN near END AS form, CASE WHEN m >= {ratio} * n THEN m END AS form_n
    FROM words LEFT JOIN best ON best.word = words.word),
chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL),
roots AS (SELECT chain.word, root FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN roots ON roots.word = forms.word"""
