"""Toxicity by a convolutional text classifier.

A word's embedding is the sum of three rows of one table, found by hashes of the word and of its first four
and six bytes. Filters of widths 1 to 3 slide over the words of a text, each filter's largest response is
kept, and a logistic layer scores those. Training is plain numpy on all labelled rows: tasks train side by side,
and after each pass the networks that they come to are averaged; table rows that few training texts use, or that say
little about the label, stay zero, so chance words say nothing, and only the words around telling ones are stored.
The score is shifted so that 0.5 is
the best cut on held-back training rows, and each language gets a threshold of its own where it has examples.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, forget, give_back, lean, stored, word_hashes

TABLE_BITS = 21
WIDTH_SIZES = (1, 2, 3)
EMBEDDING, FILTERS = 8, 8
GAP = max(WIDTH_SIZES) - 1
#: Labelled rows, and bytes of their telling words, that a task holds at once; table rows of the network.
CHUNK_ROWS, CHUNK_BYTES, TABLE_ROWS = 12_000, 32_000_000, (1 << 16) - 1
#: Tasks that train side by side at most, each on all of its rows, and networks that the driver averages at once.
MOST_PARTS, MOST_SENT = 64, 8
#: Passes over the training rows, and the seed of their order.
EPOCHS, SEED = 8, 7
#: Training texts that must use a table row, and standard errors by which its use must differ by label.
LEAST_USE, LEAST_Z = 3, 3.0


def word_slots(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A table slot for each of a word's three hashes (rows of 3), and the number of words of each text."""
    whole, counts, four, six = word_hashes(texts, punctuation=True, prefixes=(4, 6))
    shift = np.uint64(64 - TABLE_BITS)
    tagged = [whole, four ^ np.uint64(0x5851F42D4C957F2D), six ^ np.uint64(0x14057B7EF767814F)]
    return np.stack([(h >> shift).astype(np.int32) for h in tagged], axis=1), counts


def _padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows with GAP + 1 zero rows after each text, and where each text begins."""
    begins = np.cumsum(counts + GAP + 1) - (counts + GAP + 1)
    out = np.zeros((int((counts + GAP + 1).sum()), rows.shape[1]), rows.dtype)
    out[np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * (GAP + 1), counts)] = rows
    return out, begins


@dataclass
class TextCnn:
    """active: slots of the rows of ``table`` from the second on; the first is all zero and stands for all other
    slots. shift: score = sigmoid(logit - shift)."""

    active: np.ndarray
    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float = 0.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @cached_property
    def rows(self) -> np.ndarray:
        return row_numbers(self.active)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rows"}

    def logits(self, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return self.pooled(index, begins) @ self.out + self.out_bias

    def responses(self, index: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Responses of the filters wherever a window holds a row that isn't zero, those places, and their
        texts. Elsewhere, and in the gap after each text, all responses are zero."""
        some = index.any(axis=1)
        reach = some.copy()
        for j in range(1, GAP + 1):
            reach[:-j] |= some[j:]
        at = np.flatnonzero(reach)
        owner = np.searchsorted(begins, at, "right") - 1
        # a window that begins in the gap would see the next text's first words
        inside = at - begins[owner] < (np.diff(np.append(begins, len(index))) - (GAP + 1))[owner]
        at, owner = at[inside], owner[inside]
        out = np.zeros((len(at), FILTERS * len(self.filters)), np.float32)
        for j in range(GAP + 1):
            r = index[at + j]
            x = self.table[r[:, 0]] + self.table[r[:, 1]] + self.table[r[:, 2]]
            for k, w in enumerate(self.filters):
                if j < len(w):
                    out[:, k * FILTERS : (k + 1) * FILTERS] += x @ w[j]
        return out, at, owner

    def pooled(self, index: np.ndarray, begins: np.ndarray) -> np.ndarray:
        raw, _, owner = self.responses(index, begins)
        top = np.zeros((len(begins), raw.shape[1]), np.float32)
        if len(raw):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            top[owner[start]] = np.maximum(np.maximum.reduceat(raw, start, axis=0), 0)
        return np.maximum(top + self.bias, 0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = [np.zeros(0)]
        for lo, hi in blocks(texts, 1 << 18):
            slots, counts = word_slots(texts[lo:hi])
            logit = self.logits(*_padded(self.rows[slots], counts))
            out.append(1 / (1 + np.exp(-np.clip(logit - self.shift, -40, 40))))
        return np.concatenate(out)


def row_numbers(active: np.ndarray) -> np.ndarray:
    """The table row of each slot; 0 for slots that aren't active."""
    rows = np.zeros(1 << TABLE_BITS, np.int32)
    rows[active] = np.arange(1, len(active) + 1)
    return rows


def around_active(index: np.ndarray) -> np.ndarray:
    """The words of a text that a window with a telling word can hold; runs of others become shorter but stay
    longer than a window reaches, so no response of such a window changes."""
    some = index.any(axis=1)
    keep = some.copy()
    for j in range(1, GAP + 1):
        keep[:-j] |= some[j:]
        keep[j:] |= some[:-j]
    return index[keep]


def gradients(net: TextCnn, index: np.ndarray, begins: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean weighted log loss, by table, filters, bias, out and out_bias."""
    n, size = len(begins), FILTERS * len(net.filters)
    raw, at, owner = net.responses(index, begins)
    top, where = np.zeros((n, size), np.float32), np.zeros((n, size), np.int64)
    for i, (b, e) in enumerate(zip(*np.searchsorted(owner, [np.arange(n), np.arange(1, n + 1)]), strict=True)):
        if e > b:
            best = raw[b:e].argmax(axis=0)
            top[i], where[i] = raw[b:e][best, np.arange(size)], at[b + best]
    found = top > 0
    pool = np.maximum(np.where(found, top, 0) + net.bias, 0)
    p = 1 / (1 + np.exp(-(pool @ net.out + net.out_bias)))
    err = ((p - labels) * weight / n).astype(np.float32)
    d_pool = np.outer(err, net.out) * (pool > 0)
    d_table, d_filters = np.zeros_like(net.table), [np.zeros_like(w) for w in net.filters]
    for k, w in enumerate(net.filters):
        own = slice(k * FILTERS, (k + 1) * FILTERS)
        text, c = np.nonzero(d_pool[:, own] * found[:, own])
        d, place = d_pool[:, own][text, c][:, None], where[:, own][text, c]
        for j in range(len(w)):
            r = index[place + j]
            np.add.at(d_filters[k][j].T, c, d * net.table[r].sum(1))
            np.add.at(d_table, r.ravel(), np.repeat(d * w[j].T[c], 3, axis=0))
    d_table[0] = 0
    return [d_table, *d_filters, d_pool.sum(0), err @ pool, np.array([err.sum()], np.float32)]


@dataclass
class Training:
    """A network in training: its parameters and their two moments (see arrays), and the steps taken."""

    net: TextCnn
    first: list[np.ndarray]
    second: list[np.ndarray]
    level: np.ndarray
    step: int = 0

    def arrays(self) -> list[np.ndarray]:
        net = self.net
        return [net.table, *net.filters, net.bias, net.out, self.level]

    def epoch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of Adam over texts given as table rows of their words."""
        params = self.arrays()
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), 32):
            some = order[lo : lo + 32]
            index, begins = _padded(np.concatenate([texts[i] for i in some]).astype(np.int32), np.array([len(texts[i]) for i in some]))
            index[rng.random(len(index)) < 0.1] = 0  # words left out at random
            self.step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
            for q, g, m, v in zip(params, gradients(self.net, index, begins, labels[some], weight[some]), self.first, self.second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * m / (np.sqrt(v) + 1e-6)
            self.net.out_bias = float(self.level[0])


def untrained(active: np.ndarray) -> Training:
    rng = np.random.default_rng(SEED)
    table = rng.normal(0, 0.1, (len(active) + 1, EMBEDDING)).astype(np.float32)
    table[0] = 0
    filters = [rng.normal(0, 0.4, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTH_SIZES]
    size = FILTERS * len(filters)
    net = TextCnn(active, table, filters, np.zeros(size, np.float32), rng.normal(0, 0.3, size).astype(np.float32))
    params = [net.table, *net.filters, net.bias, net.out, np.zeros(1, np.float32)]
    return Training(net, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], params[-1])


def weighed(state: Training, uses: np.ndarray, rows: int, steps: int) -> np.ndarray:
    """Parameters and moments times what they count for, after these counts: a row of the table counts by its uses in
    the rows that this state was trained on, all others by the number of these rows."""
    out = [np.array([rows, steps], np.float64), uses.astype(np.float64)]
    for kind in (state.arrays(), state.first, state.second):
        out.append((kind[0] * uses[:, None]).ravel())
        out += [x.ravel().astype(np.float64) * rows for x in kind[1:]]
    return np.concatenate(out)


def averaged(state: Training, total: np.ndarray, parts: int) -> None:
    """Sets state to the mean of the states whose ``weighed`` arrays add up to total; unused table rows stay."""
    rows, size = total[0], len(state.net.table)
    uses = total[2 : 2 + size]
    state.step += max(1, round(total[1] / parts))
    at, used = 2 + size, uses > 0
    for kind in (state.arrays(), state.first, state.second):
        for k, x in enumerate(kind):
            part = total[at : at + x.size].reshape(x.shape)
            at += x.size
            if k == 0:
                x[used] = part[used] / uses[used][:, None]
            elif rows:
                x[...] = part / rows
    state.net.table[0] = 0
    state.net.out_bias = float(state.level[0])


def _best_cut(scores: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> float:
    """The middle of the gap at which F1 is largest, of distinct scores with so many toxic rows of so many rows."""
    order = np.argsort(-scores, kind="stable")
    s, hit, n = scores[order], np.cumsum(toxic[order]), np.cumsum(rows[order])
    f1 = 2 * hit / (n + max(1, toxic.sum()))
    best = int(np.argmax(f1))
    return float((s[best] + (s[best + 1] if best + 1 < len(s) else s[best] - 1)) / 2)


def _per_text(found):
    """Rows of word slots of each text of a list."""
    for t in found:
        yield word_slots([t])[0]


def _chunks(batches, rows: int, size: int):
    """(words, toxic) of batches in chunks of at most so many rows, and bytes unless of one row, in order of place."""
    held, total = [], 0
    for b in batches:
        for row in zip(b.column("place").to_pylist(), b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            if held and (len(held) == rows or total + len(row[1]) > size):
                yield sorted(held)
                held, total = [], 0
            held.append(row)
            total += len(row[1])
    if held:
        yield sorted(held)


def _trained(words: DataFrame, state: Training, counts: dict[int, int], epochs: int, chunk_rows: int, chunk_bytes: int) -> None:
    """Trains state in place on all rows of words (place, toxic, words): a pass is a job whose tasks train copies of it
    side by side on their rows, chunk by chunk; copies are added up by MOST_SENT tasks and averaged by the driver."""
    total = sum(counts.values())
    by_label = np.array([total / (2 * max(1, counts.get(y, 0))) for y in (0, 1)])
    parts = max(1, min(MOST_PARTS, -(-total // chunk_rows)))

    def job(epoch: int) -> DataFrame:
        def run(batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            rng = np.random.default_rng([SEED, epoch, part])
            mine = pickle.loads(sent)
            before, rows, uses = mine.step, 0, np.zeros(len(mine.net.table), np.int64)
            for chunk in _chunks(batches, chunk_rows, chunk_bytes):
                texts = [np.frombuffer(w, "<u2").reshape(-1, 3) for _, w, _ in chunk]
                y = np.array([t for _, _, t in chunk])
                mine.epoch(texts, y, by_label[y], rng)
                rows += len(chunk)
                uses += np.bincount(np.concatenate(texts).ravel(), minlength=len(uses))
            if rows:
                blob = weighed(mine, uses, rows, mine.step - before).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part % MOST_SENT], pa.int32()), pa.array([1], pa.int32()), pa.array([blob], pa.binary())], ["to", "n", "blob"])

        sent = pickle.dumps(state)
        return words.coalesce(parts).mapInArrow(lean(run), "to int, n int, blob binary")

    def added(batches):
        sums, n = {}, {}
        for b in batches:
            for to, k, blob in zip(b.column("to").to_pylist(), b.column("n").to_pylist(), b.column("blob").to_pylist(), strict=True):
                x = np.frombuffer(blob, np.float64)
                sums[to] = sums[to] + x if to in sums else x
                n[to] = n.get(to, 0) + k
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(n.values()), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["n", "blob"])

    for epoch in range(epochs):
        copies = job(epoch)
        if parts > MOST_SENT:
            copies = copies.repartition(MOST_SENT, "to")
        found = copies.mapInArrow(lean(added), "n int, blob binary").toArrow()
        sums = [np.frombuffer(x, np.float64) for x in found.column("blob").to_pylist()]
        averaged(state, np.sum(sums, axis=0), sum(found.column("n").to_pylist()))


def fit(docs: DataFrame, labels: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES, least: int = 20) -> TextCnn | None:
    """Trains on all labelled rows whose crc32(doc_id as text) mod 5 is not 0, in chunks of chunk_rows rows and
    chunk_bytes bytes of telling words at most.

    A fifth of them (remainder 1) is kept back to shift the score and to find a threshold for each language
    with ``least`` examples of both labels; their scores are counted by thousandths of a logit. Null labels and ids are
    left out; of several labels of one id the larger counts, and a repeated row counts again. None if either label is
    missing.

    The driver gets at most TABLE_ROWS telling slots, MOST_SENT sums of networks a pass, and counts by language and
    rounded logit."""
    usable = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    rows = docs.filter(fold != 0).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(usable, "doc_id")
    sample = stored(rows.select(F.xxhash64("doc_id", "text").alias("place"), "toxic", (fold == 1).alias("back"), "text", "lang"), "toxicity-sample")
    held = {(r["toxic"], r["back"]): r["n"] for r in sample.groupBy("toxic", "back").agg(F.count("*").alias("n")).collect()}
    if len({y for y, _ in held}) < 2:
        return None
    some_back = len(held) == 4
    if not some_back:
        sample = sample.withColumn("back", F.lit(False))
    number = {y: sum(n for (z, b), n in held.items() if z == y and not (some_back and b)) for y in (0, 1)}

    def uses(batches):
        use = np.zeros((2, 1 << TABLE_BITS), np.int32)
        for b in batches:
            for y, s in zip(b.column("toxic").to_pylist(), _per_text(b.column("text").to_pylist()), strict=True):
                use[y, np.unique(s)] += 1
        some = np.flatnonzero(use.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(use[0, some]), pa.array(use[1, some])], ["slot", "clean", "toxic"])

    used = sample.filter("not back").select("toxic", "text").mapInArrow(lean(uses), "slot int, clean int, toxic int").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n0, n1 = (float(max(1, number[y])) for y in (0, 1))
    share = (F.col("clean") + F.col("toxic")) / (n0 + n1)
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n0 + 1 / n1))
    z = F.abs(F.col("toxic") / n1 - F.col("clean") / n0) / error
    telling = used.filter((F.col("clean") + F.col("toxic") >= LEAST_USE) & (z >= LEAST_Z)).orderBy(z.desc(), "slot").limit(TABLE_ROWS).select("slot")
    active = np.sort(telling.toArrow().column("slot").to_numpy())

    def telling_words(batches):
        numbers = row_numbers(active)
        for b in batches:
            words = [around_active(numbers[s]).astype("<u2").tobytes() for s in _per_text(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(b.column, names[:-1]), pa.array(words, pa.binary())], names)

    names = ["place", "toxic", "back", "lang", "words"]
    words = stored(sample.select(*names[:-1], "text").mapInArrow(lean(telling_words), "place long, toxic int, back boolean, lang string, words binary"), "toxicity-words")
    state = untrained(active)
    _trained(words.filter("not back").select("place", "toxic", "words"), state, number, EPOCHS, chunk_rows, chunk_bytes)
    net = state.net

    def logits(batches):
        for b in batches:
            texts = [np.frombuffer(w, "<u2").reshape(-1, 3) for w in b.column("words").to_pylist()]
            found = np.concatenate([np.zeros(0), *[net.logits(*_padded(t.astype(np.int32), np.array([len(t)]))) for t in texts]])
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(np.clip(found, -40, 40).astype(np.float64))], ["lang", "toxic", "logit"])

    check = words.filter("back") if some_back else words
    logit = F.round("logit", 3).alias("logit")
    counts = check.select("lang", "toxic", "words").mapInArrow(lean(logits), "lang string, toxic int, logit double").groupBy("lang", logit).agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).toPandas()
    whole = counts.groupby("logit", as_index=False)[["toxic", "rows"]].sum()
    net.shift = _best_cut(whole["logit"].to_numpy(), whole["toxic"].to_numpy(), whole["rows"].to_numpy())
    counts["s"] = 1 / (1 + np.exp(-np.clip(counts["logit"] - net.shift, -40, 40)))
    for lang, part in counts.groupby("lang"):
        if min(part["toxic"].sum(), (part["rows"] - part["toxic"]).sum()) >= least:
            net.thresholds[str(lang)] = float(np.clip(_best_cut(*(part[c].to_numpy() for c in ("s", "toxic", "rows"))), 0.05, 0.95))
    return net


def with_score(docs: DataFrame, net: TextCnn | None, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with a score column (0 to 1), from the text alone; 0 throughout without a network.

    Null texts are scored as empty ones, whole texts whatever their length, each row by itself, so equal texts have
    equal scores and repeated rows stay. An empty table gives no rows."""
    if net is None:
        return docs.withColumn(name, F.lit(0.0))

    @F.pandas_udf("double")  # the network, a table of bounded size, travels with the function
    def score(texts: pd.Series) -> pd.Series:
        forget()
        found = pd.Series(net.scores([t if isinstance(t, str) else None for t in texts]))
        give_back()
        return found

    return docs.withColumn(name, score(F.col(text_col)))


def threshold(net: TextCnn | None, lang: str = "lang"):
    """The row's threshold: its language's, or 0.5 where that has none."""
    limits = net.thresholds if net else {}
    if not limits:
        return F.lit(0.5)
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return F.coalesce(F.element_at(table, F.col(lang)), F.lit(0.5))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, in all their columns, that score below their language's threshold.

    Rows are judged one by one: null ids, repeated rows and ties stay or go by their text alone. Null texts count
    as empty; an empty table, or labels of one kind only, leave docs as it is."""
    net = fit(docs, labels)
    name = "_toxicity_score"
    while name in docs.columns:
        name += "_"
    return with_score(docs, net, name).filter(F.col(name) < threshold(net)).drop(name)
