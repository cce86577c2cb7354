"""Quality by importance resampling.

Two generative models of hashed n-grams, one of target text (rows labelled as good) and one of all raw text,
give each document the log ratio of its likelihoods. Documents are sampled without replacement in proportion
to that ratio by Gumbel top-k: the k largest of log weight plus Gumbel noise.

An n-gram is a word or run of punctuation, a pair of neighbours, or the mark of a word repeated at once.
Ratios are per n-gram, times a fixed number of n-grams, so that long documents don't outweigh short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.llm.common import blocks, forget, give_back, lean, mix, stored, word_hashes

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: A document's weight is that of so many n-grams with its mean ratio.
WEIGHT_NGRAMS = 50
#: Labelled rows that the target model and the cut are fitted on at most.
SAMPLE_ROWS = 10_000
#: One labelled row in so many finds the cut, the others the target model.
CUT_SHARE = 4
_REPEAT = 0


def ngram_buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each text: first of its words, then of its pairs; and their number."""
    words, counts = word_hashes(texts, punctuation=True, lower=False)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    slot = lambda h: (1 + (h >> np.uint64(64 - BUCKET_BITS)) % np.uint64(BUCKETS - 1)).astype(np.int64)
    second = np.where(words[:-1] == words[1:], _REPEAT, slot(pair))
    inside = owner[:-1] == owner[1:]
    owner = np.concatenate([owner, owner[:-1][inside]])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([slot(words), second[inside]])[order], np.bincount(owner, minlength=len(texts))


@dataclass
class Ratio:
    """log of target over raw probability of each bucket."""

    log_ratio: np.ndarray

    def means(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log ratio and number of n-grams of each text; 0 for a text without words."""
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for lo, hi in blocks(texts):
            buckets, counts = ngram_buckets(texts[lo:hi])
            owner = np.repeat(np.arange(hi - lo), counts)
            sums[lo:hi] = np.bincount(owner, self.log_ratio[buckets], hi - lo)
            sizes[lo:hi] = counts
        return sums / np.maximum(sizes, 1), sizes


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """n-grams in each bucket over all texts; each task adds up its own first."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            held = b.column("text").to_pylist()
            for lo, hi in blocks(held):
                total += np.bincount(ngram_buckets(held[lo:hi])[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(lean(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS)
    for bucket, n in rows.collect():  # one row for each of a fixed number of buckets
        out[bucket] = n
    return out


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    usable = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("cut", F.crc32(F.col("doc_id").cast("string")) % CUT_SHARE == 0)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[Ratio | None, float]:
    """The ratio, and the mean log ratio that parts good from bad labelled rows best (balanced accuracy).

    The raw model counts all of docs; the target model and the cut use at most ``sample_rows`` labelled rows: one
    in CUT_SHARE for the cut, which the target model does not count, and the others for the target model (all for
    both where the cut's rows lack a label). Without good rows there is no ratio; without bad ones the cut is
    below every row. Of rows with equal ids, the smallest ratio counts for the cut."""
    sample = F.broadcast(_sample(labels, sample_rows))  # sample_rows rows of three values at most
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    held = {(bool(r["good"]), r["cut"]) for r in texts.groupBy((F.col("quality") > 0).alias("good"), "cut").count().collect()}
    apart = {(True, True), (False, True), (True, False)} <= held
    target = bucket_counts(texts.filter("quality > 0 and not cut" if apart else "quality > 0"))
    if not target.sum():
        return None, -np.inf
    raw = bucket_counts(docs)
    share = raw / raw.sum()
    # the raw model also smooths the target model, by as many n-grams as there are buckets
    ratio = Ratio(np.log((target + BUCKETS * share + 1e-9) / (target.sum() + BUCKETS)) - np.log(share + 1e-9 / raw.sum()))
    ratio.log_ratio[raw == 0] = 0
    judged = with_ratio(texts.filter("cut") if apart else texts, ratio).groupBy("doc_id").agg((F.max("quality") > 0).alias("good"), F.min("_ratio.mean").alias("mean"))
    found = judged.select("good", "mean").toArrow()  # two numbers for each sampled id
    return ratio, _cut(found.column("mean").to_numpy(), found.column("good").to_numpy(zero_copy_only=False))


def _cut(means: np.ndarray, good: np.ndarray) -> float:
    if good.all():
        return -np.inf
    order = np.argsort(means, kind="stable")
    m, g = means[order], good[order]
    # rows below each cut: bad ones are right, good ones wrong
    gain = np.append(0, np.cumsum(~g) / max(1, (~g).sum()) - np.cumsum(g) / max(1, g.sum()))
    best = int(np.argmax(gain))
    return -np.inf if best == 0 else float(m[best - 1]) if best == len(m) else float((m[best - 1] + m[best]) / 2)


def with_ratio(docs: DataFrame, ratio: Ratio, name: str = "_ratio", text_col: str = "text") -> DataFrame:
    """docs with a struct of mean and n; null texts count as empty, whole texts are read."""

    @F.pandas_udf("mean double, n long")  # the ratios, a fixed number of them, travel with the function
    def score(texts: pd.Series) -> pd.DataFrame:
        forget()
        mean, n = ratio.means([t if isinstance(t, str) else None for t in texts])
        give_back()
        return pd.DataFrame({"mean": mean, "n": n})

    return docs.withColumn(name, score(F.col(text_col)))


def gumbel_key(mean: str, seed: int):
    """Log weight plus Gumbel noise that depends on the document's id and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(mean) * WEIGHT_NGRAMS - F.log(-F.log(u))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 2048) -> float:
    """The k-th largest value (1 <= k <= rows), by counts in ever narrower bins; no more than ``bins`` rows
    come to the driver at once."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    value = F.col(column)
    for _ in range(40):
        if not high > low:
            return low
        width = (high - low) / bins
        place = F.least(F.greatest(F.floor((value - low) / width), F.lit(0)), F.lit(bins - 1))
        inside = rows.filter((value >= low) & (value <= high))
        found = sorted(((r["b"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()), reverse=True)
        for _, n, lo, hi in found:
            if k <= n:
                low, high = lo, hi
                break
            k -= n
    return low


def resample(docs: DataFrame, labels: DataFrame, seed: int = 13, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Ratio | None, float]:
    """(doc_id, n_ngrams, log_ratio, sample_key, selected) of every row, the ratio, and the key at the cut.

    k, the number of documents sampled, is the number whose mean log ratio passes the fitted cut. Keys equal
    to the k-th are all selected. Null texts count as empty (ratio 0); repeated rows have equal keys and go
    the same way; null ids share a key's noise. Without labelled good rows everything is selected."""
    spark = docs.sparkSession
    ratio, cut = fit(docs, labels, sample_rows)
    if ratio is None:
        everything = docs.select("doc_id", F.lit(0).cast("long").alias("n_ngrams"), F.lit(0.0).alias("log_ratio"), F.lit(0.0).alias("sample_key"), F.lit(True).alias("selected"))
        return everything, None, -np.inf
    scored = with_ratio(docs.select("doc_id", "text"), ratio).select("doc_id", F.col("_ratio.n").alias("n_ngrams"), F.col("_ratio.mean").alias("log_ratio"))
    keyed = stored(scored.withColumn("sample_key", gumbel_key("log_ratio", seed)), "importance")
    k = keyed.filter(F.col("log_ratio") > F.lit(float(cut))).count()
    limit = kth_largest(keyed, "sample_key", k) if k else np.inf
    return keyed.withColumn("selected", F.col("sample_key") >= F.lit(float(limit))), ratio, limit


def selected_documents(docs: DataFrame, labels: DataFrame, seed: int = 13) -> DataFrame:
    """The sampled rows of docs in all their columns; ratios are computed again, so no text is shuffled.

    Null texts count as empty (ratio 0), null ids share one key's noise, repeated rows and ties at the cut go the
    same way, columns of any name stay; an empty table, or labels without good rows, leave docs as it is."""
    _, ratio, limit = resample(docs, labels, seed)
    if ratio is None:
        return docs
    names = ["_ratio", "_ratio_mean"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    scored = with_ratio(docs, ratio, names[0]).withColumn(names[1], F.col(f"{names[0]}.mean"))
    return scored.filter(gumbel_key(names[1], seed) >= F.lit(float(limit))).drop(*names)
