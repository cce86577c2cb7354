"""A token index that is kept between questions and brought up to date by what has changed.

The index is a folder of segments and commits. A segment holds, for the documents that one update brought, their
token sets (forward), their postings by token bucket, and by how much it changes each token's document frequency;
and the ids of documents of earlier segments that it replaces or removes (dead). A commit names the live segments.
It is created whole under the next number or not at all, so readers see one update or the one before, a job that
fails leaves nothing that is read, and of two updates at once the later one raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.text import chunk_text, with_tokens
from veridoc.operators.retrieval import MIN_SCORE, few, probing_terms, query_terms, scanned, verified
from veridoc.sources.shared import Files, written

#: Token buckets of a new index; a question reads those of its own tokens.
BUCKETS = 64
#: Segments, and share of dead documents among all that the segments hold, beyond which an update compacts.
MOST_SEGMENTS, MOST_DEAD = 8, 0.25

SCHEMAS = {
    "forward": "document_id string, hash string, tokens array<string>, version int",
    "postings": "token string, document_id string, version int, bucket int",
    "frequencies": "token string, n long, bucket int",
    "dead": "document_id string, version int",
}


#: Tokens of documents that are inverted at once; a document of more is inverted by itself.
INVERTED = 1 << 20


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.DictionaryArray, np.ndarray]]:
    """Parts of batches, their tokens, and how many tokens each of their rows has."""
    for b in batches:
        sizes = b.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends, lo = np.cumsum(sizes, dtype=np.int64), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + INVERTED, side="right")))
            part = b.slice(lo, hi - lo)
            yield part, part.column("tokens").flatten().dictionary_encode(), sizes[lo:hi]
            lo = hi


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, documents, version) of each version of each part, from (document_id, tokens, version)."""
    for part, tokens, sizes in _parts(batches):
        for version in part.column("version").unique():
            code = tokens.indices.to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            same = (part.column("version").to_numpy(zero_copy_only=False) == version.as_py())[owner]
            code, owner = code[same], owner[same]
            known, n = np.unique(code, return_counts=True)
            documents = part.column("document_id").take(pa.array(owner[np.argsort(code, kind="stable")]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), documents)
            yield pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(known)), lists, pa.array(np.full(len(known), version.as_py(), np.int32))], ["token", "documents", "version"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n): in how many documents of each part a token is."""
    for _, tokens, _ in _parts(batches):
        n = np.bincount(tokens.indices.to_numpy(), minlength=len(tokens.dictionary))
        yield pa.RecordBatch.from_arrays([tokens.dictionary, pa.array(n.astype(np.int64))], ["token", "n"])


class TokenIndex:
    """The index below root, which is made by its first update.

    Documents are (document_id, text); of rows with one id the text of the least hash counts, rows without an id are
    left out, and a null text is an empty one, which only its name's tokens find."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self._buckets = buckets

    def state(self) -> dict:
        """The newest commit: its version, number of buckets, and segments with their documents and dead ones."""
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        return json.loads(self.files.read(f"commits/{names[-1]}")) if names else {"version": 0, "buckets": self._buckets, "segments": []}

    def _read(self, part: str, state: dict) -> DataFrame:
        paths = [f"{self.root}/segments/{s['name']}/{part}" for s in state["segments"]]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[part])
        if "bucket" not in SCHEMAS[part]:
            return self.spark.read.schema(SCHEMAS[part]).parquet(*paths)
        # each segment is read by itself, for its folders name the buckets
        frames = [self.spark.read.schema(SCHEMAS[part]).parquet(p) for p in paths]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _live(self, rows: DataFrame, state: dict) -> DataFrame:
        """Rows (document_id, version) that no later segment replaces; there are few dead ids between compactions."""
        dead = self._read("dead", state).select("document_id", F.col("version").alias("since"))
        dead = dead.groupBy("document_id").agg(F.max("since").alias("since")).withColumnRenamed("document_id", "gone")
        return rows.join(dead, (F.col("document_id") == F.col("gone")) & (F.col("version") < F.col("since")), "left_anti")

    def documents(self, state: dict | None = None) -> DataFrame:
        """(document_id, hash, tokens, version) of all documents that the index holds."""
        state = state or self.state()
        return self._live(self._read("forward", state), state)

    def _bucket(self, token: Column, state: dict) -> Column:
        return F.pmod(F.xxhash64(token), F.lit(state["buckets"])).cast("int")

    def update(self, documents: DataFrame, hash_col: str | None = None, compact: bool = True) -> dict[str, int]:
        """Makes the index hold exactly these documents; returns how many are new, changed and deleted.

        Only hashes are compared, by one shuffle, and only texts that are new or changed are cut into tokens and
        written. hash_col names a column that already holds each text's hash, as a manifest has; without it every
        text is read once to hash it. An update that changes nothing commits nothing."""
        state = self.state()
        version = state["version"] + 1
        text = F.coalesce("text", F.lit(""))
        given = documents.filter(F.col("document_id").isNotNull()).select(F.col("document_id").cast("string").alias("document_id"), text.alias("text"), (F.col(hash_col) if hash_col else F.sha2(text, 256)).alias("hash"))
        now = given.groupBy("document_id").agg(F.min("hash").alias("hash"))
        old = self.documents(state).select("document_id", F.col("hash").alias("old"))
        action = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "deleted").otherwise("changed")
        plan = written(now.join(old, "document_id", "full_outer").filter(~F.col("hash").eqNullSafe(F.col("old"))).select("document_id", "hash", action.alias("action")), "index-plan")
        counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
        counts = {k: counts.get(k, 0) for k in ("new", "changed", "deleted")}
        if not any(counts.values()):
            return counts
        name = f"{version:08d}-{uuid.uuid4().hex[:12]}"
        # joined by the id alone, texts are dealt once for the join and for dropping repeats
        wanted = plan.filter("action != 'deleted'").select("document_id", F.col("hash").alias("wanted"))
        fresh = given.join(wanted, "document_id").filter(F.col("hash") == F.col("wanted")).select("document_id", "text", "hash").dropDuplicates(["document_id"])
        dead = plan.filter("action != 'new'").select("document_id", F.lit(version).alias("version"))
        forward = with_tokens(fresh, chunk_text(F.col("text"), F.col("document_id")), "text").select("document_id", "hash", F.col("text").alias("tokens"), F.lit(version).alias("version"))
        lost = self.documents(state).join(dead.select("document_id"), "document_id", "left_semi")
        self._write(name, state, forward, dead, lost)
        segment = {"name": name, "documents": counts["new"] + counts["changed"], "dead": counts["changed"] + counts["deleted"]}
        self._commit(state | {"version": version, "segments": [*state["segments"], segment]})
        if compact:
            self._compact_if_due()
        return counts

    def _write(self, name: str, state: dict, forward: DataFrame, dead: DataFrame, lost: DataFrame | None) -> None:
        """Writes a segment: its documents, their postings, and what it adds to and takes from frequencies."""
        path = f"{self.root}/segments/{name}"
        forward.write.parquet(f"{path}/forward")
        dead.write.parquet(f"{path}/dead")
        forward = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{path}/forward")
        # postings are inverted where documents are read; a token travels once for each batch of them
        lists = forward.select("document_id", "tokens", "version").mapInArrow(_inverted, "token string, documents array<string>, version int")
        lists = lists.withColumn("bucket", self._bucket(F.col("token"), state))
        # large buckets, as those of frequent tokens, are split over tasks and small ones share one
        sorted_lists = lists.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token")
        postings = sorted_lists.select("token", F.explode("documents").alias("document_id"), "version", "bucket")
        postings.write.partitionBy("bucket").parquet(f"{path}/postings")
        changes = forward.select("tokens").mapInArrow(_counted, "token string, n long")
        if lost is not None:
            changes = changes.unionByName(lost.select(F.explode("tokens").alias("token"), F.lit(-1).cast("long").alias("n")))
        changes = changes.groupBy("token").agg(F.sum("n").alias("n")).filter("n != 0").withColumn("bucket", self._bucket(F.col("token"), state))
        changes.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/frequencies")

    def _commit(self, state: dict) -> None:
        self.files.create(f"commits/{state['version']:08d}.json", json.dumps(state))

    def _compact_if_due(self) -> None:
        state = self.state()
        total, dead = (sum(s[k] for s in state["segments"]) for k in ("documents", "dead"))
        if len(state["segments"]) > MOST_SEGMENTS or dead > MOST_DEAD * total:
            self.compact()

    def compact(self) -> None:
        """Rewrites all segments as one of live documents only; texts are not read again."""
        state = self.state()
        version = state["version"] + 1
        name = f"{version:08d}-{uuid.uuid4().hex[:12]}"
        live = self.documents(state).withColumn("version", F.lit(version))
        self._write(name, state, live, self.spark.createDataFrame([], SCHEMAS["dead"]), None)
        n = self.spark.read.schema(SCHEMAS["forward"]).parquet(f"{self.root}/segments/{name}/forward").count()
        self._commit(state | {"version": version, "segments": [{"name": name, "documents": n, "dead": 0}]})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes segments that none of the newest ``keep`` commits names, as failed updates leave them, and older
        commits; returns the segments' names. Not to be run beside an update."""
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        held = {s["name"] for n in names[-keep:] for s in json.loads(self.files.read(f"commits/{n}"))["segments"]}
        gone = [n for n in self.files.names("segments") if n not in held]
        for n in names[:-keep]:
            self.files.delete(f"commits/{n}")
        for n in gone:
            self.files.delete(f"segments/{n}")
        return gone

    def frequencies(self, tokens: DataFrame, state: dict | None = None) -> DataFrame:
        """(token, df) of those of tokens (token) that documents hold."""
        state = state or self.state()
        known = self._read("frequencies", state).join(tokens.select("token").distinct(), "token", "left_semi")
        return known.groupBy("token").agg(F.sum("n").alias("df")).filter("df > 0")

    def search(self, queries: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
        """(question_id, query_idx, document_id, score) as lexical_score gives, from the kept index.

        queries: (question_id, query_idx, tokens). Only the buckets of the queries' tokens are read, of which at
        most the index's number of buckets are named to the scan."""
        state = self.state()
        terms = query_terms(queries).withColumn("bucket", self._bucket(F.col("token"), state))
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]
        near = lambda part: self._read(part, state).filter(F.col("bucket").isin(buckets))
        wanted = terms.select("bucket", "token").distinct()
        if few(queries):
            # a document's postings of the queries' tokens are all that a score needs
            held = near("postings").join(F.broadcast(wanted), ["bucket", "token"], "left_semi").groupBy("document_id", "version").agg(F.collect_list("token").alias("tokens"))
            return scanned(queries, self._live(held, state), min_score)
        frequency = near("frequencies").join(wanted, ["bucket", "token"], "left_semi").groupBy("token").agg(F.sum("n").alias("df"))
        probes = probing_terms(terms, frequency, min_score)
        hits = probes.join(near("postings"), ["bucket", "token"]).select("question_id", "query_idx", "document_id", "version").distinct()
        return verified(queries, self._live(hits, state), self._read("forward", state).select("document_id", "version", "tokens"), ["document_id", "version"], min_score)
