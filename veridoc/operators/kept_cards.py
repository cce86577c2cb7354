"""Index cards that are made again only where the sampled chunks of a document have changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.operators.index import sample_hash
from veridoc.sources.shared import Files


class KeptCards:
    """A versioned table of cards (stem, sample_hash, card) below root.

    Each refresh writes the cards that it made as one part and a list of the stems of each live part's cards that
    still hold; a commit names both, so a reader sees one version or the one before, and a refresh that fails, or
    loses to another at the same time, leaves the cards as they were."""

    SCHEMA = "stem string, sample_hash string, card string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _state(self) -> dict:
        names = [n for n in self.files.names("commits") if n.endswith(".json")]
        return json.loads(self.files.read(f"commits/{names[-1]}")) if names else {"version": 0, "parts": [], "gone": None}

    def cards(self) -> DataFrame:
        """The cards of the newest version."""
        state = self._state()
        if not state["parts"]:
            return self.spark.createDataFrame([], self.SCHEMA)
        rows = self.spark.read.schema(self.SCHEMA).parquet(*[f"{self.root}/{p}" for p in state["parts"]])
        if not state["gone"]:
            return rows
        gone = self.spark.read.schema("stem string, sample_hash string").parquet(f"{self.root}/{state['gone']}")
        return rows.join(gone, ["stem", "sample_hash"], "left_anti")

    def refresh(self, sample: DataFrame, make: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Makes the cards be those of the stems of sample (stem, chunk_index, document_id, text); returns how many
        were made, kept and removed.

        make gets the sampled chunks of new and changed stems only and gives (stem, card) with one row for each;
        stems that it leaves out are tried again next time. A card that was removed and comes back is made again."""
        state = self._state()
        name = f"{state['version'] + 1:08d}-{uuid.uuid4().hex[:12]}"
        old = self.cards()
        path = lambda part: f"{self.root}/{name}/{part}"
        # texts are hashed once; what is new and what is gone is found from the hashes
        sample_hash(sample).write.parquet(path("wanted"))
        wanted = self.spark.read.schema("stem string, sample_hash string").parquet(path("wanted"))
        wanted.join(old.select("stem", "sample_hash"), ["stem", "sample_hash"], "left_anti").write.parquet(path("todo"))
        todo = self.spark.read.schema("stem string, sample_hash string").parquet(path("todo"))
        stale = old.select("stem", "sample_hash").join(wanted, ["stem", "sample_hash"], "left_anti")
        before = [f"{self.root}/{state['gone']}"] if state["gone"] else []
        held = self.spark.read.schema("stem string, sample_hash string").parquet(*before) if before else stale.limit(0)
        # a stem's earlier card of the same hash lies in an older part: what is made again takes its place
        stale.unionByName(held).distinct().write.parquet(path("gone"))
        # where nothing is to be made no text is read again
        some = sample.limit(0) if todo.isEmpty() else sample.join(todo.select("stem"), "stem", "left_semi")
        made = make(some).select("stem", "card").filter(F.col("card").isNotNull())
        made.join(todo, "stem").select("stem", "sample_hash", "card").write.parquet(path("cards"))
        fresh = self.spark.read.schema(self.SCHEMA).parquet(path("cards"))
        gone = self.spark.read.schema("stem string, sample_hash string").parquet(path("gone"))
        back = fresh.join(gone, ["stem", "sample_hash"], "left_semi").count()
        counts = {"made": fresh.count(), "kept": old.count() - stale.count(), "removed": stale.count()}
        if not counts["made"] and not counts["removed"]:
            self.files.delete(name)
            return counts
        parts = [*state["parts"], f"{name}/cards"]
        dropped = f"{name}/gone"
        if back or len(parts) > 8:  # rewrite all cards as one part, which nothing is gone from
            live = old.join(gone, ["stem", "sample_hash"], "left_anti").select("stem", "sample_hash", "card")
            live.unionByName(fresh).write.parquet(path("all"))
            parts, dropped = [f"{name}/all"], None
        state = {"version": state["version"] + 1, "parts": parts, "gone": dropped}
        self.files.create(f"commits/{state['version']:08d}.json", json.dumps(state))
        return counts
