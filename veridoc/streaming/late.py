"""Windowed metrics as partial sums by micro-batch, with the rows that come too late for their window kept aside.

Each batch leaves one short row for each period that it touches: counts, sums and quantile sketches, which merge over
tasks, batches and periods. So no state is held between batches, a restart repeats nothing, and windows can be read
at any time, closed ones or all.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.sources.shared import Files
from veridoc.streaming.events import FAILURES, LATENESS, PERIOD

#: Size of a quantile sketch: its ranks are off by no more than RANK_ERROR, nearly always.
SKETCH_K, RANK_ERROR = 800, 0.01

PARTIAL = "period timestamp, n long, ttft binary, chunks_sum long, chunks_n long, latency binary, n_errors long, n_ungrounded long"


def sketch(c: Column) -> Column:
    """A mergeable sketch of the distribution of c, nulls left out."""
    return F.kll_sketch_agg_double(c.cast("double"), SKETCH_K)


def quantile(merged: Column, p: float) -> Column:
    """A quantile of a sketch; null of an empty one."""
    return F.when(F.kll_sketch_get_n_double(merged) > 0, F.kll_sketch_get_quantile_double(merged, F.lit(p)))


def metric_partials(events: DataFrame, ts: str = "ts", period: str = PERIOD) -> DataFrame:
    """PARTIAL's columns of telemetry rows (ts, event, ttft_ms, chunks, latency_ms, grounded); rows without a time
    are in no period."""
    answered, retrieved = F.col("event") == "response.completed", F.col("event") == "span.retrieval"
    out = events.filter(F.col(ts).isNotNull()).groupBy(F.window(ts, period).alias("w")).agg(
        F.count("*").alias("n"),
        sketch(F.when(answered, F.col("ttft_ms"))).alias("ttft"),
        F.coalesce(F.sum(F.when(retrieved, F.col("chunks").cast("long"))), F.lit(0)).alias("chunks_sum"),
        F.count(F.when(retrieved, F.col("chunks"))).alias("chunks_n"),
        sketch(F.when(retrieved, F.col("latency_ms"))).alias("latency"),
        F.count_if(F.col("event").isin(*FAILURES)).alias("n_errors"),
        F.count_if(answered & ~F.col("grounded")).alias("n_ungrounded"),
    )
    return out.select(F.col("w.start").alias("period"), *[c for c in out.columns if c != "w"])


def merged_partials(partials: DataFrame) -> DataFrame:
    """One row of PARTIAL's columns for each period."""
    total = lambda c: F.sum(c).alias(c)
    both = lambda c: F.kll_merge_agg_double(c).alias(c)
    return partials.groupBy("period").agg(total("n"), both("ttft"), total("chunks_sum"), total("chunks_n"), both("latency"), total("n_errors"), total("n_ungrounded"))


def metrics_of(merged: DataFrame) -> DataFrame:
    """The columns of metric_windows, with quantiles within RANK_ERROR."""
    return merged.select(
        "period",
        "n",
        quantile(F.col("ttft"), 0.5).alias("ttft_p50"),
        quantile(F.col("ttft"), 0.95).alias("ttft_p95"),
        F.when(F.col("chunks_n") > 0, F.col("chunks_sum") / F.col("chunks_n")).alias("chunks_avg"),
        quantile(F.col("latency"), 0.95).alias("latency_p95"),
        "n_errors",
        "n_ungrounded",
    )


def rolled_up(partials: DataFrame, period: str) -> DataFrame:
    """Partials of a longer period, from those of shorter ones."""
    return merged_partials(partials.withColumn("period", F.window("period", period)["start"]))


def duration_sketches(telemetry: DataFrame, label: str = "model") -> DataFrame:
    """(event, label, n, latency): how long spans took, mergeable."""
    spans = telemetry.filter("event in ('span.retrieval', 'span.inference')")
    return spans.groupBy("event", label).agg(F.count("*").alias("n"), sketch(F.col("latency_ms")).alias("latency"))


class WindowLog:
    """Partial windows and late rows of a stream, below one folder.

    A row is late where its window has ended ``lateness`` or more before the latest row of the batches before its
    own. Each batch is written whole under its number, before the time that it leads to is; a repeated batch
    replaces what it wrote, so a restart neither loses nor repeats a row, and rows in windows plus late rows are the
    rows that came, but for those without a time."""

    def __init__(self, spark: SparkSession, root: str, ts: str = "ts", period: str = PERIOD, lateness: str = LATENESS):
        self.root, self.ts, self.period, self.lateness = root.rstrip("/"), ts, period, lateness
        self.files = Files(spark, self.root)

    def _latest(self, before: int | None = None) -> int | None:
        """Microseconds of the latest row of the batches before this number, or of all."""
        names = [n for n in self.files.names("latest") if n.endswith(".json") and (before is None or int(n[:-5]) < before)]
        return json.loads(self.files.read(f"latest/{names[-1]}"))["us"] if names else None

    def _line(self, latest: int | None) -> Column:
        """Windows that end at this time or earlier are closed."""
        return F.lit(None).cast("timestamp") if latest is None else F.timestamp_micros(F.lit(latest)) - F.expr(f"interval {self.lateness}")

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        before = self._latest(epoch)
        batch = batch.filter(F.col(self.ts).isNotNull()).persist()
        try:
            late = F.coalesce(F.window(self.ts, self.period)["end"] <= self._line(before), F.lit(False))
            marked = batch.withColumn("_late", late)
            marked.filter("_late").drop("_late").write.mode("overwrite").parquet(f"{self.root}/late/epoch={epoch:012d}")
            metric_partials(marked.filter("not _late"), self.ts, self.period).write.mode("overwrite").parquet(f"{self.root}/windows/epoch={epoch:012d}")
            most = batch.agg(F.max(F.unix_micros(self.ts))).first()[0]
        finally:
            batch.unpersist()
        latest = max((x for x in (before, most) if x is not None), default=None)
        if latest is not None and f"{epoch:012d}.json" not in self.files.names("latest"):
            self.files.create(f"latest/{epoch:012d}.json", json.dumps({"us": latest}))

    def run(self, stream: DataFrame) -> None:
        """Takes in all that the stream's source holds now."""
        done = stream.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/state").trigger(availableNow=True).start()
        done.awaitTermination()
        if done.exception():
            raise done.exception()

    def late(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows that came too late, with their batch's number as ``epoch``."""
        return spark.read.schema(f"{schema}, epoch long").parquet(f"{self.root}/late")

    def partials(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{PARTIAL}, epoch long").parquet(f"{self.root}/windows").drop("epoch")

    def windows(self, spark: SparkSession, closed: bool = True) -> DataFrame:
        """metrics_of all windows that no row can still be added to, or of all."""
        merged = merged_partials(self.partials(spark))
        if closed:
            merged = merged.filter(F.col("period") + F.expr(f"interval {self.period}") <= self._line(self._latest()))
        return metrics_of(merged)
