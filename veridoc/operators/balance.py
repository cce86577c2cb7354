"""Rows dealt to tasks by the bytes of their texts, in two passes."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.sources.shared import written

#: Bytes of text that a task should hold.
TASK_BYTES = 64 << 20


def by_bytes(df: DataFrame, text: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """df dealt so that each partition holds about task_bytes of text, or one text that is larger.

    The first pass writes the rows and sums bytes by task; these sums, one for each task, and running sums within
    it tell every row where it begins in the line of all texts, whose equal stretches are the partitions. A large
    text begins in one stretch and leaves the next ones that it covers empty. Null texts count as one byte, so that
    rows without text are spread, too."""
    size = F.greatest(F.coalesce(F.octet_length(text), F.lit(0)), F.lit(1)).cast("long")
    placed = df.withColumn("_bytes", size).withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id())
    placed = written(placed, "by-bytes")
    before, starts = 0, []
    for r in placed.groupBy("_task").agg(F.sum("_bytes").alias("n")).orderBy("_task").collect():
        starts.append((r["_task"], before))
        before += r["n"]
    if not starts:
        return placed.drop("_bytes", "_task", "_row")
    parts = max(1, math.ceil(before / task_bytes))
    # only sizes are summed in order, task by task; the texts move once, by their stretch
    sums = F.sum("_bytes").over(Window.partitionBy("_task").orderBy("_row")) - F.col("_bytes")
    firsts = df.sparkSession.createDataFrame(starts, "_task int, _before long")
    begins = written(placed.select("_row", "_task", "_bytes").withColumn("_at", sums).join(F.broadcast(firsts), "_task").select("_row", (F.col("_before") + F.col("_at")).alias("_at")), "row-places")
    dealt = placed.join(begins, "_row").withColumn("_part", F.least(F.floor(F.col("_at") / task_bytes), F.lit(parts - 1)).cast("int"))
    return dealt.repartitionById(parts, "_part").drop("_bytes", "_task", "_row", "_at", "_part")
