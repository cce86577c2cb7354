"""Numbers over all rows of a table, in two passes instead of one ordered window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridoc.sources.shared import written

#: Bits of a row's place in its partition in a monotonically increasing id.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a column ``name``: each row's number from 0 in the order of these columns, nulls first.

    Rows are dealt to ranges and sorted there, and written with their range and their place in it, so that a lost
    task cannot deal them anew. The counts of the ranges, one row for each partition, then give every range the
    number of rows before it. Rows that are equal in all of ``order`` are numbered in any order and lie in one range,
    so the columns should tell most rows apart."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
    placed = written(placed, "numbered")
    before, offsets = 0, []
    for r in placed.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():
        offsets.append((r["_range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    return placed.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")
