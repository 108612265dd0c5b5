"""Places in a global order, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.plans.scratch import stored

#: Low bits of monotonically_increasing_id, which count rows within a partition.
ROW_BITS = 33


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with `pos`, each row's place (from 0) in the order of these columns; rows that are
    equal in all of them take places as they come.

    Sorted ranges are written once; rows are numbered in them, and the driver sees
    one count for each range. No task holds more than a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    ranged = stored(ranged, name)
    part = F.shiftright("at_", ROW_BITS)
    sizes = {r["p"]: r["n"] for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(sizes):
        starts.append((p, before))
        before += sizes[p]
    starts = df.sparkSession.createDataFrame(starts, "p_ long, start_ long")
    return ranged.join(F.broadcast(starts), part == F.col("p_")).withColumn("pos", F.col("start_") + F.col("at_").bitwiseAND((1 << ROW_BITS) - 1)).drop("at_", "p_", "start_")
