"""What the operators share: table reading, the shared folder, compact Bloom maps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.plans.scratch import dropped as dropped
from spanlake.plans.scratch import mark as mark
from spanlake.plans.scratch import released as released
from spanlake.plans.scratch import scratch as scratch
from spanlake.plans.scratch import shared_dir as shared_dir
from spanlake.plans.scratch import stored as stored

#: Rows in an Arrow batch. Documents are long, so a batch of the default 10,000
#: rows could take a large part of a Python worker's memory.
BATCH_ROWS = 500

#: log2 of the least and most bits in a prefilter map. A map has 16 bits or more for each
#: key until it has the most; then it lets more through to the exact join after it.
MAP_BITS = (16, 26)


def tune(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches for this session and return it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def bit_map(df: DataFrame, key: str) -> np.ndarray:
    """A one-hash Bloom map of an int64 column: bit (key >> (64 - bits)).

    At most 2**26 / 64 rows, a million, reach the driver.
    """
    least, most = MAP_BITS
    bits = min(max(df.count() * 16, 1).bit_length(), most)
    bits = max(bits, least)
    slot = F.shiftrightunsigned(F.col(key), 64 - bits)
    words = (
        df.where(F.col(key).isNotNull())
        .select(F.shiftrightunsigned(slot, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
        .toPandas()
    )
    packed = np.zeros(1 << (bits - 6), np.uint64)
    packed[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)
    return packed


def in_map(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each uint64 key may be in the map."""
    slot = keys >> np.uint64(64 - (len(packed).bit_length() - 1 + 6))
    return (packed[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
