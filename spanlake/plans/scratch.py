"""Tables between the jobs of a query, in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset on a
    single machine, as in tests, a temporary one is set; on a cluster it must be set."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None:
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spanlake-")
            spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, what is used several
    times is computed once, and a lost executor costs no more than the running stage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in the list of scratch folders, for dropped()."""
    return len(_made)


def dropped(spark: SparkSession, since: int = 0, keep: DataFrame | None = None, *more: DataFrame) -> None:
    """Delete the scratch folders made since a mark, but for those that keep or more read. An
    operator drops what its result doesn't read; when the result is written, its
    caller may drop the rest."""
    needed = [f for df in (keep, *more) if df is not None for f in df.inputFiles()]
    for path in _made[since:]:
        if any(path.rsplit("/", 1)[1] in f for f in needed):
            continue
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        _made.remove(path)


def released(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """dropped(), and the shuffle files of ended jobs too: Spark deletes these when the driver's JVM finds, by
    collecting garbage, that nothing refers to them, which on an idle driver may be after the query's end."""
    dropped(spark, since, *keep)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
