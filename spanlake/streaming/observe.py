"""Incremental observation: quiet periods, changed texts, a vault that grows, token filing.

Works on streams and on tables alike where Spark allows it. The watermark is our
own addition: it makes a quiet period final, and drops what comes later than that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanlake.operators.pseudonym import identities, numbered
from spanlake.plans.scratch import dropped, mark

QUIET = "500 milliseconds"


def quiet_periods(updates: DataFrame, key: str, time: str, value: str, quiet: str = QUIET, late: str | None = None) -> DataFrame:
    """key, started, fires, n_updates, last_value: a check fires once a key's updates have
    been quiet for that long. late: the watermark's delay, needed on a stream."""
    df = updates.withWatermark(time, late) if late else updates
    w = F.session_window(time, quiet)
    got = df.groupBy(key, w.alias("w")).agg(F.count("*").alias("n_updates"), F.max(F.struct(F.col(time).alias("t"), F.col(value).alias("v"))).alias("last"))
    return got.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n_updates", F.col("last.v").alias("last_value"))


def changed(checks: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Checks whose value isn't that of the key's check before. On a table: a window."""
    from pyspark.sql import Window

    before = F.lag(value).over(Window.partitionBy(key).orderBy(time))
    return checks.withColumn("before__", before).where(~F.col(value).eqNullSafe(F.col("before__")) | F.col("before__").isNull()).drop("before__")


def changed_stream(checks: DataFrame, key: str, time: str, value: str, late: str = "10 seconds", ttl: int | None = None) -> DataFrame:
    """The same on a stream: checks are compared in the order of their times once the watermark, late
    after the latest, has passed them. ttl: milliseconds after which a key that had no further
    check is forgotten; its next check then counts as changed.

    A key's state is one row: the checks that wait, so that they are compared in the order of
    their times whatever batch brought them, and the last value. Its timer is that of the earliest check
    that waits; all that the watermark has passed by then go at once.
    """
    types = dict(checks.dtypes)

    def changes(of: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ats, values, last, known, written = state.get if state.exists else ([], [], None, False, 0)
        waiting = [*zip(ats, values)] + [r for batch in rows for r in zip(batch["at"].tolist(), batch["v"].tolist())]
        passed, now = state.getCurrentWatermarkMs(), state.getCurrentProcessingTimeMs()
        waiting.sort(key=lambda r: r[0])
        n = bisect_left(waiting, passed * 1000, key=lambda r: r[0])  # all of the milliseconds before the watermark's
        keep = []
        known = known and (ttl is None or now - written <= ttl)
        for at, v in waiting[:n]:
            if not known or v != last:
                keep.append((of[0], at, v))
            last, known, written = v, True, now
        rest = waiting[n:]
        if rest or known:
            state.update(([at for at, _ in rest], [v for _, v in rest], last, known, written))
            if rest:
                state.setTimeoutTimestamp(rest[0][0] // 1000)
            elif ttl is not None:
                state.setTimeoutTimestamp(passed + ttl)
        elif state.exists:
            state.remove()
        if keep:
            yield pd.DataFrame(keep, columns=["k", "at", "v"])

    slim = checks.withWatermark(time, late).select(F.col(key).alias("k"), F.col(time), F.unix_micros(time).alias("at"), F.col(value).alias("v"))
    held = f"ats array<bigint>, vs array<{types[value]}>, last {types[value]}, known boolean, written bigint"
    got = slim.groupBy("k").applyInPandasWithState(changes, f"k {types[key]}, at bigint, v {types[value]}", held, "append", GroupStateTimeout.EventTimeTimeout)
    return got.select(F.col("k").alias(key), F.timestamp_micros("at").alias(time), F.col("v").alias(value))


def vault_stream(spans: DataFrame, key: str, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Extend the vault under path by a stream of long spans (key, start, entity_type, text): the
    identities of a batch that the vault lacks are numbered on from it, in the order (key, start).

    The vault is a table, not a state: a batch is joined with it, so no task holds a type, and
    its own records make up the folder records/batch=<number>. The uses that a batch has of
    each identity, known or new, are in uses/batch=<number>; stream_vault() adds them up. A
    batch that is run again sees the batches before it only and writes the same folders anew.
    """

    def extend(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        begun = mark()
        seen = identities(batch, key)
        known = spark.read.parquet(f"{path}/records").where(F.col("batch") < number) if number else None
        new = numbered(seen, known)
        new.drop("usage_count").write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        seen.select("entity_type", "normalized_key", "used", F.col("k").alias("first_key")).write.mode("overwrite").parquet(f"{path}/uses/batch={number}")
        dropped(spark, begun)

    return spans.writeStream.foreachBatch(extend).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_vault(spark: SparkSession, path: str) -> DataFrame:
    """The vault that a stream has filled so far, with the uses and the first and last batch of each identity."""
    records, uses = (spark.read.parquet(f"{path}/{kind}") for kind in ("records", "uses"))
    used = uses.groupBy("entity_type", "normalized_key").agg(F.sum("used").alias("usage_count"), F.min("batch").alias("first_batch"), F.max("batch").alias("last_batch"))
    return records.drop("batch").join(used, ["entity_type", "normalized_key"])


def filed(sightings: DataFrame) -> DataFrame:
    """token, conversation: where each token is filed, by its last sighting; filing again
    changes nothing. sightings: (token, conversation, seen)."""
    return sightings.groupBy("token").agg(F.max(F.struct("seen", "conversation")).alias("l")).select("token", F.col("l.conversation").alias("conversation"))
