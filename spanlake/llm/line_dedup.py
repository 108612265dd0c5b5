"""Line dedup over overlapping windows of three lines.

Lines end at a line feed and are compared as they are. A window is SIZE
consecutive lines, not all of them blank (BLANK, or empty), known by a 128-bit digest. Of the
windows with one digest, over all documents, the first by (doc_id, text hash,
position) stays; the lines that any later one covers are removed.

Defined results: null text has no lines; documents of fewer than SIZE lines
have no windows and stay as they are; rows alike in doc_id and text are one
document stated twice and get the same result; rows without doc_id count as
first. Shuffles carry digests and positions, pre-aggregated by digest; texts
move once, to meet their removed lines. Frequent windows are one key of an
equi-join, which Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3
#: What a blank line may hold; other white space, as U+00A0, is content.
BLANK = " \t\r\f"


def line_windows(text: str | None, size: int = SIZE) -> list[bytes | None]:
    """The digest of the window at each line; None if it is blank."""
    if text is None:
        return []
    lines = text.split("\n")
    if len(lines) < size:
        return []
    own = [hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in lines]
    full = [bool(x.strip(BLANK)) for x in lines]
    return [hashlib.blake2b(b"".join(own[i : i + size]), digest_size=16).digest() if any(full[i : i + size]) else None for i in range(len(lines) - size + 1)]


def occurrences(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, key, pos, win of each window."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pos, wins = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for p, win in enumerate(line_windows(text, size)):
                    if win is not None:
                        row.append(i)
                        pos.append(p)
                        wins.append(win)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("key").take(at), pa.array(pos, pa.int32()), pa.array(wins, pa.binary())], ["doc_id", "key", "pos", "win"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key long, pos int, win binary")


def later_windows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, key, later: the sorted positions of windows that occur before."""
    seen = occurrences(docs, size)
    first = seen.groupBy("win").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = seen.join(first, "win").where(~F.struct("doc_id", "key", "pos").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("later"))


def dedup_lines(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with text rid of the removed lines, and n_lines, n_removed, which replace columns of these names."""
    later = later_windows(docs, size).select(F.col("doc_id").alias("later_id"), F.col("key").alias("later_key"), "later")
    joined = docs.join(later, docs["doc_id"].eqNullSafe(later["later_id"]) & (F.xxhash64(docs["text"]) == later["later_key"]), "left")

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def cut(texts: pd.Series, laters: pd.Series) -> pd.DataFrame:
        out = []
        for text, later in zip(texts, laters):
            lines = [] if text is None else text.split("\n")
            gone = set() if later is None else {p + i for p in later for i in range(size)}
            out.append((text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    own = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    done = joined.select(*(docs[c] for c in own), cut(docs["text"].cast("string"), later["later"]).alias("cut__"))
    return done.select(*own, "cut__.text", "cut__.n_lines", "cut__.n_removed")
