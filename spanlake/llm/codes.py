"""Vectors as codes of the nearest entries of small codebooks, by annular norm pruning.

Each component becomes the whole number floor(256 * x), and each vector is cut
into PARTS equal parts (zeros fill the last where the length is no multiple).
Each part position has a codebook of at most ENTRIES entries: first those parts
of the vectors of least id, then, ROUNDS times, the componentwise floor of the
mean of the parts nearest to the entry. An entry nearest to none stays.

Nearest entries are found by norms: entries are sorted by norm, and the better
of the two around a part's norm gives a distance; by the triangle inequality
only entries whose norm differs by that or less can be as near, so the
interval of these (its ends found by binary search, and included) is all that
is evaluated, exactly. Ties go to the entry of lower index.

A round is one scan: tasks sum the parts of each entry, partial sums are added
by Spark, and the driver sees sums of one codebook (ENTRIES * length numbers).
Nothing else is shuffled but the sums by label.

Edge cases: vectors that are null, empty, or hold null or non-finite components
are dropped, as are those of another length than most have. Rows of equal ids
are rows of their own; for the first entries they are ordered by their
components, and null ids come last. Components beyond SMALL are worked on as
Python's integers; an error that no long holds is null. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored
from spanlake.llm.vectors import LIMB, common_length, limbs, matrix, sound, whole

PARTS = 16
ENTRIES = 64
ROUNDS = 2

#: More than the rounding of square roots, relative to the norms (beside it, 2 for whole roots).
SLACK = 1e-9

_LONG = 2**63


def _root(squares: np.ndarray) -> np.ndarray:
    """Square roots, of Python's integers rounded down."""
    return np.frompyfunc(math.isqrt, 1, 1)(squares) if squares.dtype == object else np.sqrt(squares)


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point, the index of its nearest entry (the lower on ties) and the squared distance."""
    order = np.argsort((entries**2).sum(1), kind="stable")
    norms, radii = _root((entries**2).sum(1)[order]), _root((points**2).sum(1))
    above = np.minimum(np.searchsorted(norms, radii), len(norms) - 1)
    below = np.maximum(above - 1, 0)
    apart = lambda i, at: ((points[i] - entries[order[at]]) ** 2).sum(1)
    every = np.arange(len(points))
    known = _root(np.minimum(apart(every, above), apart(every, below)))
    known = known + 2 + (0 if known.dtype == object else SLACK * (radii + known + norms[-1]))
    low, high = np.searchsorted(norms, radii - known, "left"), np.searchsorted(norms, radii + known, "right")
    count = high - low
    first = np.cumsum(count) - count
    row = np.repeat(every, count)
    at = np.arange(len(row)) - first[row] + low[row]
    far = apart(row, at)
    best = np.minimum.reduceat(far, first)
    index = np.minimum.reduceat(np.where(far == best[row], order[at], len(order)), first)
    return index.astype(np.int64), best


def cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors -> (vector, part, component within the part)."""
    short = -x.shape[1] % parts
    if short:
        x = np.concatenate([x, np.zeros((len(x), short), x.dtype)], axis=1)
    return x.reshape(len(x), parts, -1)


def _sums(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            x = cut(whole(matrix(batch.column(0))), len(books))
            for p in range(len(books) if len(x) else 0):
                index, _ = nearest(x[:, p], books[p])
                now = np.zeros(books[p].shape, x.dtype)
                np.add.at(now, index, x[:, p])
                sums[p] += now
                counts[p] += np.bincount(index, minlength=len(counts[p]))
        rows = [(p, e, i, k, limb, int(n[e]) if not k else 0) for p, n in enumerate(counts) for e in np.flatnonzero(n).tolist() for i, v in enumerate(sums[p][e]) for k, limb in limbs(int(v))]
        columns = zip(*rows) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k < 4 else pa.int64()) for k, c in enumerate(columns)], ["p", "e", "i", "k", "s", "n"])

    return run


def train(vectors: DataFrame, first: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks by part position. vectors: one column; first: the vectors that the codebooks start from."""
    start = cut(whole(first), parts)
    books = [start[:, p] for p in range(parts)]
    for _ in range(rounds):
        partial = vectors.mapInArrow(_sums(books), "p int, e int, i int, k int, s long, n long")
        sums = {}
        for r in partial.groupBy("p", "e", "i", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
            s, n = sums.get((r["p"], r["e"], r["i"]), (0, 0))
            sums[r["p"], r["e"], r["i"]] = s + (r["s"] << LIMB * r["k"]), n + r["n"]
        new = [b.astype(object) for b in books]
        for (p, e, i), (s, n) in sums.items():
            new[p][e, i] = s // n
        books = [b.astype(start.dtype) for b in new]
    return books


def _codes(books: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = cut(whole(matrix(batch.column("v"))), len(books))
            found = [nearest(x[:, p], b) for p, b in enumerate(books)]
            code = np.stack([index for index, _ in found], 1).astype(np.uint8)
            error = sum(far for _, far in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array([int(e) if e < _LONG else None for e in error], pa.int64())], ["id", "label", "code", "error"]
            )

    return run


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def encode(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): id, label, code (two hex digits a part), error (sum of squared distances)
    and label_error (the sum of errors over rows of that label; nulls are one label)."""
    if entries > 256:
        raise ValueError("a code has two hex digits for each part")
    spark = df.sparkSession
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label")).where(sound("v"))
    d = common_length(rows, "v")
    rows = rows.where(F.size("v") == d)
    first = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()], np.float64)
    if not d:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    books = train(rows.select("v"), first, parts, rounds)
    kinds = dict(rows.dtypes)
    coded = stored(rows.mapInArrow(_codes(books), f"id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n"), F.count("error").alias("known"))
    sums = sums.select("of", F.when(F.col("known") == F.col("n"), F.col("label_error")).alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left").select("id", "label", "code", "error", "label_error"), books
