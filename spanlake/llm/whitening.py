"""Whitening of vectors by a tall-skinny QR, without forming their covariance.

Each component becomes the whole number x = floor(256 * x). The fit list is
each distinct vector once: n vectors with sums S, which are exact. Each
partition centres its rows (x - S/n) and reduces them to the triangle R of
their QR, batch by batch, so a task holds one batch and one triangle. Triangles
are stacked and reduced again FAN at a time, round by round, until one is
left; its singular values s and right vectors v are those of the whole centred
list, so v are the covariance's unit eigenvectors and s^2 / n its eigenvalues,
with the accuracy of the data and not of their squares.

Each row is projected on the first COMPONENTS vectors and divided by the root of
the eigenvalue. Vectors have the sign with which their largest component (the
first on ties) is positive. The covariance of the whitened fit list, centred
by its own mean, gives identity_error.

Edge cases: vectors that are null, empty, or hold null or non-finite components
are dropped, as are those of another length than most have. Rows of equal ids are
rows of their own. A component whose singular value is 0 to double precision
can't be scaled: its `whitened` is null, and it is left out of identity_error
(null if all are). Equal vectors only, or one, give explained null. deviation is
an exact decimal (null beyond 38 digits). Components beyond a double's whole
numbers (2**53) are worked on as doubles for projections. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored
from spanlake.llm.vectors import LIMB, common_length, limbs, matrix, sound, whole

COMPONENTS = 4

#: Triangles that one task stacks.
FAN = 8


@dataclass
class Whitening:
    """n distinct vectors with exact sums; eigenvectors (columns), eigenvalues and the trace of their covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def explained(self) -> list[float | None]:
        return [float(e / self.trace) if self.trace else None for e in self.values]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whole vectors -> whitened components; NaN where a component can't be scaled."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (x.astype(np.float64) - self.mean) @ self.vectors / np.sqrt(self.values), np.nan)


def _snapped(vector: str, kind: str) -> Column:
    """floor(256 * x) / 256, which is exact in the vector's own type, without negative zeros."""
    element = kind.removeprefix("array<").removesuffix(">")
    return F.transform(vector, lambda x: F.when(F.abs(x) < 2.0**50, F.floor(x.cast("double") * 256) / F.lit(256.0)).otherwise(x.cast("double")).cast(element if element in ("float", "double") else "double"))


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, n = None, 0
    for batch in batches:
        if len(batch):
            now = whole(matrix(batch.column(0))).sum(0).astype(object)
            sums, n = now if sums is None else sums + now, n + len(batch)
    rows = [(i, k, limb, n if not k else 0) for i, s in enumerate(sums if sums is not None else []) for k, limb in limbs(int(s))]
    kinds = {"i": pa.int32(), "k": pa.int32(), "s": pa.int64(), "n": pa.int64()}
    yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds.values())], list(kinds))


def exact_sums(vectors: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sums of floor(256 * x) by dimension) of a column of vectors of length d."""
    n, sums = 0, [0] * d
    for r in vectors.mapInArrow(_partial_sums, "i int, k int, s long, n long").groupBy("i", "k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        sums[r["i"]] += r["s"] << LIMB * r["k"]
        n += r["n"] if not r["i"] else 0
    return n, sums


def _reduced(mean: np.ndarray):
    """A partition's rows, centred -> (part, the rows of their triangle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            if len(batch):
                rows = whole(matrix(batch.column(0))).astype(np.float64) - mean
                r = np.linalg.qr(rows if r is None else np.concatenate([r, rows]), mode="r")
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(r), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], ["part", "r"])

    return run


def _stacked(table: pa.Table) -> pa.Table:
    """Triangles of FAN parts -> one; the order of rows doesn't matter to it."""
    r = np.linalg.qr(np.concatenate([matrix(c) for c in table.column("r").chunks]), mode="r")
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN] * len(r), pa.int32()), "r": pa.array(list(r), pa.list_(pa.float64()))})


def tsqr(vectors: DataFrame, mean: np.ndarray) -> np.ndarray:
    """The triangle R of the centred vectors, at most d x d. A tree of stacks; the driver sees the last."""
    parts = stored(vectors.mapInArrow(_reduced(mean), "part int, r array<double>"), "triangles")
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN)).applyInArrow(_stacked, "part int, r array<double>")
        if most < FAN:
            return np.array([r["r"] for r in parts.collect()], np.float64)
        most //= FAN


def _moments(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total = np.zeros((k + 1, k))
        for batch in batches:
            if len(batch):
                x = w.project(whole(matrix(batch.column(0))))
                total += np.concatenate([x.T @ x, x.sum(0)[None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    return run


def _identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    k = len(w.values)
    sums = np.zeros((k + 1) * k)
    for r in vectors.mapInArrow(_moments(w), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    sums = sums.reshape(k + 1, k) / w.n
    off = np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k))[np.ix_(w.values > 0, w.values > 0)]
    return float(off.max()) if off.size else None


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Whitening of a stored column of distinct vectors of length d."""
    n, sums = exact_sums(vectors, d)
    mean = np.array([s / n for s in sums])
    _, s, right = np.linalg.svd(tsqr(vectors, mean))
    full = np.zeros(d)
    full[: len(s)] = s
    kept = right[:components].T
    kept = kept * np.sign(kept[np.abs(kept).argmax(0), np.arange(kept.shape[1])])
    values = full[:components] ** 2 / n
    values[full[:components] <= full[0] * np.finfo(float).eps * (d + np.sqrt(n))] = 0.0
    w = Whitening(n, sums, kept, values, float((s**2).sum() / n))
    w.identity_error = _identity_error(vectors, w)
    return w


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact. In 28-bit halves where these fit, else as Python's integers."""
    if x.dtype != object and x.shape[1] <= 128 and n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 2**55:
        v = n * x - np.array(sums, np.int64)
        high, low = v >> 28, v & (2**28 - 1)
        squares, mixed, rest = ((a * b).sum(1).astype(object) for a, b in ((high, high), (high, low), (low, low)))
        return list((squares << 56) + (mixed << 29) + rest)
    return list(((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1))


def _whitened(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = whole(matrix(batch.column("v")))
            far = [Decimal(v) if v < 10**38 else None for v in deviations(x, w.n, w.sums)]
            out = [[None if v != v else v for v in row] for row in w.project(x).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(far, pa.decimal128(38, 0)), pa.array(out, pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return run


def whiten(df: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """(id, deviation, whitened array) for each sound row, and the whitening (None if no row is sound)."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).alias("v")).where(sound("v"))
    d = common_length(rows, "v")
    rows = rows.where(F.size("v") == d)
    kinds = dict(rows.dtypes)
    if not d:
        return rows.select("id", F.lit(0).cast("decimal(38,0)").alias("deviation"), F.array().cast("array<double>").alias("whitened")), None
    distinct = stored(rows.select(_snapped("v", kinds["v"]).alias("x")).distinct(), "fit")
    w = fit(distinct, d, min(components, d))
    return rows.mapInArrow(_whitened(w), f"id {kinds['id']}, deviation decimal(38,0), whitened array<double>"), w
