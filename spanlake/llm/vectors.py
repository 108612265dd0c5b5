"""What the operators on vectors share: which vectors are sound, matrices of
Arrow columns, exact whole components and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.plans.order import placed as placed

#: Whole components below this keep sums of squares within a long for vectors of up to 4096.
SMALL = 2**24

#: Bits of the parts in which sums of any size are added.
LIMB = 40


def sound(vector: Column | str) -> Column:
    """Whether a vector has components, none of them null or non-finite."""
    finite = lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def common_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have, the shorter one on ties; 0 if there are none."""
    most = vectors.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most["d"] if most else 0


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of one length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64 where all is small, else Python's integers."""
    down = np.floor(256.0 * x)
    if not len(down) or np.abs(down).max(initial=0) < SMALL:
        return down.astype(np.int64)
    # 256 * x may be beyond a double's range; x is a whole number then
    return np.array([[int(v) if np.isfinite(v) else 256 * int(u) for u, v in zip(*row)] for row in zip(x, down)], object)


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(k, limb) whose sum of limb << LIMB * k is the total; limbs can be summed as longs."""
    k = 0
    while not -(1 << LIMB) <= total < 1 << LIMB:
        yield k, total & ((1 << LIMB) - 1)
        total, k = total >> LIMB, k + 1
    yield k, total
