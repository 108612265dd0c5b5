"""Improbable-feature digests of whole texts, and their likeness.

Features are the WINDOW-byte windows of a text. A window's entropy, in
thousandths of the most possible, gives its rarity: the further from what
prose has (TYPICAL), the rarer; windows under WEAK (runs and padding) are no
features. In every run of WINDOW windows the rarest, leftmost on ties, gains
a point, and those with POINTS or more are selected. Selected features are
hashed and set FUNCTIONS bits each in a chain of Bloom filters of FILTER_BITS
bits, PER_FILTER features to a filter. Two digests are compared by the bits
that their filters share, above what chance would share, as a part of the
most they could; each filter of the shorter chain is held against its best
match in the other, and the mean is the likeness, from 0 to 1.

A text without a selected feature gives its rarest window, one shorter than
a window gives itself, an empty text the empty digest, which is like none but
itself (1.0).

All windows are worked on at once: texts are cut to lanes of LANE bytes, whose
entropies advance together in whole numbers, so the result doesn't depend on
the cut. Memory is bounded by a slice of texts or the longest text.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.textvec import U, slices, span_hash

WINDOW = 64
TYPICAL = 700
WEAK = 150
POINTS = 16
FILTER_BITS = 2048
PER_FILTER = 160
FUNCTIONS = 5
LANE = 512

_SCALE = 1 << 16
_TERM = np.array([0] + [round(c * np.log2(c) * _SCALE) for c in range(1, WINDOW + 1)], np.int32)
#: What the c-th occurrence of a byte adds to the sum of c * log2(c).
_STEP = np.diff(_TERM, prepend=0).astype(np.int32)
_MOST = int(_TERM[WINDOW])


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each byte but the last WINDOW - 1, in thousandths of the most possible."""
    count = len(data) - WINDOW + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    lanes = -(-count // LANE)
    padded = np.zeros(lanes * LANE + WINDOW, np.uint8)
    padded[: len(data)] = data
    grid = np.lib.stride_tricks.as_strided(padded, (lanes, LANE + WINDOW), (LANE, 1)).T.astype(np.int32)
    grid += np.arange(lanes, dtype=np.int32) * 256  # a cell of `seen` for each lane and byte
    seen = np.zeros(lanes * 256, np.int8)
    total = np.zeros(lanes, np.int32)
    out = np.empty((LANE, lanes), np.int32)
    for t in range(WINDOW):
        at = grid[t]
        c = seen[at] + 1
        total += _STEP[c]
        seen[at] = c
    out[0] = total
    for t in range(1, LANE):
        at = grid[t - 1]
        c = seen[at]
        total -= _STEP[c]
        seen[at] = c - 1
        at = grid[t + WINDOW - 1]
        c = seen[at] + 1
        total += _STEP[c]
        seen[at] = c
        out[t] = total
    sums = out.T.reshape(-1)[:count].astype(np.int64)
    return (_MOST - sums) * 1000 // _MOST


def selected(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of the features of some texts, in order."""
    n, size = len(data), np.diff(offs)
    e = entropies(data)
    rare = np.full(n, 1 << 20, np.int64)
    rare[: len(e)] = np.where(e < WEAK, 1 << 19, 1000 - np.abs(e - TYPICAL))
    for i in range(1, WINDOW):  # windows that would run into the next text
        at = offs[1:] - i
        rare[at[(at >= offs[:-1]) & (at < n)]] = 1 << 20
    key = rare << 40 | np.arange(n)
    run = key.copy()
    span = 1
    while span < WINDOW:
        run[:-span] = np.minimum(run[:-span], run[span:])
        span *= 2
    has_run = np.zeros(n + 1, np.int64)  # windows of windows within one text
    whole = size >= 2 * WINDOW - 1
    np.add.at(has_run, offs[:-1][whole], 1)
    np.add.at(has_run, offs[1:][whole] - 2 * (WINDOW - 1), -1)
    best = run[np.cumsum(has_run[:n]) > 0]
    best = best[best >> 40 < 1 << 19] & ((1 << 40) - 1)
    points = np.bincount(best, minlength=n)
    start = np.flatnonzero(points >= POINTS)
    text = np.searchsorted(offs, start, "right") - 1
    none = np.setdiff1d(np.flatnonzero(size > 0), text)
    if len(none):
        extra = np.array([offs[d] if size[d] < WINDOW else int(key[offs[d] : offs[d + 1] - WINDOW + 1].min()) & ((1 << 40) - 1) for d in none])
        start, text = np.concatenate([start, extra]), np.concatenate([text, none])
        order = np.argsort(start, kind="stable")
        start, text = start[order], text[order]
    return start, np.minimum(start + WINDOW, offs[text + 1]), text


def filters(col: pa.Array) -> list[np.ndarray]:
    """The Bloom filters of each text, as rows of bytes."""
    out: list[np.ndarray] = []
    for _, _, data, offs in slices(col):
        start, end, text = selected(data, offs)
        h = span_hash(data, start, end)
        # A feature that a text repeats counts once, at its first place.
        order = np.lexsort((start, h, text))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        h, text = h[~again], text[~again]
        first = np.searchsorted(text, np.arange(len(offs)))
        chain = -(-np.diff(first) // PER_FILTER)
        base = np.concatenate(([0], np.cumsum(chain)))
        row = base[text] + (np.arange(len(h)) - first[text]) // PER_FILTER
        bits = np.zeros((base[-1], FILTER_BITS), bool)
        for i in range(FUNCTIONS):
            bits[row, ((h >> U(11 * i)) & U(FILTER_BITS - 1)).astype(np.int64)] = True
        packed = np.packbits(bits, axis=1)
        out += [packed[a:b] for a, b in zip(base[:-1], base[1:])]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if len(a) > len(b):
        a, b = b, a
    in_b = np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    scores = []
    for f in a:
        own = int(np.bitwise_count(f).sum())
        most, chance = np.minimum(own, in_b), own * in_b / FILTER_BITS
        shared = np.bitwise_count(b & f).sum(axis=1, dtype=np.int64)
        scores.append(float(np.max(np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1))))
    return float(np.mean(scores))


def written(f: np.ndarray) -> str:
    return base64.b64encode(f.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of text that a range of documents is meant to hold, and the most ranges.
RANGE_BYTES = 32 << 20
RANGES = 1 << 16
#: Ids sampled for each range to set the bounds; they don't bear on the result.
SAMPLED = 20
#: Ids that Spark and Python put in the same order.
ID_TYPES = ("tinyint", "smallint", "int", "bigint", "string", "binary", "date", "boolean")


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text, hash, range, lead: ranges of descending (doc_id, text hash), each sorted;
    lead marks the first row of the following range (or, after the last, of the first), put
    behind a range's own rows.

    Ranges are as many as the texts' bytes ask for, between the number of shuffle partitions
    and RANGES. The driver holds SAMPLED ids and hashes for each of them.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    if kind not in ID_TYPES and not kind.startswith("decimal"):
        raise TypeError(f"doc_id of type {kind} has no order that is supported; cast it to one of {', '.join(ID_TYPES)}")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // RANGE_BYTES + 1), RANGES)
    rank = lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1])
    some = rows.select("doc_id", "hash").sample(min(1.0, SAMPLED * parts / max(count, 1)), 7).collect()
    some = sorted(rank(r) for r in some)
    bounds = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    sent = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def range_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        cuts = sent.value
        return pa.array([len(cuts) - bisect.bisect_left(cuts, rank(r)) for r in zip(ids.to_pylist(), hashes.to_pylist())], pa.int32())

    keyed = rows.withColumn("range", range_of("doc_id", "hash"))
    heads = keyed.groupBy("range").agg(F.max(F.struct("doc_id", "hash")).alias("head")).select("range", "head.doc_id", "head.hash").collect()
    order = sorted(heads, key=lambda r: r["range"])
    firsts = [(r["doc_id"], r["hash"], order[i - 1]["range"]) for i, r in enumerate(order)]
    head = spark.createDataFrame(firsts, f"head_id {kind}, head_hash long, before int")
    # A row for each range, RANGES at most.
    marked = keyed.join(F.broadcast(head), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("hash") == F.col("head_hash")), "left")
    spread = marked.select("doc_id", "text", "hash", F.explode(F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("lead")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("lead")))))).alias("to"))
    return spread.select("doc_id", "text", "hash", "to.range", "to.lead").repartition(parts, "range").sortWithinPartitions("range", "lead", F.desc("doc_id"), F.desc("hash"))


def digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, digests of its text and of its edited text, likenesses.

    The next document is that of the next smaller doc_id, after the last the first;
    rows of one doc_id follow each other by a hash of their text; those without
    doc_id come last. Null texts are empty. Ids may be of ID_TYPES or decimals, others are
    refused by a TypeError. Texts are shuffled once. Rows alike in doc_id and text share a
    range, which is read as a stream.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the row before, whose next one isn't known yet

        def done(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
            """A result for each row but the last, which may be of the next range; leads give none."""
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3] and a[2] == b[2]]
            texts = [a[1] for a, _ in pairs]
            changed = [edited(a[1], b[1]) for a, b in pairs]
            own = filters(pa.array(texts, pa.large_string()))
            after = filters(pa.array(changed, pa.large_string()))
            # The next row's filters are mostly the next pair's own.
            later = [own[i + 1] if i + 1 < len(pairs) and pairs[i + 1][0] is pairs[i][1] else filters(pa.array([pairs[i][1][1]], pa.large_string()))[0] for i in range(len(pairs))]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], doc_type),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
                    pa.array([written(f) for f in own], pa.string()),
                    pa.array([written(f) for f in after], pa.string()),
                    pa.array([likeness(x, y) for x, y in zip(own, after)], pa.float64()),
                    pa.array([likeness(x, y) for x, y in zip(own, later)], pa.float64()),
                ],
                ["doc_id", *(x.split()[0] for x in RESULT.split(", "))],
            )

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            rows = held + list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "lead"))))
            # Leads that repeat add nothing: the first is the next row.
            rows = [r for i, r in enumerate(rows) if not (r[3] and i and rows[i - 1][3] and rows[i - 1][2] == r[2])]
            yield done(rows, doc_type)
            held = rows[-1:]

    return in_order(docs).mapInArrow(run, f"doc_id {kind}, {RESULT}")
