"""Near-duplicates by HyperMinHash, confirmed on full shingle sets.

A document's set is its distinct SHINGLE-word shingles, as 64-bit hashes.
Documents with equal sets are one class (128-bit digest of the set), so exact
copies cost one row. A class's sketch has REGISTERS registers: the hashes are
dealt to buckets, and a bucket keeps its least hash as the count of leading
zeros and MANTISSA bits after the first one; empty buckets take the register
of another bucket, by a probe order that all sketches share. Registers are
banded ROWS at a time. At a similarity of 0.8 a pair shares no band with a
probability of (1 - 0.8**4)**32 < 1e-7.

Pairs within a bucket are not listed. First every class is paired, in each of
its buckets, with the class there whose buckets hold the most members in all:
the text from which a group of copies stems is in the largest bucket for every
band. Pairs whose estimate, corrected for registers equal by chance, is near
the bound are confirmed on the full sets and joined to components. Only where
a bucket still holds several components are the pairs across them, and only
those, compared, by blocks of the bucket, by sketch and then by their LOW
least hashes (which is the whole set, if it has no more); what passes is
confirmed likewise, and each pair is proposed by the first band that the two
share. So no link that could join two components is left out, while a group
of n copies lists about n pairs.

Sets of up to MIN_SET - 1 shingles can reach the bound only if equal, which
the classes show; they are not banded.

Defined results: null and word-less texts have an empty set and are linked
with nothing; a row with a null doc_id takes part, but is never a component's
smallest id; rows alike give alike rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bit_map, dropped, in_map, mark, stored
from spanlake.llm.graph import components
from spanlake.llm.textvec import SPACED, U, Words, grams, mix, slices

SHINGLE = 4
REGISTERS = 128
ROWS = 4
MANTISSA = 10
PERCENT = 80
#: How far below the bound an estimate may be: 4 standard errors of 128 registers at 0.8.
MARGIN = 0.14
#: The chance that two unlike registers are equal: equal counts (1/3) and equal mantissas.
CHANCE = 1 / 3 / (1 << MANTISSA)
#: Least hashes, of 32 bits, by which pairs across components are compared, and how far
#: below the bound that may be: 4 standard errors, or a chance equality in a whole set.
LOW = 512
LOW_MARGIN = 0.07
WHOLE_MARGIN = 0.01
#: Pairs with one class, its set held once, that one task confirms.
PER_TASK = 256
#: Parts of the counts of a class's pairs, so that a frequent class isn't one key.
SALTS = 16
#: Classes in a block of a bucket whose pairs across components are compared.
BLOCK = 256


def document_sets(data: np.ndarray, offs: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and each one's first."""
    w = Words(data, offs, SPACED)
    g = grams(w.hash, shingle)
    g = mix(g + U(7))
    sets, bounds = [], [0]
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= shingle:
            s = np.sort(g[a : b - shingle + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = np.array([int.from_bytes(hashlib.blake2b(w.text(a, b) + b"\n%d" % (b - a), digest_size=8).digest(), "little")], U)
        else:
            s = np.zeros(0, U)
        sets.append(s)
        bounds.append(bounds[-1] + len(s))
    return (np.concatenate(sets) if sets else np.zeros(0, U)), np.array(bounds)


def registers(values: np.ndarray, bounds: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """A sketch for each sorted set; rows of empty sets are zero."""
    bits = count.bit_length() - 1
    docs = len(bounds) - 1
    out = np.zeros((docs, count), np.uint16)
    if not len(values):
        return out
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    bucket = (values >> U(64 - bits)).astype(np.int64)
    cell = doc * count + bucket
    first = np.concatenate(([True], cell[1:] != cell[:-1]))
    least = (values[first] << U(bits)) | U(1 << (bits - 1))  # sorted: a bucket's first value is its least; never 0
    # frexp gives the place of the leading one; float64 may round a run of ones up.
    place = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    place -= (least >> (place - 1).clip(0, 63).astype(U) == 0) & (place > 0)
    zeros = 64 - place
    mantissa = ((least << zeros.astype(U)) << U(1)) >> U(64 - MANTISSA)
    out.reshape(-1)[cell[first]] = ((zeros + 1) << MANTISSA).astype(np.uint16) | mantissa.astype(np.uint16)
    row, col = np.nonzero(out == 0)
    some = np.diff(bounds) > 0
    row, col = row[some[row]], col[some[row]]
    own, step = out.copy(), 0
    while len(row):
        step += 1
        probe = (mix(col.astype(U) * U(1 << 20) + U(step)) >> U(64 - bits)).astype(np.int64)
        got = own[row, probe]
        out[row, col] = got
        row, col = row[got == 0], col[got == 0]
    return out


def band_keys(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """int64 key of each band of each sketch; the band's number is part of it."""
    n, count = sketch.shape
    parts = sketch.reshape(n, count // rows, rows).astype(U)
    key = np.tile(np.arange(count // rows, dtype=U), (n, 1)) + U(1)
    for i in range(rows):
        key = mix(key ^ (parts[:, :, i] << U(20)) + U(i))
    return key.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the share of equal registers, corrected for chance."""
    return ((a == b).mean(axis=-1) - CHANCE) / (1 - CHANCE)


def _batch(cols: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def set_id(values: np.ndarray) -> bytes | None:
    """A 128-bit digest of a sorted set; null if it is empty."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, n, sid (digest of the set; null if empty), sketch of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, sketch = [], [], []
            for _, _, data, offs in slices(batch.column("text")):
                values, bounds = document_sets(data, offs, shingle)
                regs = registers(values, bounds)
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    n.append(b - a)
                    sid.append(set_id(values[a:b]))
                    sketch.append(regs[i].tobytes() if b > a else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "key", "n", "sid", "sketch"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, key long, n long, sid binary, sketch binary")


BAND = pa.schema([("bucket", pa.int64()), ("band", pa.int32()), ("sid", pa.binary())])


def banded(classes: DataFrame) -> DataFrame:
    """bucket, band, sid for each band of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(batch), -1)
            keys = band_keys(sketch)
            at = pa.array(np.repeat(np.arange(len(batch)), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.tile(np.arange(keys.shape[1], dtype=np.int32), len(batch))), batch.column("sid").take(at)], ["bucket", "band", "sid"])

    return classes.select("sid", "sketch").mapInArrow(run, "bucket long, band int, sid binary")


def dealt(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the share of a's pairs that each is in; PER_TASK or so make up a share."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("shares")).where("shares > 1")
    hubs = hubs.select("a", "shares", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int").alias("salt")).join(hubs, ["a", "salt"], "left")
    return salted.select("a", "b", F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))


def near(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of pairs (a, b, share), those whose sketches and sizes admit the bound."""
    left = pairs.select("a", "share").distinct().join(classes.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    right = classes.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(right, "b").join(left, ["a", "share"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(len(batch), -1) for c in ("sa", "sb"))
                yield batch.select(["a", "b", "share"]).filter(pa.array(estimate(x, y) >= percent / 100 - MARGIN))

    return both.select("a", "b", "share", "sa", "sb").mapInArrow(run, "a binary, b binary, share int")


def low_alike(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Similarity of a set with others by their least hashes, less the margin due."""
    n = np.array([len(o) for o in others])
    joined = np.concatenate(others)
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    # Where a set is cut off, only what is below its last value can be compared.
    end = lambda x: int(x[-1]) if len(x) == LOW else 1 << 32
    top = np.minimum([end(o) for o in others], end(own))
    both = own[np.minimum(np.searchsorted(own, joined), len(own) - 1)] == joined
    under = joined <= np.repeat(top, n)
    shared = np.add.reduceat(both & under, first, dtype=np.int64)
    total = np.add.reduceat(under, first, dtype=np.int64) + np.searchsorted(own, top, "right") - shared
    return shared / total + np.where(top < 1 << 32, LOW_MARGIN, WHOLE_MARGIN)


def across(buckets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of classes of one bucket that are in unlike components and whose
    sketches, sizes and least hashes admit the bound; each from the first band they share.

    A bucket's classes are put in blocks of about BLOCK; each two blocks are a cell, and
    cells are dealt to tasks. Classes of the bucket's largest component (major) needn't
    meet each other, so their blocks share no cell.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
    minors, majors = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("minors", "majors"))
    place = F.xxhash64("sid")
    own = F.when(F.col("root") == F.col("major"), minors + F.pmod(place, majors).cast("int")).otherwise(F.pmod(place, minors).cast("int"))
    others = F.when(F.col("root") == F.col("major"), minors).otherwise(minors + majors)
    cells = buckets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    cells = cells.select("bucket", "band", "sid", "root", "n", "sketch", "low", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def pairs(band: int, rows: list) -> Iterator[pa.RecordBatch]:
        left, right = ([r for r in rows if r[5] == b] for b in (rows[0][5], rows[-1][5]))
        same = rows[0][5] == rows[-1][5]
        root = np.array([r[1] for r in right], object)
        n = np.array([r[2] for r in right])
        sketch = np.frombuffer(b"".join(r[3] for r in right), np.uint16).reshape(len(right), -1)
        keys = band_keys(sketch)
        low = [np.frombuffer(r[4], np.uint32) for r in right]
        a, b = [], []
        for i, (sid, own_root, own_n, own_sketch, own_low, _) in enumerate(left):
            mine = np.frombuffer(own_sketch, np.uint16)
            fit = 100 * np.minimum(own_n, n) >= percent * np.maximum(own_n, n)
            fit &= root != own_root
            if same:
                fit[: i + 1] = False
            fit &= estimate(mine, sketch) >= percent / 100 - MARGIN
            some = np.flatnonzero(fit)
            if len(some):
                some = some[(keys[some] == band_keys(mine[None])[0]).argmax(axis=1) == band]
            if len(some):
                some = some[low_alike(np.frombuffer(own_low, np.uint32), [low[k] for k in some]) >= percent / 100]
            a += [sid] * len(some)
            b += [right[k][0] for k in some]
        yield _batch([a, b], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for bucket, band, lo, hi, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "band", "lo", "hi", "sid", "root", "n", "sketch", "low", "own"))):
                if now != (bucket, lo, hi, band):
                    if rows:
                        yield from pairs(now[3], rows)
                    now, rows = (bucket, lo, hi, band), []
                rows.append(row)
        if rows:
            yield from pairs(now[3], rows)

    dealt = cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own", "sid")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def class_sets(docs: DataFrame, wanted: DataFrame, shingle: int = SHINGLE, low: bool = False) -> DataFrame:
    """sid, values (the set's sorted hashes; low: the upper half of the LOW least ones), once
    for each of wanted (key, sid): the rows whose key is in a map are hashed again; the join
    on the row's key and the set's digest drops what the map let through."""
    spark = docs.sparkSession
    packed = spark.sparkContext.broadcast(bit_map(wanted, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for batch in batches:
            keep = in_map(bits, batch.column("key").to_numpy().view(U))
            batch = batch.filter(pa.array(keep))
            sids, sets = [], []
            for _, _, data, offs in slices(batch.column("text")):
                values, bounds = document_sets(data, offs, shingle)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    sids.append(set_id(values[a:b]))
                    sets.append((values[a : min(a + LOW, b)] >> U(32)).astype(np.uint32).tobytes() if low else values[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sids, pa.binary()), pa.array(sets, pa.binary())], ["key", "sid", "values"])

    found = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, sid binary, values binary")
    return found.join(wanted.select("key", "sid"), ["key", "sid"]).groupBy("key", "sid").agg(F.first("values").alias("values")).select("sid", "values")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The pairs (a, b, share) with 100 * |both| >= percent * |either| on full sets."""
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))).distinct()
    sets = stored(class_sets(docs, stored(classes.join(ids, "sid", "left_semi"), "wanted"), shingle), "sets")
    others = pairs.join(sets.withColumnRenamed("sid", "b"), "b").select("a", "share", "b", "values")
    centres = pairs.select("a", "share").distinct().join(sets.withColumnRenamed("sid", "a"), "a").select("a", "share", F.lit(None).cast("binary").alias("b"), "values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, U)
        for batch in batches:
            a_out, b_out = [], []
            for a, b, values in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "values"))):
                values = np.frombuffer(values, U)
                if b is None:
                    now, own = a, values
                    continue
                assert a == now, "a pair came without its set"
                at = np.searchsorted(own, values)
                both = int((own[np.minimum(at, len(own) - 1)] == values).sum())
                if 100 * both >= percent * (len(own) + len(values) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield _batch([a_out, b_out], pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    together = others.unionByName(centres).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return together.mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, key, n_shingles, component_id, kept, n_links (of the row's class to others that
    were confirmed; links within a component that it needed no more aren't sought)."""
    begun = mark()
    min_set = next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))
    rows = stored(sketched(docs, shingle), "sketches")
    classes = stored(
        rows.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("doc_id", "key")).alias("r"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("sid", F.col("r.key").alias("key"), "least", "n", "sketch"), "classes",
    )
    bands = banded(classes.where(F.col("n") >= min_set))
    full = bands.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(bands.join(full, "bucket"), "bands")
    score = shared.groupBy("sid").agg(F.sum("members").alias("score"))
    ranked = shared.join(score, "sid").select("bucket", "sid", F.struct("score", "sid").alias("rank"))
    centres = ranked.groupBy("bucket").agg(F.max("rank").alias("top")).select("bucket", F.col("top.sid").alias("a"))
    stars = stored(shared.join(centres, "bucket").select("a", F.col("sid").alias("b")).where("a != b").distinct(), "stars")
    links = stored(confirmed(near(stored(dealt(stars), "dealt"), classes, percent), docs, classes, percent, shingle), "links")

    joined = components(links)
    placed = shared.join(joined.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    split = placed.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    split = split.where("roots > 1").select("bucket", F.col("most.root").alias("major"), F.col("most.n").alias("majors"), (F.col("n") - F.col("most.n")).alias("minors"))
    open_ = stored(placed.join(split, "bucket").select("bucket", "band", "sid", "root", "major", "majors", "minors"), "open")
    known = stored(classes.join(open_.select("sid").distinct(), "sid", "left_semi"), "known")
    low = class_sets(docs, known, shingle, low=True).withColumnRenamed("values", "low")
    open_ = open_.join(known.select("sid", "n", "sketch"), "sid").join(low, "sid")
    more = stored(confirmed(dealt(stored(across(open_, percent), "across")), docs, classes, percent, shingle), "links")

    every = links.union(more)
    final = components(every)
    grouped = classes.select("sid", "least").join(final.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("sid", "component_id")
    ends = every.select(F.col("a").alias("sid")).union(every.select(F.col("b").alias("sid"))).groupBy("sid").agg(F.count("*").alias("n_links"))
    named = named.join(ends, "sid", "left")
    out = rows.drop("sketch").join(named, "sid", "left")
    component = F.coalesce("component_id", "doc_id")
    out = out.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    dropped(docs.sparkSession, begun, out)
    return out


def dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """docs without the rows that near_duplicates() doesn't keep. Rows alike in doc_id and
    text are one document stated twice, and stay or go together."""
    gone = near_duplicates(docs, percent, shingle).where("NOT kept").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone")).distinct()
    return docs.join(gone, (F.xxhash64(docs["doc_id"], docs["text"]) == gone["gone"]) & docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
