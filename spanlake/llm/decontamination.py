"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item; an item with fewer words is
one window. Of the k-grams (k = GRAM) in each window the least hash is kept,
the last on ties, and neighbouring windows that keep the same k-gram keep it
once. A window keeps the same k-gram wherever it stands, so every shared span
of WINDOW words or more has a fingerprint on both sides. Items of n < WINDOW
words are winnowed with k = n, which keeps each n-gram.

Documents' fingerprints pass a bit map of the items' fingerprints and are joined
to them by the hash alone. A hit is extended to the left and the right of the
k-gram, word by word, as far as a window with it can reach; where equal words
make up a window at least, they are hit. Places with the same words around
them are one row on either side, so repetition in a text doesn't multiply.

Defined results: null or word-less texts have no words and no hits; items
without words never occur; rows without item_id still make hits but are no
counted item; repeated rows each give their row; columns besides doc_id/text
and item_id/text are ignored. Work and memory follow the text's length; what
goes to the driver is a bit map.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bit_map, in_map
from spanlake.llm.textvec import ALNUM, U, Words, grams, mix, slices

GRAM = 8
WINDOW = 10


def winnowed(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The words at which a kept k-gram begins, and its hash; of windows within one text."""
    gram = min(gram, window)
    g = grams(words.hash, gram)
    n, span = len(words) - window + 1, window - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    least, at = g[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, span):
        better = g[i : i + n] <= least
        least[better] = g[i : i + n][better]
        at[better] = i
    kept = np.zeros(len(g), bool)
    kept[(np.arange(n) + at)[words.left()[:n] >= window]] = True
    place = np.flatnonzero(kept)
    return place, mix(g[place] + U(window))


def around(words: Words, place: int, doc: int, window: int, gram: int) -> tuple[int, bytes]:
    """The words that windows with the k-gram at a place can hold, and how many are before it."""
    reach = window - min(gram, window)
    a = max(int(words.first[doc]), place - reach)
    return place - a, words.text(a, min(int(words.first[doc + 1]), place + window))


def item_fingerprints(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """item_id (string), len (of the window), fp, lead, words of each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, _, data, offs in slices(batch.column("text")):
                w = Words(data, offs, ALNUM)
                lengths = np.minimum(np.diff(w.first), window)
                for size in np.unique(lengths[lengths > 0]).tolist():
                    place, fp = winnowed(w, size, gram)
                    doc = np.searchsorted(w.first, place, "right") - 1
                    own = lengths[doc] == size
                    for p, f, d in zip(place[own].tolist(), fp[own].astype(np.int64).tolist(), doc[own].tolist()):
                        rows.append((batch.column("item_id")[i + d].as_py(), size, f, *around(w, p, d, size, gram)))
            cols = list(zip(*rows)) or [[]] * 5
            types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["item_id", "len", "fp", "lead", "words"])

    texts = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "item_id string, len int, fp long, lead int, words binary").distinct()


def _equal_run(a: Column, b: Column) -> Column:
    """How many of the first entries of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def extended(hits: DataFrame, gram: int = GRAM) -> DataFrame:
    """hits (lead, words, item_lead, item_words, len, ...) with before and after: the equal words left of
    the k-gram's beginning and right of it. Those whose equal words don't make up a window go; rows of
    len 0 are no hits and stay."""
    own, other = (F.split(F.col(c).cast("string"), " ") for c in ("words", "item_words"))
    before = _equal_run(F.reverse(F.slice(own, F.lit(1), F.col("lead"))), F.reverse(F.slice(other, F.lit(1), F.col("item_lead"))))
    after = _equal_run(F.slice(own, F.col("lead") + 1, F.col("len")), F.slice(other, F.col("item_lead") + 1, F.col("len")))
    found = hits.withColumns({"before": before, "after": after})
    return found.where((F.col("len") == 0) | (F.col("after") >= F.least(F.col("len"), F.lit(gram))) & (F.col("before") + F.col("after") >= F.col("len")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Per row of docs: doc_id, key (hash of its text), n_words, n_hit, n_items, items
    (sorted ids as strings), contaminated."""
    spark = docs.sparkSession
    known = item_fingerprints(items, window, gram)
    packed = spark.sparkContext.broadcast(bit_map(known.select("fp").distinct(), "fp"))
    lengths = sorted(r["len"] for r in known.select("len").distinct().collect())  # at most `window` values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = packed.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
            at, length, fps, leads, words, where, counts = [], [], [], [], [], [], np.zeros(len(batch), np.int64)
            for i, j, data, offs in slices(batch.column("text")):
                w = Words(data, offs, ALNUM)
                counts[i:j] = np.diff(w.first)
                for size in lengths:
                    place, fp = winnowed(w, size, gram)
                    some = in_map(bits, fp)
                    place, fp = place[some], fp[some].astype(np.int64)
                    doc = np.searchsorted(w.first, place, "right") - 1
                    found: dict = defaultdict(list)
                    for p, f, d in zip(place.tolist(), fp.tolist(), doc.tolist()):
                        found[d, f, *around(w, p, d, size, gram)].append(p - int(w.first[d]))
                    for (d, f, lead, text), places in found.items():
                        at.append(i + d)
                        length.append(size)
                        fps.append(f)
                        leads.append(lead)
                        words.append(text)
                        where.append(places)
            n = len(batch)
            row = np.concatenate([np.arange(n), np.array(at, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(row)),
                    pa.array(keys[row], pa.int64()),
                    pa.array(counts[row]),
                    pa.array([0] * n + length, pa.int32()),
                    pa.array(batch.column("spread").to_pylist() + fps, pa.int64()),
                    pa.array([0] * n + leads, pa.int32()),
                    pa.array([None] * n + words, pa.binary()),
                    pa.array([None] * n + where, pa.list_(pa.int32())),
                ],
                ["doc_id", "key", "n_words", "len", "fp", "lead", "words", "at"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    # One row for each document (len 0, no words) and one for each kept k-gram that items may have.
    seen = docs.select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64("doc_id", "text").alias("spread"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, key long, n_words long, len int, fp long, lead int, words binary, at array<int>"
    )
    variants = known.groupBy("len", "fp", F.col("lead").alias("item_lead"), F.col("words").alias("item_words")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    hits = extended(seen.join(variants, ["len", "fp"], "left"), gram)
    runs = F.transform("at", lambda p: F.struct((p - F.col("before")).alias("a"), (p + F.col("after")).alias("b")))
    rows = hits.select("doc_id", "key", "n_words", (F.col("len") == 0).cast("int").alias("copies"), runs.alias("runs"), "items")
    grouped = rows.groupBy("doc_id", "key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").cast("long").alias("copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("runs")))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    merged = F.aggregate("runs", start, lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["upto"]))).cast("long").alias("n"), F.greatest(s["upto"], r["b"]).alias("upto")))
    return grouped.withColumn("n_hit", merged["n"]).select(
        "doc_id", "key", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", (F.col("n_hit") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
    ).drop("copy")


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs without the rows that hold a benchmark window."""
    bad = decontaminate(docs, items, window, gram).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("key").alias("bad_key"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_key"]), "left_anti")
