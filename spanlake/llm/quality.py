"""Ordinal quality regression: cumulative links over hashed text.

Grades are ordered: 0 junk, 1 sound but toxic, 2 clean. One score
f = w . x, shared by all thresholds, gives P(grade > k) = sigmoid(f - t[k])
with t ascending. Features are hashed to 2**BITS places: words and their first
bytes (1 + log of the count; stems of inflected words), shapes of space-separated tokens (root of their share), and
how far a repetitive text repeats itself. Only places whose presence differs between the
grades on the two sides of some threshold, by SURE standard errors, get a
weight; weights are fitted by proximal steps with an L1 penalty and are at
most 0: a feature can only be a defect. So words without a bearing on the
grade weigh nothing, length is no merit, and a short text needs no proof.

The fit uses at most `sample` labelled documents, chosen by a hash of doc_id;
that bounds what the driver holds. Scoring covers every document and whole
texts; what is broadcast is 2**BITS floats, whatever the input.

Defined results: null or empty text is scored by its (few) features; labels
with a null in doc_id or quality are ignored, a null toxic counts as 0, and of several labels of
one doc_id the least grade holds; without labels of two grades at least every
document has the top grade with certainty; rows alike give rows alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.textvec import ALNUM, U, Words, mix, slices, span_hash

BITS = 22
SAMPLE = 8_000
GRADES = 3
SURE = 4.5
#: Bytes of a word's beginning that are features.
STEMS = (4, 5)
PRUNE_AT = 100
#: A text is repetitive if its distinct words are a smaller share of all.
REPEATED = 0.5
#: A document is kept from this chance of the top grade on, or from what all but
#: LOSE of the sample's top grade reach, less a tenth, if that is more.
KEEP = 0.5
LOSE = 0.002


def _shape_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("a")
    t[128:] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    t[list(b" \t\n\x0b\x0c\r\0")] = 0
    return t


SHAPE = _shape_table()
SAME = np.arange(256, dtype=np.uint8)


def shapes(data: np.ndarray, offs: np.ndarray) -> Words:
    """Tokens as runs of character classes, each run written once."""
    c = SHAPE[data]
    keep = np.ones(len(c), bool)
    keep[1:] = c[1:] != c[:-1]
    inner = offs[offs < len(c)]
    keep[inner] = True
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return Words(c[keep], at[offs], SAME)


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place and value of each feature of some documents, by document."""
    docs = len(offs) - 1
    words, forms = Words(data, offs, ALNUM), shapes(data, offs)
    n_words, n_forms = np.diff(words.first), np.diff(forms.first)

    def counted(hashes: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = (mix(hashes + U(salt)) >> U(64 - bits)).astype(np.int64)
        key, count = np.unique(doc << bits | place, return_counts=True)
        return key >> bits, key & ((1 << bits) - 1), count

    owner, length = words.doc(), words.end - words.start
    wd, wp, wc = counted(words.hash, owner, 11)
    fd, fp, fc = counted(forms.hash, forms.doc(), 12)
    stems = []
    for n in STEMS:
        at = words.start[length > n]
        stems.append(counted(span_hash(words.bytes, at, at + n), owner[length > n], 20 + n))
    sd, sp, sc = (np.concatenate(x) for x in zip(*stems))
    distinct = np.bincount(wd, minlength=docs)
    ratio = np.where(n_words > 0, distinct / np.maximum(n_words, 1), 1)
    cd = np.flatnonzero(ratio < REPEATED)
    cp = (mix((16 * ratio[cd]).astype(U) + U(13 << 32)) >> U(64 - bits)).astype(np.int64)
    doc = np.concatenate([wd, sd, fd, cd])
    place = np.concatenate([wp, sp, fp, cp])
    value = np.concatenate([1 + np.log(wc), 1 + np.log(sc), 4 * np.sqrt(fc / np.maximum(n_forms[fd], 1)), np.ones(len(cd))]).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return doc[order], place[order], value[order]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    keep: float = KEEP

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each document and k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def bearing(places: list[np.ndarray], grade: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The places whose presence differs by SURE standard errors between the grades
    above and below some threshold; counted in one array for each grade."""
    has = np.zeros((GRADES, 1 << bits), np.int32)
    for g, p in zip(grade, places):
        has[g, p] += 1  # a document has each place once
    seen = np.bincount(grade, minlength=GRADES)
    found = [np.zeros(0, np.int64)]
    used = np.flatnonzero(has.any(axis=0))
    has = has[:, used]
    share = has.sum(axis=0) / len(grade)
    for k in range(GRADES - 1):
        m, n = seen[k + 1 :].sum(), seen[: k + 1].sum()
        if m and n:
            gap = np.abs(has[k + 1 :].sum(axis=0) / m - has[: k + 1].sum(axis=0) / n)
            found.append(used[gap >= SURE * np.sqrt(share * (1 - share) * (1 / m + 1 / n) + 1e-12)])
    return np.unique(np.concatenate(found))


def fit(places: list[np.ndarray], values: list[np.ndarray], grade: np.ndarray, bits: int = BITS, steps: int = 600, rate: float = 0.3, l1: float = 1e-4) -> Model:
    """Places and values of each document's features. Proximal Adam steps on
    the mean negative log-likelihood, grades weighted alike."""
    weights = np.zeros(1 << bits, np.float32)
    seen = np.bincount(grade, minlength=GRADES)
    if (seen > 0).sum() < 2:
        return Model(weights, np.full(GRADES - 1, -np.inf))
    names = bearing(places, grade, bits)
    if not len(names):
        names = np.zeros(1, np.int64)
    hits = [np.isin(p, names) for p in places]
    rows = np.repeat(np.arange(len(grade)), [int(h.sum()) for h in hits])
    at = np.searchsorted(names, np.concatenate([p[h] for p, h in zip(places, hits)]))
    value = np.concatenate([v[h] for v, h in zip(values, hits)]).astype(np.float64)
    share = 1 / (np.maximum(seen, 1) * (seen > 0).sum())
    each = share[grade]
    n = len(names)
    x = np.concatenate([np.zeros(n), [-5.0], np.ones(GRADES - 2)])  # weights, first threshold, log gaps
    mean, square = np.zeros(len(x)), np.zeros(len(x))
    for i in range(1, steps + 1):
        w, low, gap = x[:n], x[n], x[n + 1 :]
        f = np.bincount(rows, weights=value * w[at], minlength=len(grade))
        cut = np.concatenate(([-np.inf], low + np.concatenate(([0], np.cumsum(np.exp(gap)))), [np.inf]))
        with np.errstate(over="ignore"):
            a, b = (1 / (1 + np.exp(-(c - f))) for c in (cut[grade], cut[grade + 1]))
        p = np.maximum(b - a, 1e-12)
        df = -(a + b - 1) * each  # of the loss
        db, da = -b * (1 - b) / p * each, a * (1 - a) / p * each
        dcut = np.array([db[grade == k].sum() + da[grade == k + 1].sum() for k in range(GRADES - 1)])
        slope = np.concatenate([np.bincount(at, weights=value * df[rows], minlength=n), [dcut.sum()], [dcut[k + 1 :].sum() * np.exp(gap[k]) for k in range(GRADES - 2)]])
        mean += 0.1 * (slope - mean)
        square += 0.01 * (slope * slope - square)
        step = rate / (np.sqrt(square / (1 - 0.99**i)) + 1e-9)
        x -= step * mean / (1 - 0.9**i)
        x[:n] = np.minimum(x[:n] + step[:n] * l1, 0)
        if i == PRUNE_AT:  # what has no weight by now gets none
            live = x[:n] < 0
            at, rows, value = (np.cumsum(live) - 1)[at[live[at]]], rows[live[at]], value[live[at]]
            rest = np.concatenate([live, np.ones(GRADES - 1, bool)])
            names, x, mean, square, n = names[live], x[rest], mean[rest], square[rest], int(live.sum())
    w, low, gap = x[:n], x[n], x[n + 1 :]
    weights[names] = w
    model = Model(weights, low + np.concatenate(([0], np.cumsum(np.exp(gap)))))
    top = model.tails(np.bincount(rows, weights=value * w[at], minlength=len(grade)))[grade == GRADES - 1, -1]
    if len(top):
        model.keep = max(KEEP, 0.9 * float(np.quantile(top, LOSE)))
    return model


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of labels (doc_id, quality 0/1, toxic 0/1)."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.col("toxic") > 0, 1).otherwise(2)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, grades: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """A model of at most sample rows of docs with a grade (doc_id, grade)."""
    chosen = grades.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, values = [], []
            for _, _, data, offs in slices(batch.column("text")):
                doc, place, value = features(data, offs, bits)
                cut = np.searchsorted(doc, np.arange(len(offs)))
                for a, b in zip(cut[:-1], cut[1:]):
                    own, first = np.unique(place[a:b], return_index=True)  # places that meet count once
                    places.append(own.astype(np.int32).tobytes())
                    values.append(value[a:b][first].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["grade", "places", "values"])

    # The chosen rows are at most `sample` ids and grades, so they may be broadcast; an id's text is
    # that of the least hash, so there are no more texts than ids.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id", "grade").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    rows = one.select("grade", "t.text").mapInArrow(run, "grade int, places binary, values binary").toPandas()
    if not len(rows):
        return Model(np.zeros(1 << bits, np.float32), np.full(GRADES - 1, -np.inf))
    return fit([np.frombuffer(x, np.int32) for x in rows["places"]], [np.frombuffer(x, np.float16) for x in rows["values"]], rows["grade"].to_numpy(np.int64), bits)


SCORES = "expected_grade double, p_clean double"


def score(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """docs with expected_grade and p_clean, the chance of the top grade; columns of these names are replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORES)
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            m = sent.value
            out = []
            for _, _, data, offs in slices(pa.array(texts, pa.string(), from_pandas=True)):
                doc, place, value = features(data, offs, bits)
                out.append(np.bincount(doc, weights=value * m.weights[place], minlength=len(offs) - 1))
            tails = m.tails(np.concatenate(out) if out else np.zeros(0))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "p_clean": tails[:, -1]})

    own = [c for c in docs.columns if c not in ("expected_grade", "p_clean")]
    return docs.select(*own, rate(F.col("text").cast("string")).alias("scores__")).select(*own, "scores__.expected_grade", "scores__.p_clean")


def clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that reach the model's bound for the top grade."""
    model = train(docs, graded(labels), sample)
    return score(docs, model).where(F.col("p_clean") >= model.keep).select(*docs.columns)
