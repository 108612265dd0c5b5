"""Fuzzy passages that texts share, by chaining seeds and aligning chains.

Words are runs without white space, A-Z lower-cased. Seeds are SEED-word
k-mers, thinned by winnowing: every run of SEED + SPARSE - 1 words or more
that two texts share has a seed in both. Of a seed's occurrences, one text's
(that of the least row hash) stands for all; every other text's occurrence is
joined to it, so n occurrences give n - 1 links. A frequent seed may stand in a
text that shares nothing else. So an occurrence carries hashes of CONTEXTS, the
longer windows around it, and where one differs from that of the standing
occurrence and is not within a passage with the standing text, it is also joined
to a text that stands for that seed within that window: one where the window is
within such a passage if there is any. Texts that share LENGTH + 5 words in a row so have, for
a window of LENGTH words of them, a standing text in common, however many other
texts hold their seeds. A link whose window is shared too needs no second link.
What is left apart, a passage partly in one standing text and partly in another,
the alignment brings together, as it goes on past a chain's ends.

The links of a pair of texts are chained: the best sequence ascending in both,
worth SEED for each seed, less GAP for each word from one to the next on either side,
found with a Fenwick tree of prefix maxima in n log n. Chains ask for their
surroundings; those slices alone, of 32-bit word hashes, are cut from one text, sent to the other and aligned from
the chain outwards: runs of equal words, and where they end the cheapest
resumption within RESYNC words. A chain whose alignment comes to the edge of a
slice within its text asks again for slices that go FURTHER, until all alignments
end by themselves. Alignments of LENGTH words or more on both
sides are passages.

Defined results: null and short texts have no seeds; rows alike in doc_id and
text are one document, known by a 128-bit digest; repeats within one text are not
passages, and what a text repeats is found at its first place (a seed with the
same contexts counts once in a text); a null doc_id is carried as such; an empty
table has no passages. Seeds of one text only are told by a count and a bit map
before anything else is dealt. Frequent seeds are keys of an equi-join that is
pre-aggregated, so Spark splits them; texts that many chains compare others with are
dealt in shares of SHARE chains, counted by salted keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import bit_map, in_map, mark, released, stored
from spanlake.llm.textvec import BASE, SPACED, U, Words, grams, mix, powers, slices

SEED = 5
SPARSE = 12
GAP = 0.1
LEAST_SEEDS = 2
RESYNC = 24
RESUME = 4
#: Words passed over on either side, the nearest resumptions first, which are most of them.
NEAR = [(i, n - i) for n in (1, 2, 3) for i in range(n + 1)]
MARGIN = 64
FURTHER = 64
LENGTH = 45
SHARE = 256
#: Parts of the counts of a text's requests, so that a frequent text isn't one key.
SALTS = 16
#: (first word, counted from the seed's; words). A run of LENGTH + 5 words has a seed within
#: its first SPARSE words, and from it one of the latter two windows lies within the run.
CONTEXTS = ((0, 16), (0, LENGTH), (-SPARSE // 2, LENGTH))
AROUND = [f"c{i}" for i in range(len(CONTEXTS))]


def sown(words: Words, seed: int = SEED, sparse: int = SPARSE) -> np.ndarray:
    """First words of the k-mers that winnowing keeps: in each run of sparse k-mers
    within a text the last of the least; of a text with fewer, its least."""
    g = grams(words.hash, seed)
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    room = words.left()[:n] - seed + 1  # k-mers from here to the text's end
    keep = np.zeros(n, bool)
    m = n - sparse + 1
    if m > 0:
        least, at = g[:m].copy(), np.zeros(m, np.int64)
        for i in range(1, sparse):
            better = g[i : i + m] <= least
            least[better] = g[i : i + m][better]
            at[better] = i
        ok = room[:m] >= sparse
        keep[(np.arange(m) + at)[ok]] = True
    short = np.flatnonzero((np.diff(words.first) >= seed) & (np.diff(words.first) < seed + sparse - 1))
    for d in short.tolist():
        a, b = words.first[d], words.first[d + 1] - seed + 1
        keep[a + int(g[a:b].argmin())] = True
    return np.flatnonzero(keep)


def contexts(words: Words, at: np.ndarray, doc: np.ndarray) -> list[pa.Array]:
    """For each of CONTEXTS the hashes of the windows at those words; null where a window leaves the text."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, U)
    np.cumsum(words.hash * up[:-1], out=total[1:])
    out = []
    for first, n in CONTEXTS:
        a = at + first
        ok = (a >= words.first[doc]) & (a + n <= words.first[doc + 1])
        a = np.where(ok, a, 0)
        h = mix((total[np.where(ok, a + n, 0)] - total[a]) * down[a])
        out.append(pa.array(h.view(np.int64), mask=~ok))
    return out


def repeated(docs: DataFrame) -> DataFrame:
    """The seeds that several texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in slices(batch.column("text")):
                w = Words(data, offs, SPACED)
                at = sown(w)
                doc = np.searchsorted(w.first, at, "right") - 1
                seed = grams(w.hash, SEED)[at]
                once = np.unique(mix(doc.astype(U)) ^ seed, return_index=True)[1]
                yield pa.RecordBatch.from_arrays([pa.array(seed[once].view(np.int64))], ["seed"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "seed long").groupBy("seed").agg(F.count("*").alias("n")).where("n > 1").select("seed")


def seeds(docs: DataFrame, packed: Broadcast) -> DataFrame:
    """row (digest of doc_id and text), pos, seed, and hashes of the seed's contexts, of seeds that are in a
    map; of a text's occurrences with the same contexts the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            for i, _, data, offs in slices(batch.column("text")):
                w = Words(data, offs, SPACED)
                at = sown(w)
                seed = grams(w.hash, SEED)[at]
                some = in_map(packed.value, seed)
                at, seed = at[some], seed[some]
                doc = np.searchsorted(w.first, at, "right") - 1
                near = contexts(w, at, doc)
                same = mix(doc.astype(U)) ^ seed
                for c in near:
                    same = mix(same ^ c.fill_null(-1).to_numpy().view(U) * BASE)
                first = np.sort(np.unique(same, return_index=True)[1])
                at, doc, seed, pick = at[first], doc[first], seed[first], pa.array(first)
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(i + doc)), pa.array((at - w.first[doc]).astype(np.int32)), pa.array(seed.view(np.int64)), *(c.take(pick) for c in near)], ["row", "pos", "seed", *AROUND])

    return with_row(docs).select("row", "text").mapInArrow(run, "row binary, pos int, seed long, " + ", ".join(f"{c} long" for c in AROUND))


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, row, key (hash of row), text."""
    none = F.lit("\x00")
    row = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit("\x1f"), F.coalesce(F.col("text").cast("string"), none))))
    return docs.select("doc_id", row.alias("row"), F.col("text").cast("string").alias("text")).withColumn("key", F.xxhash64("row"))


def chains(points: list[tuple[int, int]], seed: int = SEED, gap: float = GAP, least: int = LEAST_SEEDS) -> list[list[tuple[int, int]]]:
    """Collinear chains of points (b, a), best first, no point in two of them.

    With linear gap costs, value(j) + gap * (a + b) is compared over all points
    that are before j on both axes: a prefix maximum over ranks of a.
    """
    points = sorted(set(points))
    if all(p[0] < q[0] and p[1] < q[1] for p, q in zip(points, points[1:])):
        # All in order: value + gap * (a + b) grows from point to point, so each follows the one before it, if any.
        value, link = [float(seed)] * len(points), [-1] * len(points)
        for j in range(1, len(points)):
            before = value[j - 1] - gap * (points[j][0] - points[j - 1][0] + points[j][1] - points[j - 1][1])
            if before > 0:
                value[j], link[j] = seed + before, j - 1
        return extracted(points, value, link, least)
    rank = {a: i for i, a in enumerate(sorted({a for _, a in points}), 1)}
    size = len(rank)
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    value, link = [0.0] * len(points), [-1] * len(points)
    i = 0
    while i < len(points):
        j = i
        while j < len(points) and points[j][0] == points[i][0]:
            b, a = points[j]
            best, r = (-1e18, -1), rank[a] - 1
            while r:
                if tree[r] > best:
                    best = tree[r]
                r -= r & -r
            value[j] = seed
            if best[1] >= 0 and best[0] - gap * (a + b) > 0:
                value[j], link[j] = seed + best[0] - gap * (a + b), best[1]
            j += 1
        for x in range(i, j):  # points of one b don't follow each other
            b, a = points[x]
            entry, r = (value[x] + gap * (a + b), x), rank[a]
            while r <= size:
                if entry > tree[r]:
                    tree[r] = entry
                r += r & -r
        i = j
    return extracted(points, value, link, least)


def extracted(points: list[tuple[int, int]], value: list[float], link: list[int], least: int) -> list[list[tuple[int, int]]]:
    """Chains from the best last point on, along links to points that no better chain has."""
    used, out = [False] * len(points), []
    for x in sorted(range(len(points)), key=lambda x: -value[x]):
        chain = []
        while x >= 0 and not used[x]:
            used[x] = True
            chain.append(points[x])
            x = link[x]
        if len(chain) >= least:
            out.append(chain[::-1])
    return out


def stretch(x: np.ndarray, y: np.ndarray, i: int, j: int) -> tuple[int, int, int]:
    """Align x[i:] with y[j:] from their beginnings: the ends reached and the equal words."""
    equal, size = 0, x.itemsize
    # Runs and near resumptions are compared as bytes, which takes a tenth of the time of small arrays.
    xs, ys = x.tobytes(), y.astype(x.dtype, copy=False).tobytes()
    while i < len(x) and j < len(y):
        n = min(len(x) - i, len(y) - j)
        step = 64
        run = 0
        while run < n:
            more = min(step, n - run)
            p, q = i + run, j + run
            if xs[p * size : (p + more) * size] == ys[q * size : (q + more) * size]:
                run += more
                step *= 2
            else:
                run += int((x[p : p + more] == y[q : q + more]).argmin())
                break
        i, j, equal = i + run, j + run, equal + run
        if i == len(x) or j == len(y):
            break
        # The resumption with the fewest words passed over, RESUME equal words long; of as many, the fewest of x.
        for di, dj in NEAR:
            if i + di + RESUME <= len(x) and j + dj + RESUME <= len(y) and xs[(i + di) * size : (i + di + RESUME) * size] == ys[(j + dj) * size : (j + dj + RESUME) * size]:
                i, j = i + di, j + dj
                break
        else:
            p, q = x[i : i + RESYNC + RESUME], y[j : j + RESYNC + RESUME]
            n, m = len(p) - RESUME + 1, len(q) - RESUME + 1
            if n <= 0 or m <= 0:
                break
            hit = np.ones((n, m), bool)
            for s in range(RESUME):
                hit &= p[s : s + n, None] == q[None, s : s + m]
            di, dj = np.nonzero(hit)
            if not len(di):
                break
            best = int(np.argmin(di + dj))
            i, j = i + int(di[best]), j + int(dj[best])
    return i, j, equal


def aligned(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]], least: int = LENGTH, ends: tuple[bool, bool, bool, bool] = (True,) * 4) -> tuple[list[tuple[int, int, int, int, int]], bool]:
    """Passages (b0, b1, a0, a1, equal words) around the anchors (places in x and y), and whether more
    words could change them. ends: whether x begins and ends, and y begins and ends, where its text does."""
    out, done, more = [], (-1, -1), False
    x_first, x_last, y_first, y_last = ends
    near = RESYNC + RESUME
    for b, a in anchors:
        if b < done[0] or a < done[1] or b >= len(x) or a >= len(y) or x[b] != y[a]:
            continue
        b1, a1, right = stretch(x, y, b, a)
        # Backwards from the same anchor; trailing ends are trimmed to equal words by stretch().
        lb, la, left = stretch(x[:b][::-1], y[:a][::-1], 0, 0)
        b0, a0 = b - lb, a - la
        done = (b1, a1)
        if not (x_last and b1 == len(x) or y_last and a1 == len(y)):
            more |= not x_last and b1 + near > len(x) or not y_last and a1 + near > len(y)
        if not (x_first and not b0 or y_first and not a0):
            more |= not x_first and b0 < near or not y_first and a0 < near
        if min(b1 - b0, a1 - a0) >= least:
            out.append((b0, b1, a0, a1, left + right))
    return out, more


PASSAGES = "b_row binary, b_doc {0}, b_start int, b_end int, a_row binary, a_doc {0}, a_start int, a_end int, equal int, chain binary, more boolean"


def shared_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end (in words), equal (words):
    each passage that a document shares with those that stand for its seeds and their contexts."""
    spark, kind, begun = docs.sparkSession, dict(docs.dtypes)["doc_id"], mark()
    known = spark.sparkContext.broadcast(bit_map(stored(repeated(docs), "repeated"), "seed"))
    released(spark, begun)
    sown_ = stored(seeds(docs, known), "sown")
    # Written, so that the join deals both sides anew and Spark can split a frequent seed.
    first = sown_.groupBy("seed").agg(F.min(F.struct("row", "pos", *AROUND)).alias("f"), F.count("*").alias("n")).where("n > 1").select("seed", F.col("f.row").alias("a_row"), F.col("f.pos").alias("a"), *(F.col(f"f.{c}").alias(f"a_{c}") for c in AROUND))
    first = stored(first, "firsts")
    released(spark, begun, sown_, first)
    # wide: a context is shared too; the contexts that are not are kept.
    wide = F.coalesce(F.greatest(*(F.col(c) == F.col(f"a_{c}") for c in AROUND)), F.lit(False))
    other = [F.when(~F.col(c).eqNullSafe(F.col(f"a_{c}")), F.col(c)).alias(c) for c in AROUND]
    met = sown_.join(first, "seed").select(F.col("row").alias("b_row"), "a_row", F.col("pos").alias("b"), "a", wide.alias("wide"), "seed", *other)
    unlike = F.coalesce(*AROUND).isNotNull()
    met = stored(met.where((F.col("b_row") != F.col("a_row")) | unlike), "met")
    released(spark, begun, met)
    chained = chains_of(met.where("b_row != a_row").select("b_row", "a_row", "b", "a", "wide"))
    released(spark, begun, met, chained)
    words = hashed(docs, chained, kind)
    got = [with_slices(words, chained, kind)]
    released(spark, begun, met, chained, got[0])
    ranges = got[0].where("b_start is not null").groupBy("b_row", "a_row").agg(F.collect_list(F.struct("b_start", "b_end")).alias("ranges"))
    key = lambda i, at, n: F.struct(F.xxhash64(F.lit(i), "seed", AROUND[i]).alias("key"), (F.col("b") + at).alias("from"), (F.col("b") + at + n).alias("to"))
    keys = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), key(i, *CONTEXTS[i])) for i, c in enumerate(AROUND))))
    rest = met.where(unlike).join(ranges, ["b_row", "a_row"], "left").select(F.explode(keys).alias("k"), "b_row", "b", "ranges")
    within = F.exists("ranges", lambda r: (r["b_start"] <= F.col("k.from")) & (r["b_end"] >= F.col("k.to")))
    rest = stored(rest.select("k.key", "b_row", "b", (~F.coalesce(within, F.lit(False))).alias("left")), "rest")
    released(spark, begun, rest, chained, got[0])
    # Windows of one text only, or that are all within passages, go before their rows are dealt.
    due = rest.groupBy("key").agg(F.count("*").alias("n"), F.max("left").alias("any")).where("n > 1 and any").select("key")
    due = spark.sparkContext.broadcast(bit_map(stored(due, "due"), "key"))
    rest = kept(rest, due)
    heads = rest.groupBy("key").agg(F.min(F.struct("left", "b_row", "b")).alias("f"), F.count("*").alias("n"), F.max("left").alias("any")).where("n > 1 and any")
    heads = stored(heads.select("key", F.col("f.b_row").alias("a_row"), F.col("f.b").alias("a")), "heads")
    again = rest.where("left").join(heads, "key").where("b_row != a_row").select("b_row", "a_row", "b", "a", F.lit(True).alias("wide"))
    later = chains_of(again)
    while True:
        open_ = got[-1].where("more").select("chain").distinct()
        chained = chained.join(open_, "chain", "left_semi").withColumn("margin", F.col("margin") * FURTHER).select(*later.columns)
        chained = stored(chained if len(got) > 1 else chained.unionByName(later), "further")
        if chained.isEmpty():
            break
        if len(got) == 1:
            released(spark, begun, chained, *got)
            words = hashed(docs, chained, kind)
        got.append(with_slices(words, chained, kind))
        released(spark, begun, words, chained, *got)
    passages = reduce(DataFrame.unionByName, got).where("not more")
    released(spark, begun, passages)
    place = {"doc_id": "b_doc", "start": "b_start", "end": "b_end", "other_id": "a_doc", "other_start": "a_start", "other_end": "a_end"}
    return passages.groupBy(*(F.col(c).alias(n) for n, c in place.items())).agg(F.max("equal").alias("equal_words"))


def kept(rows: DataFrame, packed: Broadcast) -> DataFrame:
    """The rows whose key is in a map; only keys go to Python."""

    @F.arrow_udf("boolean")
    def hit(key: pa.Array) -> pa.Array:
        return pa.array(in_map(packed.value, key.to_numpy().view(U)))

    return rows.where(hit("key"))


def chains_of(links: DataFrame) -> DataFrame:
    """The chains of links (b_row, a_row, b, a, wide), written."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, strong = None, set(), set()
        rows: list[tuple] = []
        schema = pa.schema([("b_row", pa.binary()), ("a_row", pa.binary()), ("b_from", pa.int32()), ("b_to", pa.int32()), ("a_from", pa.int32()), ("a_to", pa.int32()), ("anchors", pa.binary())])

        def close() -> None:
            if len(points) >= LEAST_SEEDS or strong:
                found = chains(points, least=1)
                # A run of one word over and over has many places on one side, one on the other.
                for c in [c for c in found if len(c) >= LEAST_SEEDS or not strong.isdisjoint(c)] or found[:1]:
                    rows.append((*now, c[0][0], c[-1][0], c[0][1], c[-1][1], np.array(c, "<i4").tobytes()))

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [[]] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for b_row, a_row, b, a, wide in zip(*(batch.column(c).to_pylist() for c in ("b_row", "a_row", "b", "a", "wide"))):
                if now != (b_row, a_row):
                    close()
                    now, points, strong = (b_row, a_row), set(), set()
                points.add((b, a))
                if wide:
                    strong.add((b, a))
            yield out()
        close()
        yield out()

    found = links.repartition("b_row", "a_row").sortWithinPartitions("b_row", "a_row", "b").mapInArrow(chain, "b_row binary, a_row binary, b_from int, b_to int, a_from int, a_to int, anchors binary")
    # A chain is named by a digest of its texts and its points.
    return stored(found.withColumn("chain", F.unhex(F.md5(F.concat("b_row", "a_row", "anchors")))).withColumn("margin", F.lit(MARGIN)), "chains")


def hashed(docs: DataFrame, named: DataFrame, kind: str) -> DataFrame:
    """row, doc_id, words (32-bit hashes) of the texts that chains ask for, written once for all slices that are
    cut from them; with a few others that a map lets through. Rows alike come as often as they are there."""
    both = named.select(F.xxhash64("b_row").alias("key")).unionByName(named.select(F.xxhash64("a_row").alias("key")))
    packed = docs.sparkSession.sparkContext.broadcast(bit_map(both, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offs in slices(batch.column("text")):
                w = Words(data, offs, SPACED)
                h = (w.hash >> U(32)).astype("<u4")
                words = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((w.first * 4).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), words], ["row", "doc_id", "words"])

    return stored(kept(with_row(docs), packed).select("row", "doc_id", "text").mapInArrow(run, f"row binary, doc_id {kind}, words binary"), "words")


SLICES = "row binary, share int, chain binary, doc_id {0}, words binary, b_row binary, begin int, last boolean, a_begin int, a_end int, anchors binary"


def with_slices(words: DataFrame, named: DataFrame, kind: str) -> DataFrame:
    """PASSAGES of chains by the slices they ask for, written; more: a wider slice could change the chain's.

    A slice of a chain's text b is sent to its text a, which is sent once for all its chains, or for SHARE of them.
    A text's chains as b are bounded by its seeds, those as a are not."""
    spark = words.sparkSession
    map_of = lambda df, row: spark.sparkContext.broadcast(bit_map(df.select(F.xxhash64(row).alias("key")), "key"))
    keyed = words.withColumn("key", F.xxhash64("row"))
    hubs = named.groupBy(F.col("a_row").alias("row")).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")).where("shares > 1")
    hubs = stored(hubs, "hubs")
    # A few texts may have most of the chains: their counts are joined on in SALTS parts.
    parts = hubs.select(F.col("row").alias("a_row"), "shares", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = named.withColumn("salt", F.pmod(F.xxhash64("chain"), F.lit(SALTS)).cast("int")).join(parts, ["a_row", "salt"], "left")
    begin = lambda c: F.greatest(F.col(c) - F.col("margin"), F.lit(0))
    end = lambda c: F.col(c) + SEED + F.col("margin")
    share = F.coalesce(F.pmod(F.xxhash64("chain"), F.col("shares")), F.lit(0)).cast("int").alias("share")
    asks = dealt.select(F.col("b_row").alias("row"), "chain", "a_row", share, begin("b_from").alias("begin"), end("b_to").alias("end"), begin("a_from").alias("a_begin"), end("a_to").alias("a_end"), "anchors")
    # By row, its text before what is asked of it: a null chain comes first.
    asked = kept(keyed, map_of(named, "b_row")).drop("key").unionByName(asks, allowMissingColumns=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, text, doc = None, b"", None
        for batch in batches:
            picked, begins, lasts, cuts, docs = [], [], [], [], []
            columns = [batch.column(c).to_pylist() for c in ("row", "chain", "doc_id", "words", "begin", "end")]
            for i, (row, chain, doc_id, whole, first, past) in enumerate(zip(*columns)):
                if chain is None:
                    now, text, doc = row, whole, doc_id
                    continue
                if row != now:
                    raise ValueError("a slice is asked of a text that is not there")
                picked.append(i)
                cuts.append(text[4 * first : 4 * past])
                lasts.append(4 * past >= len(text))
                docs.append(doc)
            own = batch.take(pa.array(picked, pa.int32()))
            arrays = [own.column("a_row"), own.column("share"), own.column("chain"), pa.array(docs, batch.schema.field("doc_id").type), pa.array(cuts, pa.binary()), own.column("row"), own.column("begin"), pa.array(lasts, pa.bool_()), own.column("a_begin"), own.column("a_end"), own.column("anchors")]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SLICES.split(", ")])

    asked = asked.repartition("row").sortWithinPartitions("row", "chain")
    pieces = asked.mapInArrow(cut, SLICES.format(kind))
    whole = kept(keyed, map_of(named, "a_row")).drop("key").withColumn("share", F.lit(0))
    more = kept(keyed, map_of(hubs, "row")).drop("key").join(hubs, "row").withColumn("share", F.explode(F.sequence(F.lit(1), F.col("shares") - 1))).drop("shares")
    met = pieces.unionByName(whole.unionByName(more), allowMissingColumns=True)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PASSAGES.split(", ")]
        now, text, a_doc = None, np.zeros(0, np.uint32), None
        for batch in batches:
            out: list[tuple] = []
            doc_type = batch.schema.field("doc_id").type
            columns = [batch.column(c).to_pylist() for c in ("row", "share", "chain", "doc_id", "words", "b_row", "begin", "last", "a_begin", "a_end", "anchors")]
            for a_row, part, chain, doc, words, b_row, begin, last, a_begin, a_end, anchors in zip(*columns):
                if chain is None:
                    now, text, a_doc = (a_row, part), np.frombuffer(words, "<u4"), doc
                    continue
                if now != (a_row, part):
                    raise ValueError("a chain came without its other side")
                points = np.frombuffer(anchors, "<i4").reshape(-1, 2) - [begin, a_begin]
                ends = not begin, last, not a_begin, a_end >= len(text)
                own, more = aligned(np.frombuffer(words, "<u4"), text[a_begin:a_end], points.tolist(), ends=ends)
                for b0, b1, a0, a1, equal in own:
                    out.append((b_row, doc, b0 + begin, b1 + begin, a_row, a_doc, a0 + a_begin, a1 + a_begin, equal, chain, more))
                if more and not own:
                    out.append((b_row, doc, None, None, a_row, a_doc, None, None, None, chain, more))
            cols = list(zip(*out)) or [[]] * 11
            types = (pa.binary(), doc_type, pa.int32(), pa.int32(), pa.binary(), doc_type, pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    passages = met.repartition("row", "share").sortWithinPartitions("row", "share", "chain").mapInArrow(align, PASSAGES.format(kind))
    return stored(passages, "passages")
