"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one class, and classes are compared by cosine, in
double precision, with classes of their label and length.

A pass hashes vectors by random planes and sorts them by label and the bits,
in order, so vectors at a small angle tend to stand close. Each is compared with
the WINDOW that follow it. The sorted rows are cut into blocks of BLOCK rows
(each with the first WINDOW of the next), whatever labels they have, so no task
depends on a label's size. In a block, verified pairs are united at once and
the roots compared again among themselves until nothing new is found, so a
crowd of copies doesn't part those on its two sides; a vector gives one edge to
its root, not one for each pair. All passes' edges are united by alternating
stars. There are as many passes as find a pair at the bound with
probability RECALL, by the size of the largest label: log(1 - RECALL) /
log(1 - p^b), p the chance that a plane doesn't part the pair, b the bits after
which half a window is left.

Then links are counted in each component, so that a window's bound loses none
there: members within half the angle of a centre (a mean of members, CELLS
times, each time of those left) are linked with each other for certain, by the
triangle inequality, and counted by their sum. Only what remains, members
of no cell and members of two cells, is met: sorted by cell and angle to the
component's centre, in tiles of TILE, of which those whose angles differ too
much are left out; a task counts one pair of tiles and emits counts, not pairs.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, nor do those whose label is null. Repeated rows are
vectors of their own, also with equal ids. A component's id is its least id that
isn't null. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored
from spanlake.llm.graph import components
from spanlake.llm.vectors import placed, sound

THRESHOLD = 0.93
WINDOW = 64
BLOCK = 4096
TILE = 512
RECALL = 0.98
CELLS = 3
PLANES = 62
SEED = 20

#: Members whose mean is a centre.
SAMPLED = 32

#: Angles are certain to this, in radians.
MARGIN = 1e-6


def passes(largest: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes that find a pair at the threshold with this probability, in a label of so many vectors."""
    bits = max(0.0, math.log2(max(largest, 1) / (window / 2)))
    found = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))


@functools.lru_cache(8)
def _planes(run: int, d: int) -> np.ndarray:
    return np.random.default_rng([SEED, run, d]).standard_normal((d, PLANES))


def _unit(vectors: pd.Series) -> np.ndarray:
    """Rows of one length, of norm 1; scaled before, so that squares neither overflow nor vanish."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _hashed(runs: int):
    def run(batches):
        bits = 1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for d, same in batch.groupby("d", sort=False):
                u = _unit(same["v"])
                for k in range(runs):
                    yield pd.DataFrame({"pass": k, "label": same["label"], "d": d, "key": (u @ _planes(k, d) >= 0) @ bits, "node": same["node"]})

    return run


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member that each of n is joined to by pairs a, b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        root = root[root]
        if np.array_equal(before, root):
            return root


def _close(u: np.ndarray, window: int, threshold: float) -> np.ndarray:
    """Roots of rows united with those up to a window after them, again among the roots until none is new."""
    root, leaders = np.arange(len(u)), np.arange(len(u))
    while True:
        rows, pairs = u[leaders], []
        for step in range(1, min(window, len(rows) - 1) + 1):
            hit = np.flatnonzero(np.einsum("ij,ij->i", rows[:-step], rows[step:]) >= threshold)
            pairs.append((hit, hit + step))
        a, b = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
        if not len(a):
            return root
        own = _united(len(rows), a, b)
        moved = np.arange(len(u))
        moved[leaders] = leaders[own]
        root, leaders = moved[root], leaders[np.unique(own)]


def _edges(window: int, threshold: float):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", kind="stable")
        span = (block["pass"].to_numpy(), block["d"].to_numpy(), pd.factorize(block["label"])[0])
        new = np.flatnonzero(np.logical_or.reduce([s[1:] != s[:-1] for s in span])) + 1
        nodes, out = block["node"].to_numpy(), []
        for first, end in zip([0, *new], [*new, len(block)]):
            root = _close(_unit(block["v"].iloc[first:end]), window, threshold) + first
            moved = np.flatnonzero(root != np.arange(first, end)) + first
            out.append(pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved - first]]}))
        return pd.concat(out)

    return run


def edges(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, recall: float = RECALL) -> DataFrame:
    """Verified pairs (a, b) of nodes that join all that the passes found. classes: stored node, label, d, v."""
    largest = classes.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 0
    kinds = dict(classes.dtypes)
    keys = classes.select("label", "d", "v", "node").mapInPandas(_hashed(passes(largest, threshold, window, recall)), f"pass int, label {kinds['label']}, d int, key long, node long")
    sorted_ = placed(keys, ["pass", "label", "d", "key", "node"], "sorted").drop("key")
    own = F.floor(F.col("pos") / block)
    before = F.when((F.col("pos") % block < window) & (F.col("pos") >= block), own - 1)
    dealt = sorted_.withColumn("block", F.explode(F.array_compact(F.array(own, before))))
    dealt = dealt.join(classes.select("node", "v"), "node")
    return dealt.groupBy("block").applyInPandas(_edges(window, threshold), "a long, b long")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _angle(members: DataFrame, centres: DataFrame, name: str) -> DataFrame:
    """members with the angle (name) to their root's centre."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(F.col("u"), F.col("centre"))))
    return members.join(centres, "root").withColumn(name, F.coalesce(F.acos(cosine), F.lit(math.pi))).drop("centre")


def _with_unit(batches):
    """Members with u, their vector at norm 1, in place of v."""
    for batch in batches:
        for _, same in batch.groupby("d", sort=False):
            yield same.drop(columns=["v", "d"]).assign(u=list(_unit(same["v"])))


def _means(batches):
    for batch in batches:
        sums = [np.stack(vectors).sum(0) for vectors in batch["all"]]
        yield pd.DataFrame({"root": batch["root"], "centre": [s / max(np.sqrt(s @ s), 1e-300) for s in sums]})


def _centres(members: DataFrame) -> DataFrame:
    """(root, centre): the direction of the mean of at most SAMPLED members, chosen by hash."""
    chosen = members.withColumn("h", F.xxhash64("node")).groupBy("root", F.pmod("h", F.lit(SAMPLED)).alias("of")).agg(F.min_by("u", "h").alias("u"))
    return chosen.groupBy("root").agg(F.collect_list("u").alias("all")).mapInPandas(_means, "root long, centre array<double>")


def _counted(threshold: float):
    def run(pair: pd.DataFrame) -> pd.DataFrame:
        one, two = pair[pair["side"] == 0], pair[pair["side"] == 1]
        alone = two.empty
        other = one if alone else two
        linked = np.stack(one["u"].to_numpy()) @ np.stack(other["u"].to_numpy()).T >= threshold
        if alone:
            np.fill_diagonal(linked, False)
        out = [pd.DataFrame({"node": one["node"], "more": linked @ other["n"].to_numpy()})]
        if not alone:
            out.append(pd.DataFrame({"node": two["node"], "more": one["n"].to_numpy() @ linked}))
        return pd.concat(out)

    return run


def links(members: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """(node, links): how many vectors of its component, itself left out, each class is linked with.
    members: stored node, root, n (vectors of the class), u (norm 1)."""
    angle = math.acos(threshold)
    left, done = members, None
    for k in range(cells):
        seen = _angle(left, _centres(left), "off")
        if not k:
            seen = seen.withColumn("alpha", F.col("off"))
        inside = F.col("off") <= angle / 2 - MARGIN
        seen = stored(seen.withColumn("cell", F.when(inside, F.lit(k))).drop("off"), "cells")
        now, left = seen.where("cell IS NOT NULL"), seen.where("cell IS NULL").drop("cell")
        done = now if done is None else done.unionByName(now)
        if left.isEmpty():
            break
    placed_in = done.unionByName(left.withColumn("cell", F.lit(cells)))
    within = placed_in.where(F.col("cell") < cells).groupBy("root", "cell").agg(F.sum("n").alias("all"))
    several = placed_in.groupBy("root").agg(F.max("cell").alias("most"), F.min("cell").alias("least")).where((F.col("most") > F.col("least")) | (F.col("most") == cells)).select("root")
    counts = placed_in.select("root", "cell", "node", "n").join(within, ["root", "cell"], "left")
    counts = counts.select("node", F.coalesce(F.col("all"), F.col("n")).alias("links"))

    apart = stored(placed_in.join(several, "root"), "apart")
    if not apart.isEmpty():
        ordered = placed(apart, ["root", "cell", "alpha", "node"], "tiles").withColumn("tile", F.floor(F.col("pos") / tile))
        ordered = stored(ordered, "tiled")
        bounds = ordered.groupBy("root", "cell", "tile").agg(F.min("alpha").alias("low"), F.max("alpha").alias("high"))
        a, b = (bounds.select("root", *(F.col(c).alias(c + s) for c in ("cell", "tile", "low", "high"))) for s in "ab")
        met = a.join(b, "root").where((F.col("cella") < F.col("cellb")) | ((F.col("cella") == cells) & (F.col("cellb") == cells) & (F.col("tilea") <= F.col("tileb"))))
        met = met.where((F.col("lowa") - F.col("highb") <= angle + MARGIN) & (F.col("lowb") - F.col("higha") <= angle + MARGIN))
        met = stored(met.select("root", "cella", "tilea", "cellb", "tileb").withColumn("pair", F.monotonically_increasing_id()), "met")
        alone = (F.col("tilea") == F.col("tileb")) & (F.col("cella") == F.col("cellb"))
        sides = met.select("root", "pair", F.lit(0).alias("side"), F.col("cella").alias("cell"), F.col("tilea").alias("tile")).union(met.where(~alone).select("root", "pair", F.lit(1), "cellb", "tileb"))
        more = sides.join(ordered.select("root", "cell", "tile", "node", "n", "u"), ["root", "cell", "tile"]).select("pair", "side", "node", "n", "u")
        more = more.groupBy("pair").applyInPandas(_counted(threshold), "node long, more long")
        counts = counts.union(more)
    return counts.groupBy("node").agg((F.sum("links") - 1).alias("links"))


def near_duplicates(
    df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW, block: int = BLOCK, recall: float = RECALL, tile: int = TILE
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; kept is true for a component's least id."""
    rows = df.select(F.col(id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    usable = sound("v") & F.exists("v", lambda x: x != 0) & F.col("label").isNotNull()
    classes = rows.where(usable).groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("d", F.size("v")).withColumn("node", F.monotonically_increasing_id()), "vectors")

    roots = stored(components(edges(classes, threshold, window, block, recall), "passes"), "roots")
    roots = roots.union(roots.select("root", "root").distinct())
    kind = dict(classes.dtypes)["least"]
    members = classes.join(roots, "node").select("node", "root", "n", "least", "d", "v")
    members = stored(members.mapInPandas(_with_unit, f"node long, root long, n long, least {kind}, u array<double>"), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component"))
    found = members.select("node", "root").join(least, "root").join(links(members.drop("least"), threshold, tile), "node")
    found = classes.join(found, "node", "left").select("label", "v", F.coalesce("component", "least").alias("component_id"), F.coalesce("links", F.col("n") - 1).alias("n_links"))

    found = rows.join(found, ["label", "v"], "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
