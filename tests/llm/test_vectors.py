"""The operators on vectors against brute force: codes, near vectors, whitening."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from spanlake.llm import codes, neighbours, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v int, n long, root long, id string, node long, cell int"


def table_of(spark, rows, kind="float"):
    """Rows (id, vector, label), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, l, 1, 2, 3, "x", 4, 5) for i, v, l in rows], SCHEMA.replace("float", kind)).repartition(3)


def vector(v):
    return None if v is None else [float(np.float32(x)) if x is not None else None for x in v]


def odd(d):
    nan, inf = float("nan"), float("inf")
    return [
        (900, None, 1), (901, [], 1), (902, [nan] + [0.0] * (d - 1), 1), (903, [inf] + [0.0] * (d - 1), 2), (904, [None] + [1.0] * (d - 1), 1), (905, [0.0] * d, 1), (905, [-0.0] * d, None),
        (None, [0.5] * d, 1), (None, [0.5] * d, None), (906, [1.0, 2.0], 1), (7, [0.25] * d, 3), (7, [0.25] * d, 3), (7, [-0.25] * d, 3),
    ]


def random_rows(n, d, seed, labels=4):
    r = np.random.default_rng(seed)
    rows = [(i, vector(r.standard_normal(d) / 4), int(r.integers(labels))) for i in range(n)]
    return rows + [(n + k, rows[k][1], rows[k][2] if k % 2 else None) for k in range(10)]


def usable(rows, d):
    return [(i, v, l) for i, v, l in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]


def floors(v):
    return [math.floor(256 * x) if math.isfinite(256 * x) else 256 * int(x) for x in v]


# ---- op 11


def brute_codes(rows, d, parts, entries, rounds):
    rows = usable(rows, d)
    width = -(-d // parts)
    x = [[(floors(v) + [0] * (width * parts - d))[p * width : p * width + width] for p in range(parts)] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))[:entries]
    books = [[x[k][p] for k in order] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda p: [min((far(r[p], e), k) for k, e in enumerate(books[p])) for r in x]
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for r, (_, k) in zip(x, assign(p)):
                groups[k].append(r[p])
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    final = [assign(p) for p in range(parts)]
    out, by_label = [], defaultdict(int)
    for k, (i, _, l) in enumerate(rows):
        error = sum(final[p][k][0] for p in range(parts))
        by_label[l] += error
        out.append([i, l, "".join(f"{final[p][k][1]:02x}" for p in range(parts)), error])
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(*r, by_label[r[1]]) for r in out], key=repr), digest


@pytest.mark.parametrize("d,parts,entries", [(32, 16, 64), (20, 16, 5), (8, 4, 64)])
def test_codes_equal_brute_force(spark, d, parts, entries):
    rows = random_rows(150, d, 1) + odd(d)
    found, books = codes.encode(table_of(spark, rows), parts=parts, entries=entries)
    want, digest = brute_codes(rows, d, parts, entries, 2)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert codes.digest(books) == digest


def test_codes_of_fewer_rows_than_entries_ties_and_none(spark):
    same = [(k, [1.0] * 16, None) for k in range(3)] + [(9, [2.0] * 16, None)]
    found, _ = codes.encode(table_of(spark, same))
    assert sorted((r["id"], r["code"], r["error"], r["label_error"]) for r in found.collect()) == [(0, "00" * 16, 0, 0), (1, "00" * 16, 0, 0), (2, "00" * 16, 0, 0), (9, "03" * 16, 0, 0)]
    for rows in ([], [(1, None, 1), (2, [], 2)]):
        found, books = codes.encode(table_of(spark, rows))
        assert found.columns == ["id", "label", "code", "error", "label_error"] and not found.collect() and codes.digest(books) == hashlib.sha256(b"").hexdigest()


def test_codes_of_huge_components(spark):
    rows = [(k, [float(3.0e38 * (k - 5)) if k != 5 else 1e-40] + [float(k)] * 15, k % 2) for k in range(11)] + [(20, [1.7e308] * 16, 0)]
    found, books = codes.encode(table_of(spark, rows, "double"), entries=4)
    want, digest = brute_codes(rows, 16, 16, 4, 2)
    fits = lambda e: e if e < 2**63 else None
    assert [(r["id"], r["code"], r["error"]) for r in sorted(found.collect(), key=lambda r: repr(tuple(r))) if r["error"] is not None] == [w[:1] + w[2:4] for w in want if fits(w[3]) is not None]
    assert {r["label_error"] for r in found.collect()} <= {None} and codes.digest(books) == digest


def test_nearest_evaluates_the_whole_annulus():
    r = np.random.default_rng(3)
    for trial in range(200):
        k = int(r.integers(1, 5))
        entries, points = r.integers(-4, 5, (int(r.integers(1, 70)), k)), r.integers(-6, 7, (40, k))
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        index, best = codes.nearest(points, entries)
        assert (index == far.argmin(1)).all() and (best == far.min(1)).all()


# ---- op 12


def brute_links(rows, threshold=0.93):
    rows = list(rows)
    sound = [k for k, (_, v, l) in enumerate(rows) if l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    groups = defaultdict(list)
    for k in sound:
        groups[rows[k][2], len(rows[k][1])].append(k)
    for members in groups.values():
        x = np.array([rows[k][1] for k in members], np.float64)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        near = x @ x.T >= threshold
        for a, b in zip(*np.nonzero(np.triu(near, 1))):
            n[members[a]] += 1
            n[members[b]] += 1
            root[find(members[a])] = find(members[b])
    least = defaultdict(lambda: None)
    for k, (i, _, _) in enumerate(rows):
        r = find(k)
        least[r] = i if least[r] is None else least[r] if i is None else min(i, least[r])
    return sorted([(i, n[k], least[find(k)], i == least[find(k)]) for k, (i, _, _) in enumerate(rows)], key=repr)


def at_angle(r, u, cosine):
    """A vector whose cosine with u is this."""
    w = r.standard_normal(len(u))
    w -= w @ u / (u @ u) * u
    return cosine * u / np.linalg.norm(u) + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def crowded(d=32, seed=5):
    """Copies, a dense ball, a loose ball, chains, pairs about the bound, and strangers."""
    r, rows = np.random.default_rng(seed), []
    add = lambda v, l: rows.append((len(rows), vector(v), l))
    centre = r.standard_normal(d)
    for _ in range(300):
        add(at_angle(r, centre, 0.99) * r.uniform(0.1, 9), 1)
    for _ in range(150):
        add(at_angle(r, centre, 0.965), 2)
    for k in range(40):
        step = r.standard_normal(d)
        add(step, k % 3)
        for _ in range(6):
            step = at_angle(r, step, 0.945)
            add(step, k % 3)
    for k in range(200):
        u = r.standard_normal(d)
        add(u, k % 3)
        add(at_angle(r, u, 0.915 + 0.04 * r.random()), k % 3)
    for _ in range(60):
        add(rows[0][1], 1)
    return rows


def test_near_vectors_equal_brute_force(spark):
    rows = crowded() + odd(32)
    df = neighbours.near_duplicates(table_of(spark, rows), window=16, block=128, recall=0.9999, tile=64)
    assert df.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in df.collect()), key=repr) == brute_links(rows)


def test_near_vectors_recall_at_the_bound(spark):
    """With production parameters: pairs just above the bound, in one label of 12,000."""
    r, rows = np.random.default_rng(8), []
    for k in range(6000):
        u = r.standard_normal(48)
        rows += [(2 * k, vector(u), 1), (2 * k + 1, vector(at_angle(r, u, 0.9303 if k % 2 else 0.95)), 1)]
    got = {x["vec_id"]: x for x in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    found = [got[2 * k]["n_links"] == 1 and got[2 * k + 1]["component_id"] == 2 * k for k in range(6000)]
    assert sum(found) / 6000 > 0.97
    assert all(x["n_links"] <= 1 for x in got.values())


def test_near_vectors_of_nothing(spark):
    for rows in ([], [(1, None, 1), (2, [0.0], 1), (3, [1.0], None)]):
        df = neighbours.near_duplicates(table_of(spark, rows))
        assert sorted(tuple(r) for r in df.collect()) == [(i, 0, i, True) for i, _, _ in rows]


def test_passes_grow_with_the_label():
    assert neighbours.passes(10) == 1 and 5 < neighbours.passes(6000) < 15 < neighbours.passes(10**8) < 80


# ---- op 13


def brute_white(rows, d, components=4):
    rows = usable(rows, d)
    x = [floors(v) for _, v, _ in rows]
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums).astype(np.float64) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = lambda v: (np.array([n * a - s for a, s in zip(v, sums)], np.float64) / n) @ vectors[:, :components] / np.sqrt(values[:components])
    return [(i, sum((n * a - s) ** 2 for a, s in zip(v, sums)), white(v)) for (i, _, _), v in zip(rows, x)], values / values.sum(), n


def test_whitening_equals_brute_force(spark):
    d = 24
    rows = random_rows(400, d, 2) + odd(d)
    scale = np.linspace(1, 3, d)
    rows = [(i, vector(np.array(v) * scale) if v and len(v) == d and None not in v else v, l) for i, v, l in rows]
    found, w = whitening.whiten(table_of(spark, rows))
    want, explained, n = brute_white(rows, d)
    assert w.n == n and np.allclose(w.explained, explained[:4], rtol=1e-9) and w.identity_error < 1e-9
    got = sorted(found.collect(), key=lambda r: (repr(r["id"]), r["deviation"]))
    want.sort(key=lambda r: (repr(r[0]), r[1]))
    assert [(r["id"], int(r["deviation"])) for r in got] == [r[:2] for r in want]
    a, b = np.array([r["whitened"] for r in got]), np.array([r[2] for r in want])
    assert np.allclose(a * np.sign((a * b).sum(0)), b, atol=1e-8)


def test_triangles_are_merged_in_a_tree(spark):
    rows = spark.createDataFrame([(k, vector(np.random.default_rng(k).standard_normal(5)), 1) for k in range(300)], "vec_id long, embedding array<float>, label int")
    x = np.array([floors(r["embedding"]) for r in rows.collect()], np.float64)
    r = whitening.tsqr(rows.select("embedding").repartition(90), x.mean(0))
    assert r.shape == (5, 5) and np.allclose(r.T @ r, (x - x.mean(0)).T @ (x - x.mean(0)))


def test_whitening_of_flat_few_huge_and_no_vectors(spark):
    flat = [(k, [float(k), 2.0 * k, 1.0], 1) for k in range(9)]
    found, w = whitening.whiten(table_of(spark, flat))
    rows = found.collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in rows) and len(rows) == 9 and w.explained == pytest.approx([1, 0, 0]) and w.identity_error < 1e-9
    found, w = whitening.whiten(table_of(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]))
    assert w.n == 1 and w.explained == [None, None] and w.identity_error is None and [(r["id"], r["deviation"], r["whitened"]) for r in sorted(found.collect())] == [(1, 0, [None, None]), (2, 0, [None, None])]
    huge = [(k, [1e18 * k, -3.0 * k * k, 1e9 + k], 1) for k in range(6)]
    found, w = whitening.whiten(table_of(spark, huge, "double"))
    want, _, n = brute_white(huge, 3, 3)
    assert sorted((r["id"], None if r["deviation"] is None else int(r["deviation"])) for r in found.collect()) == sorted((i, v if v < 10**38 else None) for i, v, _ in want)
    for none in ([], [(1, None, 1), (2, [float("nan")], 2)]):
        found, w = whitening.whiten(table_of(spark, none))
        assert w is None and found.columns == ["id", "deviation", "whitened"] and not found.collect()


def test_deviations_are_exact():
    r = np.random.default_rng(4)
    x = r.integers(-(2**23), 2**23, (50, 64))
    for n in (3, 10**6, 2**31, 10**12):
        sums = [int(v) for v in r.integers(-(10**9), 10**9, 64)]
        assert whitening.deviations(x, n, sums) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
