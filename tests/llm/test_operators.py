"""Each operator against a brute-force version, and on odd inputs: nulls, empty
and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text_of(n, seed, words=WORDS):
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))


def documents(spark, rows, extra=True):
    """Rows (doc_id, text), with columns whose names the operators use themselves."""
    schema = "doc_id long, text string" + (", lang string, source string, n_chars long, key long, n long, row long, later_id long, fp long, bad_id long, p double, grade int" if extra else "")
    return spark.createDataFrame([(i, t, *(["x", "s", len(t or ""), 1, 2, 3, 4, 5, 6, 7.0, 8] if extra else [])) for i, t in rows], schema)


def odd_rows():
    base = text_of(120, 1)
    near = base.split()
    near[60] = "changed"
    return [
        (1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "two words"),
        (None, text_of(30, 2)), (None, None), (9, "Ünïcödé ñandú 日本 " * 5), (10, text_of(9000, 3)), (11, "a\x00b c\x00d"), (12, base.upper()), (13, "three small words"), (14, "THREE small words"),
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- op 1


def html_rows():
    return [(1, "u1", "a" * 30_000), (2, "u2", "a" * 30_000), (3, "u3", None), (4, "u4", ""), (5, "u5\r\nX: y", "é" * 9000), (6, None, "0\r\n\r\nWARC/1.1\r\n\r\n"), (7, "u", "x"), (7, "u", "x"), (None, "n", "null id"), (8, "v", "long" * 100_000)]


def test_warc_round_trip(spark):
    from spanlake.llm import warc
    from spanlake.llm.common import scratch

    rows = html_rows()
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    for segment in (64, 8192):
        path = scratch(spark, "test-warc")
        warc.write(warc.with_revisits(pages, "page_id", "url", "html"), path, segment_bytes=segment if segment > 64 else 997, chunk_bytes=777, file_bytes=40_000)
        files = spark.read.format("binaryFile").load(path).select("content").collect()
        for f in files:
            held = [(x.get("warc-segment-origin-id", x["warc-record-id"]), len(b)) for x, b, _ in warc.parsed(bytes(f["content"]))]
            assert sum(n for _, n in held) <= 40_000 or len({o for o, _ in held}) == 1
        assert len(files) > 3
        got = warc.read(spark, path).withColumn("id", warc.id_of(F.col("record_id"), "long")).collect()
        assert len(got) == len(rows) and all(r["intact"] for r in got)
        last = {}
        for i, _, h in rows:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
        expect = Counter()
        for i, _, h in rows:
            digest = base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
            expect[i, digest, "response" if last[h or ""] in (i, -1) else "revisit"] += 1
        seen = Counter()
        for r in got:
            i = r["id"]
            if r["type"] == "response":
                assert base64.b32encode(hashlib.sha1(bytes(r["payload"])).digest()).decode() == r["digest"]
                assert len(r["payload"]) == r["payload_length"]
            seen[i, r["digest"], r["type"]] += 1
        assert seen == expect


def test_warc_ids_of_strings(spark, tmp_path):
    from spanlake.llm.queries import op1_warc

    rows = [("a:b", "same"), ("a:c", "same"), ("none", "x"), (None, "y"), ("", "z"), ("id=1 %41+é", "long" * 9000), (None, "same")]
    spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id string, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in op1_warc(spark, str(tmp_path)).collect())
    assert got == Counter((i, len(t.encode()), "revisit" if t == "same" and i != "a:c" else "response", "a:c" if t == "same" and i != "a:c" else None) for i, t in rows)


def test_warc_reports_broken_records(spark):
    from spanlake.llm import warc
    from spanlake.llm.common import scratch

    parts = list(warc.records("urn:x", "u", b"p" * 100, "D", None, "2020-01-01T00:00:00Z", 40, 30))
    assert len(parts) > 3
    for name, kept in (("missing", parts[:2] + parts[3:]), ("cut", parts[:-1]), ("whole", parts[::-1])):
        path = scratch(spark, name)
        df = spark.createDataFrame([(bytearray(p),) for p in kept], "record binary").coalesce(1)
        df.select(F.col("record").cast("string")).write.option("lineSep", "\r\n\r\n").text(path)
        (row,) = warc.read(spark, path).collect()
        assert row["intact"] == (name == "whole") and (row["payload"] is None) == (name != "whole")
    ((fields, block, wrong),) = warc.parsed(parts[0][:-5])
    assert fields["warc-type"] == "response" and block == parts[0][-40:-5] and wrong == "archive ends within a block"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdeXX0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.inflated(zlib.compress(b"x" * 100, wbits=31)[:-12]))


def malformed():
    """(record, its id, reason's beginning or None, payload)."""
    http = lambda fields, body: b"HTTP/1.1 200 OK\r\n" + fields + b"\r\n\r\n" + body
    rec = lambda i, block, *more, drop=(), length=None: (
        "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", len(block) if length is None else length), *more] if k not in drop) + "\r\n"
    ).encode() + block
    chunked = b"Transfer-Encoding: chunked"
    return [
        (rec("ok1", http(chunked, b"5\r\nhello\r\n0\r\n\r\n")), "ok1", None, b"hello"), (rec("plain", http(chunked, b"<html>not framed</html>")), "plain", "framing", b"<html>not framed</html>"),
        (rec("short", http(chunked, b"5\r\nhel")), "short", "framing", b"5\r\nhel"), (rec("noend", http(chunked, b"5\r\nhello\r\n")), "noend", "framing", b"5\r\nhello\r\n"), (rec("negative", http(chunked, b"-5\r\nhello\r\n")), "negative", "framing", b"-5\r\nhello\r\n"),
        (rec("length", http(b"Content-Length: many", b"x")), "length", "length of payload", b"x"), (rec("ok2", http(b"Content-Type: a", b"WARC/1.1\r\n\r\n")), "ok2", None, b"WARC/1.1\r\n\r\n"), (b"garbage between\r\nrecords", None, "no record begins here", None), (rec("untyped", http(b"a: b", b"y"), drop=("WARC-Type",)), "untyped", "without warc-type", b"y"),
        (rec("", http(b"a: b", b"z"), drop=("WARC-Record-ID",)), None, "without warc-record-id", b"z"), (rec("unsized", http(b"a: b", b"w"), drop=("Content-Length",)), "unsized", "without content-length", None), (rec("odd", http(b"a: b", b"v"), length="1e3"), "odd", "length of block", None),
        (rec("less", http(b"a: b", b"0123456789"), length=24), "less", "length of block", None), (rec("segment", http(b"a: b", b"u"), ("WARC-Segment-Number", "x")), "segment", "segment's fields", b"u"),
        (rec("total", http(b"a: b", b"t"), ("WARC-Segment-Number", "1"), ("WARC-Segment-Total-Length", "?")), "total", "segment's fields", b"t"), (rec("info", b"software: x", ("WARC-Type", "warcinfo"), drop=()), "info", "skip", None), (rec("ok3", http(b"a: b", b"last")), "ok3", None, b"last"),
    ]


@pytest.mark.parametrize("form", ["plain", "gzip", "members", "cut gzip"])
def test_warc_reads_on_after_malformed_records(spark, tmp_path, form):
    import gzip

    from spanlake.llm import warc

    rows = malformed()
    data = b"".join(r[0] + b"\r\n\r\n" for r in rows)
    packed = {"plain": data, "gzip": gzip.compress(data), "members": b"".join(gzip.compress(r[0] + b"\r\n\r\n") for r in rows), "cut gzip": gzip.compress(data) + gzip.compress(bytes(range(256)) * 4000)[:-900]}[form]
    (tmp_path / "a.warc").write_bytes(packed)
    (tmp_path / "b.warc").write_bytes(rows[0][0] + b"\r\n\r\n" + rows[-1][0][:-2])
    got = warc.read(spark, str(tmp_path)).collect()
    for record, name, reason, body in rows:
        if reason == "skip":
            continue
        mine = [r for r in got if r["record_id"] == name and (reason is None) == r["intact"] and (r["reason"] or "").startswith(reason or "")]
        assert len(mine) >= 1 and (body is None or any(bytes(r["payload"]) == body for r in mine)), (name, [tuple(r) for r in got if r["record_id"] == name])
    assert sum(r["intact"] for r in got) == 4 and all(r["intact"] == (r["reason"] is None) for r in got)
    assert any(r["reason"] == "archive ends within a block" for r in got)
    assert form != "cut gzip" or any((r["reason"] or "").startswith("archive:") or r["reason"] == "no record begins here" for r in got)


def test_warc_empty(spark):
    from spanlake.llm import warc
    from spanlake.llm.common import scratch

    path = scratch(spark, "none")
    warc.write(warc.with_revisits(spark.createDataFrame([], "page_id long, url string, html string"), "page_id", "url", "html"), path)
    assert warc.read(spark, path).count() == 0


# ---- op 2


def brute_windows(docs, items, window=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    known = []
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        known += [(item, tuple(w[i : i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for d, t in docs:
        w = split(t)
        hit, ids = set(), set()
        for item, win in known:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((d, len(w), len(hit), len(ids), ids, bool(hit)))
    return sorted(out, key=repr)


def test_decontamination_equals_brute_force(spark):
    from spanlake.llm.decontamination import clean, decontaminate

    docs = odd_rows() + [(20, "xx " + " ".join(text_of(120, 1).split()[5:25]) + " yy"), (21, "the the the the " * 10), (22, "THREE, small; words!")]
    items = [(100, text_of(120, 1)), (100, text_of(120, 1)), (9, " ".join(text_of(120, 1).split()[5:15])), (30, "three small words"), (31, None), (32, "..."), (33, "the"), (34, "the the the the the the the the the the the the"), (None, "two words"), (35, "Ünïcödé ñandú")]
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, doc_id long")
    found = decontaminate(documents(spark, docs), bench)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found.collect()), key=repr)
    assert got == brute_windows(docs, items)
    kept = clean(documents(spark, docs), bench)
    assert kept.columns == documents(spark, docs).columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in brute_windows(docs, items) if not r[5])


def test_decontamination_without_rows(spark):
    from spanlake.llm.decontamination import decontaminate

    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(documents(spark, []), none).count() == 0
    assert [r["contaminated"] for r in decontaminate(documents(spark, [(1, "some words")]), none).collect()] == [False]


def test_winnowing_keeps_the_least_of_each_window():
    from spanlake.llm.decontamination import GRAM, WINDOW, winnowed
    from spanlake.llm.textvec import ALNUM, Words, grams

    for seed in range(30):
        shared = text_of(WINDOW, seed)
        texts = [text_of(20, seed + 100) + " " + shared + " tail a", "head " + shared, text_of(WINDOW - 1, seed), ""]
        data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        w = Words(np.concatenate(data), np.concatenate(([0], np.cumsum([len(d) for d in data]))), ALNUM)
        place, fp = winnowed(w)
        g, span = grams(w.hash, GRAM), WINDOW - GRAM + 1
        want = {max(range(i, i + span), key=lambda j: (-int(g[j]), j)) for d in range(4) for i in range(w.first[d], w.first[d + 1] - WINDOW + 1)}
        assert place.tolist() == sorted(want)
        at = [w.first[0] + 20, w.first[1] + 1]
        both = [{int(f) for p, f in zip(place, fp) if a <= p <= a + WINDOW - GRAM} for a in at]
        assert both[0] & both[1]


def test_decontamination_rests_on_the_join_of_fingerprints(spark, monkeypatch):
    """With other fingerprints on the items' side nothing is found."""
    from spanlake.llm import decontamination

    docs, bench = documents(spark, [(1, text_of(60, 1))]), spark.createDataFrame([(1, text_of(60, 1))], "item_id long, text string")
    assert decontamination.decontaminate(docs, bench).first()["n_hit"] == 60
    known = decontamination.item_fingerprints(bench)
    monkeypatch.setattr(decontamination, "item_fingerprints", lambda *a: known.withColumn("fp", F.col("fp") + 1))
    assert decontamination.decontaminate(docs, bench).first()["n_hit"] == 0


def test_decontamination_equals_brute_force_on_overlaps(spark):
    """Few words, so that windows repeat within texts and items and overlap in many ways."""
    from spanlake.llm.decontamination import decontaminate

    few = ["a", "b", "c"]
    docs = [(i, " ".join(random.Random(i).choice(few) for _ in range(random.Random(i).randrange(60)))) for i in range(60)]
    items = [(i, " ".join(random.Random(1000 + i).choice(few) for _ in range(random.Random(i).randrange(5, 40)))) for i in range(20)]
    docs += [(100 + i, text_of(30, i) + " " + " ".join(items[i][1].split()[:12]) + " " + text_of(5, i)) for i in range(10)]
    found = decontaminate(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in found.collect()), key=repr)
    assert got == brute_windows(docs, items) and 20 < sum(r[2] > 0 for r in got)


# ---- op 3


def graded_corpus(n=600):
    r, docs, labels = random.Random(4), [], []
    for i in range(n):
        kind = i % 6
        words = text_of(r.randrange(8, 200), i).split()
        if kind == 0:
            words = [w.upper() + "!!" for w in words[:10]] * 4
            labels.append((i, 0, 0))
        elif kind == 1:
            for _ in range(3):
                words[r.randrange(len(words))] = r.choice(["vilestuff", "vilenames", "nastyx"])
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        docs.append((i, " ".join(words)))
    return docs, labels


def test_quality_on_held_out_rows(spark):
    from spanlake.llm import quality

    docs, labels = graded_corpus()
    frame = documents(spark, docs, extra=False)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(frame, quality.graded(lab.where("doc_id < 400")))
    got = {r["doc_id"]: r for r in quality.score(frame, model).collect()}
    right = [(got[i]["p_clean"] >= model.keep) == (q == 1 and t == 0) for i, q, t in labels if i >= 400]
    assert np.mean(right) > 0.97
    assert all(0 <= r["p_clean"] <= r["expected_grade"] <= 2 for r in got.values())
    grade = lambda k: np.mean([got[i]["expected_grade"] for i, q, t in labels if (0 if not q else 1 if t else 2) == k])
    assert grade(0) < grade(1) < grade(2)
    kept = quality.clean(documents(spark, docs), lab)
    assert kept.columns == documents(spark, docs).columns


def test_quality_on_odd_rows(spark):
    from spanlake.llm import quality

    docs = documents(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.clean(docs, none).count() == len(odd_rows())
    odd = spark.createDataFrame([(1, 1, None), (1, 0, 0), (None, 0, 0), (2, None, 1), (7, 1, 0), (4, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in quality.graded(odd).collect()) == [(1, 0), (4, 2), (7, 2), (99, 0)]
    model = quality.train(docs, quality.graded(odd))
    scored = quality.score(docs, model).collect()
    assert len(scored) == len(odd_rows()) and all(r["p_clean"] is not None for r in scored)
    assert quality.score(documents(spark, []), model).count() == 0


def brute_score(text, weights, bits):
    """The sum of a text's features times their weights, word by word."""
    from spanlake.llm import quality
    from spanlake.llm.textvec import U, mix, span_hash

    def place(piece, salt):
        h = span_hash(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))
        return int(mix(h + U(salt))[0]) >> (64 - bits)

    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[0-9a-z\x80-\xff]+", data)
    counts = Counter(place(w, 11) for w in words)
    total = sum((1 + np.log(n)) * weights[p] for p, n in counts.items())
    for n in quality.STEMS:
        total += sum((1 + np.log(c)) * weights[p] for p, c in Counter(place(w[:n], 20 + n) for w in words if len(w) > n).items())
    raw = (text or "").encode()
    forms = [bytes(quality.SHAPE[list(t)]) for t in re.split(rb"[ \t\n\x0b\x0c\r\0]+", raw) if t]
    forms = Counter(place(re.sub(rb"(.)\1+", rb"\1", f, flags=re.S), 12) for f in forms)
    total += sum(4 * np.sqrt(n / sum(forms.values())) * weights[p] for p, n in forms.items())
    if words and len(counts) / len(words) < quality.REPEATED:
        total += weights[int(mix(np.array([int(16 * len(counts) / len(words)) + (13 << 32)], U))[0]) >> (64 - bits)]
    return total


def test_quality_scores_equal_brute_force(spark):
    from spanlake.llm import quality

    bits = 10
    weights = -np.random.default_rng(2).random(1 << bits).astype(np.float32) / 50
    model = quality.Model(weights, np.array([-3.0, -1.5]))
    rows = [(i, t) for i, t in odd_rows() if t is None or len(t) < 20_000] + [(100, "the " * 60 + "End."), (101, "A1 b2!! CCC-ddd\n\n3,14 ÄÖ"), (102, "x")]
    got = sorted(((r["doc_id"], r["expected_grade"], r["p_clean"]) for r in quality.score(documents(spark, rows), model, bits).select("doc_id", "expected_grade", "p_clean").collect()), key=repr)
    want = []
    for i, t in rows:
        tails = [1 / (1 + np.exp(b - brute_score(t, weights, bits))) for b in model.thresholds]
        want.append((i, sum(tails), tails[-1]))
    for (i, e, p), (j, f, q) in zip(got, sorted(want, key=repr)):
        assert i == j and abs(e - f) < 1e-4 and abs(p - q) < 1e-4
    none = quality.score(documents(spark, []), model, bits)
    assert none.count() == 0


def test_quality_fit_is_a_least_of_its_loss():
    """No small step of a single weight or threshold lowers the penalised loss that is fitted."""
    from spanlake.llm import quality

    r = np.random.default_rng(4)
    grade = np.repeat([0, 1, 2], 60)
    places = [np.array(sorted(r.choice([1, 2, 3, 4, 5], p=[[0.6, 0.1, 0.1, 0.1, 0.1], [0.1, 0.6, 0.1, 0.1, 0.1], [0.05, 0.05, 0.3, 0.3, 0.3]][g], size=2, replace=False))) for g in grade]
    values = [np.ones(len(p), np.float32) for p in places]
    m = quality.fit(places, values, grade, bits=8, steps=3000, l1=1e-4)

    def loss(weights, thresholds):
        score = np.array([weights[p].sum() for p in places])
        tail = 1 / (1 + np.exp(thresholds[None, :] - score[:, None]))
        p = np.column_stack([1 - tail[:, 0], tail[:, 0] - tail[:, 1], tail[:, 1]])[np.arange(len(grade)), grade]
        return -np.mean(np.log(np.maximum(p, 1e-12))) + 1e-4 * np.abs(weights).sum()

    best = loss(m.weights.astype(float), m.thresholds)
    assert (m.weights <= 0).all() and m.thresholds[0] < m.thresholds[1] and (m.weights[[1, 2]] < -0.1).all()
    for at in np.flatnonzero(m.weights):
        for step in (-0.05, 0.05):
            w = m.weights.astype(float)
            w[at] = min(w[at] + step, 0)
            assert loss(w, m.thresholds) > best - 2e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            t = m.thresholds.copy()
            t[k] += step
            assert loss(m.weights.astype(float), t) > best - 2e-4


# ---- op 4


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from spanlake.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    exact = Tokenizer.from_file(path)
    rows = odd_rows() + [(50 + i, text_of(n, i)) for i, n in enumerate([3, 40, 200, 700, 1500, 3000] * 6)] + [(200, "a <|endoftext|> b"), (201, "  two  spaces\n\n\n x y"), (202, "I'll've '''s")]
    got = pack(documents(spark, rows).repartition(3), path).collect()
    whole = defaultdict(list)
    for i, t in rows:
        whole[i].append(exact.encode(t or "", add_special_tokens=False).ids + [1])
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        assert any(zlib.crc32(np.array(w[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for w in whole[r["doc_id"]] if len(w) == r["doc_tokens"])
    for i, ws in whole.items():
        for n, copies in Counter(len(w) for w in ws).items():
            covered = Counter(p for r in pieces[i, n] for p in range(r["start"], r["start"] + r["length"]))
            assert covered == Counter({p: copies for p in range(n)})
    used = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        used.append((at, at if at & (at - 1) == 0 else 2048))
    assert sum(a for a, _ in used) >= 0.99 * sum(b for _, b in used)


def test_encoder_takes_the_exact_way_where_a_file_differs(tmp_path):
    import json

    import public_tokenizers

    from spanlake.llm.packing import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = json.loads(open(path, encoding="utf-8").read())
    assert Encoder.expected(spec) and Encoder(path).trusted and not Encoder(path, exact=True).trusted
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        assert not Encoder.expected(spec | change)
    (tmp_path / "lower.json").write_text(json.dumps(spec | {"normalizer": {"type": "Lowercase"}}))
    texts = [text_of(3000, 5), "Some ÜPPER text", "", "  odd \x00 spaces\n\n "]
    for p in (path, str(tmp_path / "lower.json")):
        e = Encoder(p)
        assert list(e(texts)) == [e.exact.encode(t, add_special_tokens=False).ids for t in texts]
    broken = Encoder(path)
    broken.fast = type("Off", (), {"encode_ordinary": staticmethod(lambda t: [0])})
    with pytest.raises(ValueError, match="exact=True"):
        list(broken(texts))


def test_packing_cuts():
    from spanlake.llm.packing import Bins, cuts

    for n in [1, 2, 44, 45, 46, 1023, 1024, 1025, 2047, 2048, 2049, 9999]:
        parts = cuts(n)
        assert sum(parts) == n and all(1 <= p <= 2048 for p in parts)
        assert all(p * (2048 // p) > 2048 - 45 for p in parts)
    bins = Bins(3)
    bins.close()
    assert bins.rows == []


def test_packing_empty(spark):
    import public_tokenizers

    from spanlake.llm.packing import pack

    assert pack(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ---- op 5


def test_passages_are_found(spark):
    from spanlake.llm.passages import shared_passages

    own = lambda seed, n: " ".join(f"w{random.Random(seed * 1000 + i).randrange(10**6)}" for i in range(n))
    passage = own(1, 60).split()
    fuzzy = list(passage)
    fuzzy[20], fuzzy[40] = "changed", "again"
    rows = [(i, own(i + 10, 80) + " " + " ".join(passage) + " " + own(i + 50, 30)) for i in range(1, 9)]
    rows += [(20, own(70, 40) + " " + " ".join(fuzzy)), (21, own(71, 200)), (22, own(72, 40) + " " + " ".join(passage[:30])), (23, None), (24, ""), (25, "the " * 500), (None, " ".join(passage)), (26, own(73, 30)), (27, own(73, 30))]
    rows += [(30, own(80, 300)), (31, own(80, 300)), (31, own(80, 300))]
    got = shared_passages(documents(spark, rows)).collect()
    assert all(min(r["end"] - r["start"], r["other_end"] - r["other_start"]) >= 45 for r in got)
    near = lambda a, b: b in reach[a]
    reach = {}
    for r in got:
        a, b = r["doc_id"], r["other_id"]
        both = reach.get(a, {a}) | reach.get(b, {b})
        for x in both:
            reach[x] = both
    assert all(near(1, i) for i in [*range(2, 9), 20, None])
    assert near(30, 31) and not any(x in reach for x in (21, 22, 23, 24, 25, 26, 27))
    texts = dict(r for r in rows)
    for r in got:
        a, b = texts[r["doc_id"]].split()[r["start"] : r["end"]], texts[r["other_id"]].split()[r["other_start"] : r["other_end"]]
        assert a[0] == b[0] and a[-1] == b[-1] and r["equal_words"] <= min(len(a), len(b))
    assert shared_passages(documents(spark, [])).count() == 0


def test_passages_link_every_shared_window(spark):
    """Brute force: of each window of 50 words that several texts hold, 45 words are in passages
    that link all of them, if by way of other texts; texts in passages share 45 words."""
    from spanlake.llm.passages import shared_passages

    r = random.Random(21)
    own = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    blocks = [own(r.randrange(50, 120)) for _ in range(12)]
    rows = []
    for i in range(120):
        words = own(r.randrange(5, 40))
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            block = r.choice(blocks)
            at = r.randrange(0, len(block) - 49)
            part = block[at : r.randrange(at + 50, len(block) + 1)]
            words += part * r.choice([1, 1, 1, 3]) + own(r.randrange(0, 30))
        rows.append((i, words))
    rows += [(200, ["und"] * 70), (201, ["und"] * 90 + own(5)), (202, own(3) + ["und"] * 49), (203, rows[5][1]), (204, own(400))]
    rows += [(300 + i, own(10) + b[k : k + 20] + own(10)) for i, b in enumerate(blocks) for k in (0, 15)]
    got = shared_passages(documents(spark, [(i, " ".join(w)) for i, w in rows], extra=False)).collect()

    def holders(n):
        out = defaultdict(dict)
        for i, w in rows:
            for p in range(len(w) - n + 1):
                out[tuple(w[p : p + n])].setdefault(i, []).append(p)
        return [at for at in out.values() if len(at) > 1]

    assert {x for g in got for x in (g["doc_id"], g["other_id"])} <= {i for at in holders(45) for i in at}
    shared = holders(50)
    assert len(shared) > 200
    for at in shared:
        root = {i: i for i, _ in rows}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        over = lambda i, start, end, at=at: any(min(end, p + 50) - max(start, p) >= 45 for p in at.get(i, []))
        for g in got:
            if over(g["doc_id"], g["start"], g["end"]) or over(g["other_id"], g["other_start"], g["other_end"]):
                root[find(g["doc_id"])] = find(g["other_id"])
        assert len({find(i) for i in at}) == 1, at


def test_passages_whose_seeds_are_all_elsewhere(spark):
    from spanlake.llm.passages import shared_passages

    r = random.Random(12)
    own = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    exact, fuzzy = own(50), own(70)
    other = fuzzy[:35] + ["changed"] + fuzzy[36:]
    rows = [(1, own(30) + exact + own(30)), (2, own(50) + exact + own(10)), (3, own(30) + fuzzy), (4, own(20) + other + own(5))]
    # Each 5-gram is in 20 texts more, and in a text of the pair before the passage as well.
    for words in (exact, fuzzy, other):
        rows += [(100 + len(rows), own(9) + words[i : i + 5] + own(9)) for i in range(len(words) - 4) for _ in range(20)]
    rows[1] = (2, [w for i in range(0, 46, 2) for w in exact[i : i + 5] + own(3)] + rows[1][1])
    rows = [(i, " ".join(w)) for i, w in rows]
    got = shared_passages(documents(spark, rows, extra=False)).collect()
    assert {frozenset((x["doc_id"], x["other_id"])) for x in got} == {frozenset((1, 2)), frozenset((3, 4))}
    texts = dict(rows)
    assert any(" ".join(texts[x["doc_id"]].split()[x["start"] : x["end"]]) == " ".join(exact) for x in got)


def test_fuzzy_passages_whose_seeds_are_elsewhere(spark):
    """Blocks in two texts, changed independently, while all their 10-word pieces stand in other texts as well."""
    from spanlake.llm.passages import shared_passages

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8))) for _ in range(20_000)]
    fill = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs, pairs, pieces = [], {}, []
    for rate in (0.02, 0.05):
        for _ in range(25):
            block = fill(120)
            for _ in range(2):
                docs.append((len(docs), " ".join(fill(60) + [w if r.random() >= rate else r.choice(vocabulary) for w in block] + fill(60))))
            pairs[len(docs) - 2, len(docs) - 1] = rate
            pieces += [block[s : s + 10] for s in range(0, 111, 3)]
    for _ in range(2):
        r.shuffle(pieces)
        for k in range(0, len(pieces), 5):
            docs.append((len(docs), " ".join(w for p in pieces[k : k + 5] for w in [*fill(10), *p])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {tuple(sorted((x["doc_id"], x["other_id"]))) for x in shared_passages(df).collect()}
    found = Counter(rate for pair, rate in pairs.items() if pair in got)
    assert found[0.02] >= 24 and found[0.05] >= 23


def test_passages_go_on_past_the_slices_first_asked_for(spark):
    from spanlake.llm.passages import shared_passages

    r = random.Random(13)
    own = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    head, tail = own(60), own(900)
    changed = [w if i % 9 else f"x{i}" for i, w in enumerate(tail)]
    rows = [(1, own(200) + head + tail + own(200)), (2, own(300) + head + changed + own(200)), (3, own(200) + tail[::-1] + head[::-1] + own(30)), (4, own(100) + changed[::-1] + head[::-1] + own(200))]
    # Beyond the head no run is long enough for a context, and all seeds stand in other texts.
    for words in (tail, tail[::-1]):
        rows += [(100 + len(rows), own(9) + words[i : i + 5] + own(9)) for i in range(len(words) - 4) for _ in range(3)]
    got = shared_passages(documents(spark, [(i, " ".join(w)) for i, w in rows], extra=False)).collect()
    for pair in ({1, 2}, {3, 4}):
        assert max(x["end"] - x["start"] for x in got if {x["doc_id"], x["other_id"]} == pair) >= 950


def test_passages_keep_on_disk_what_is_still_read(spark, monkeypatch):
    """Tables go when nothing reads them any more, texts' words are written twice at most however often slices
    are cut, and a text that many ask for is dealt in shares with the same result."""
    from spanlake.llm import passages
    from spanlake.plans import scratch

    r = random.Random(31)
    own = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    block, tail = own(70), own(6000)
    rows = [(i, own(20) + block + own(20)) for i in range(40)]
    rows += [(50, own(50) + block + tail), (51, own(30) + block + [w if i % 9 else f"x{i}" for i, w in enumerate(tail)])]
    # Beyond the block all seeds stand in other texts.
    rows += [(100 + i, own(9) + tail[i : i + 5] + own(9)) for i in range(len(tail) - 4)]
    df = documents(spark, [(i, " ".join(w)) for i, w in rows], extra=False)
    begun, alive, write = scratch.mark(), [], passages.stored

    def stored(df, name):
        alive.append((name, {x.rsplit("/", 1)[1].rsplit("-", 1)[0] for x in scratch._made[begun:]}))
        return write(df, name)

    monkeypatch.setattr(passages, "stored", stored)
    key = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "equal_words"]
    got = sorted(tuple(x[k] for k in key) for x in passages.shared_passages(df).collect())
    names = [name for name, _ in alive]
    assert names.count("passages") > 2 and names.count("words") == 2
    first = lambda name: alive[names.index(name)][1]
    assert first("sown") == set() and first("firsts") == {"sown"} and first("chains") == {"met"}
    assert first("words") == {"met", "chains"} and first("rest") == {"met", "chains", "passages"}
    assert all("met" not in x and "rest" not in x for name, x in alive[names.index("further") + 1 :])
    assert max(e - b for d, b, e, o, *_ in got if {d, o} == {50, 51}) > 5000 and {d for d, *_ in got} | {x[3] for x in got} == {x for x, _ in rows[:42]}
    monkeypatch.setattr(passages, "SHARE", 4)
    assert sorted(tuple(x[k] for k in key) for x in passages.shared_passages(df).collect()) == got


def test_chains_equal_quadratic_search():
    from spanlake.llm.passages import GAP, SEED, chains

    r = random.Random(6)
    for _ in range(60):
        points = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 25))})
        value = []
        for b, a in points:
            best = SEED
            for (pb, pa_), v in zip(points, value):
                if pb < b and pa_ < a:
                    best = max(best, SEED + v - GAP * (a + b - pa_ - pb))
            value.append(best)
        got = chains(points, least=1)
        assert sorted(p for c in got for p in c) == points
        assert all(x[0] < y[0] and x[1] < y[1] for c in got for x, y in zip(c, c[1:]))
        worth = lambda c: SEED * len(c) - GAP * (sum(c[-1]) - sum(c[0]))
        assert abs(worth(got[0]) - max(value)) < 1e-9


# ---- op 6


def brute_lines(docs):
    known, order = set(), sorted((r for r in docs), key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, t in order:
        lines = [] if t is None else t.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            win = tuple(lines[p : p + 3])
            if any(x.strip() for x in win):
                if win in known:
                    gone.update((p, p + 1, p + 2))
                known.add(win)
        out.append((i, None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    from spanlake.llm.line_dedup import dedup_lines

    r = random.Random(8)
    rows = [(i, "\n".join(r.choice("abcdef") for _ in range(r.randrange(0, 14)))) for i in range(60)] + [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "x\r\ny\nz"), (105, "x\r\ny\nz"), (106, "one\ntwo"), (107, "one\ntwo"), (None, "p\nq\nr"), (108, "p\nq\nr"), (109, "q\n" * 5000)]
    got = dedup_lines(documents(spark, rows))
    assert got.columns == [*[c for c in documents(spark, rows).columns if c != "text"], "text", "n_lines", "n_removed"]
    assert sorted(((x["doc_id"], x["text"], x["n_lines"], x["n_removed"]) for x in got.collect()), key=repr) == brute_lines(rows)
    assert dedup_lines(documents(spark, [])).count() == 0
    twice = [(x["doc_id"], x["n_removed"]) for x in dedup_lines(documents(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc")])).collect()]
    assert sorted(twice) == [(1, 0), (1, 0), (2, 3)]


# ---- op 7


def test_blank_lines_of_unlike_white_space_are_unlike(spark):
    from spanlake.llm.line_dedup import dedup_lines

    rows = [(1, "alpha\n\nbeta"), (2, "alpha\n \nbeta"), (3, "alpha\n\u00a0\nbeta"), (4, "\n\n\n"), (5, "\n\n\n"), (6, "\u3000\n\n"), (7, "\u3000\n\n"), (8, "alpha\n\nbeta")]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(documents(spark, rows)).collect()}
    assert got == dict(rows) | {7: "", 8: ""}


def brute_pii(t):
    spans = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    spans += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 14 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            spans.append((*m.span(), "card"))
    spans += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[2])))


def pii_rows():
    r, alphabet = random.Random(9), "ab@@..  --++((0123456789%_éÜ"
    rows = [(i, "".join(r.choice(alphabet) for _ in range(r.randrange(1, 160)))) for i in range(400)]
    rows += [(1000, "x" * 70 + " jo.doe@ex-am.ple.org, 10.0.0.255 256.1.1.1 4111 1111 1111 1111 +49 (30) 123-456 78"), (1001, "a@b.c@d.e.f"), (1002, "+1 555 123 4567" + " é" * 40 + "+1-555-123-4567"), (1003, "4111-1111-1111-1112"), (1004, None), (1005, ""), (1006, "no marks"), (None, "a@b.cc"), (1007, "1" * 5000), (1008, "9.9.9.9." * 300)]
    return rows


def test_pii_base_spans_equal_brute_force(spark):
    from spanlake.llm.pii import base_spans, find, written

    for _, t in pii_rows():
        assert base_spans(t or "") == brute_pii(t or "")
    got = {r["doc_id"]: r for r in find(documents(spark, pii_rows())).collect()}
    assert len(got) == len(pii_rows())
    for i, t in pii_rows():
        r, base = got[i], brute_pii(t or "")
        assert r["base"] == written(base) and [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[2] == k for s in base) for k in ("email", "ip", "card", "phone")]
        assert set(r["base"].split(",")) <= set(r["spans"].split(",")) or not r["base"]
    assert find(documents(spark, [])).count() == 0


def test_addresses_with_odd_digits():
    from spanlake.llm.pii import base_spans, sound

    long = "0" * 5000 + ".1.1.1"
    assert base_spans("x " + long) == [(2, 2 + len(long), "ip")]
    assert base_spans("1" * 200_000 + " " + "1." * 100_000)
    assert not sound("ip", "1.2.3.\u00b2") and not sound("ip", "1.2.3.256") and sound("ip", "10[.]0[.]0[.]1")


def test_tagger_on_held_out_spans():
    """Of the spans that the patterns miss, and of those that the tagger adds."""
    from spanlake.llm.pii import added_spans, base_spans, decoded, labelled, trained

    held = labelled(300, seed=77)
    right = due = made = 0
    for (t, spans), tags in zip(held, decoded(trained(), [t for t, _ in held])):
        base = base_spans(t)
        missed = {s for s in spans if all(s[1] <= a or b <= s[0] for a, b, _ in base)}
        got = set(added_spans(t, tags, base))
        right, due, made = right + len(got & missed), due + len(missed), made + len(got)
    assert due > 200 and right / due > 0.9 and right / made > 0.9


def test_skipped_windows_change_no_character_of_a_window_with_a_mark():
    from spanlake.llm.pii import _MARK, STRIDE, WINDOW, decoded, labelled, trained

    texts = [" ".join(t for t, _ in labelled(4, seed=i)) + " thel ero an" * (i % 40) for i in range(30)] + ["no mark " * 40, "", "x"]
    for t, some, every in zip(texts, decoded(trained(), texts), decoded(trained(), texts, every=True)):
        near = np.zeros(len(t), bool)
        for start in range(0, max(len(t) - STRIDE, 1), STRIDE):
            if any(start <= m.start() < start + WINDOW for m in _MARK.finditer(t)):
                near[start : start + WINDOW] = True
        assert (some[near] == every[near]).all()


def test_viterbi_equals_enumeration():
    from itertools import product

    from spanlake.llm import pii

    m = pii.trained()
    e = pii.emissions(m, pii.training_windows(pii.labelled(3, seed=9))[0])[20:25]
    for row, best in enumerate(pii.viterbi(m, e)):
        worth = {path: m.first[path[0]] + sum(e[i, row, k] for i, k in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:])) for path in product(range(e.shape[2]), repeat=5)}
        assert worth[tuple(best.tolist())] >= max(worth.values()) - 1e-4


def test_pii_notations_among_documents(spark, data):
    """Notations that the patterns miss, with names that the training lacks, set into given documents; clean ones stay clean."""
    from spanlake.llm.pii import added_spans, base_spans, decoded, luhn, trained

    r, m = random.Random(7), trained()
    texts = [x["text"] for x in spark.read.parquet(f"{data}/documents.parquet").where("length(text) BETWEEN 20 AND 6000").collect()]
    drawn = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    digits = lambda n: drawn("0123456789", n)
    name = lambda: r.choice(["anna", "jo.miller", "petra_k", "hans", "maria.lopez", "oliver22", "zoe", "ravi.patel"])
    host = lambda: r.choice(["mailbox", "web-host", "firma", "northwind"])
    end = lambda: r.choice(["de", "com", "org", "net"])

    def card():
        d = next(d for d in iter(lambda: "4" + digits(15), None) if luhn(d))
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))

    notations = [
        (0.9, lambda: f"{name()} (at) {host()} (dot) {end()}"), (0.85, lambda: f"{name()} at {host()} dot {end()}"), (0.9, lambda: f"{name()} [at] {host()} [dot] {end()}"), (0.9, card), (0.85, lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (0.85, lambda: "[.]".join(str(r.randrange(256)) for _ in range(4))), (0.85, lambda: ":".join(drawn("0123456789abcdef", 4) for _ in range(8))), (0.85, lambda: "AKIA" + drawn("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)),
    ]
    for least, make in notations:
        planted, places = [], []
        for _ in range(40):
            text, piece = r.choice(texts), make()
            at = r.choice([0, *(i + 1 for i, c in enumerate(text) if c == " ")])
            planted.append(f"{text[:at]}{piece} {text[at:]}")
            places.append((at, at + len(piece)))
        found = sum(p in [x[:2] for x in added_spans(t, tags, base_spans(t))] for t, p, tags in zip(planted, places, decoded(m, planted)))
        assert found >= least * 40, (make(), found)
    unplanted = [x for t, tags in zip(texts, decoded(m, texts)) for x in added_spans(t, tags, base_spans(t)) if x[2] != "secret"]
    assert len(unplanted) <= 0.01 * len(texts)


def test_pii_spans_of_tables_equal_those_of_single_texts(spark):
    from spanlake.llm.pii import added_spans, base_spans, decoded, find, in_order, labelled, trained, written

    texts = [t for t, _ in labelled(40, seed=123)] + [None, "", "no marks", 'key = "x" token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', " ".join(t for t, _ in labelled(60, seed=5))]
    got = {r["doc_id"]: r for r in find(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        added = added_spans(t, decoded(trained(), [t])[0], base) if t else []
        own, secrets = [x for x in added if x[2] != "secret"], [x for x in added if x[2] == "secret"]
        assert got[i]["spans"] == written(in_order(base + own)) and got[i]["n_added"] == len(own) and got[i]["n_spans"] == len(base + own)
        assert got[i]["secrets"] == written(in_order(secrets)) and got[i]["n_secrets"] == len(secrets)
    assert got[43]["secrets"].startswith("secret:19:59")


def test_tagger_spans_cross_windows():
    from spanlake.llm.pii import added_spans, decoded, trained

    for shift in range(0, 70, 7):
        t = "on " * 10 + "x" * shift + " (555) 123-4567 the st"
        (tags,) = decoded(trained(), [t])
        assert [t[a:b] for a, b, _ in added_spans(t, tags, [])] in (["(555) 123-4567"], ["555) 123-4567"])


def test_tagger_slopes():
    from spanlake.llm import pii

    chars, tags = pii.training_windows(pii.labelled(8))
    m = pii.fit(chars, tags, epochs=1)
    for p in (m.embed, m.states[0]):
        assert np.isfinite(p).all()
    e = pii.emissions(m, chars).astype(np.float64)
    loss, de, dmoves, dfirst = pii._crf(m, e.copy(), tags.T)
    for at in ((3, 2, 1), (0, 5, 0)):
        up = e.copy()
        up[at] += 1e-4
        assert abs((pii._crf(m, up, tags.T)[0] - loss) / 1e-4 - de[at]) < 1e-3


# ---- op 8


def test_token_counts_equal_greedy_cut(spark):
    import public_tokenizers

    from spanlake.llm.token_count import Automaton, token_counts, vocabulary

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    pieces = set(vocabulary(path))
    longest = max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            word = word[next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces) :]
            n += 1
        return n

    rows = odd_rows() + [(60, "internationalization antidisestablishmentarianism xyzzyqqq 1234567890 !!!???  nbsp")]
    got = token_counts(documents(spark, rows), path).collect()
    expect = []
    for i, t in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        expect.append((i, len((t or "").encode()), len(words), sum(greedy(b" " + w) for w in words)))
    assert rows_of(spark.createDataFrame([tuple(r) for r in got], "a long, b long, c long, d long")) == sorted(expect, key=repr)
    assert token_counts(documents(spark, []), path).count() == 0
    r = random.Random(1)
    small = [bytes([c]) for c in range(256)] + [bytes(r.choice(b"ab") for _ in range(r.randrange(2, 7))) for _ in range(25)]
    machine, known = Automaton(small), set(small)
    for _ in range(500):
        word = left = bytes(r.choice(b"ab") for _ in range(r.randrange(0, 30)))
        n = 0
        while left:
            left = left[next(k for k in range(7, 0, -1) if left[:k] in known) :]
            n += 1
        assert machine.count(word) == n
    with pytest.raises(ValueError):
        Automaton([b"a"])


# ---- op 9


def brute_near(rows, shingle=4):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), c := least.get(find(i), d), d == c) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def even_odd(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_that_polynomials_confuse_are_told_apart(spark):
    """Sums of letters times the powers of any odd base are the same for these words."""
    import public_tokenizers

    from spanlake.llm.hyperminhash import near_duplicates
    from spanlake.llm.token_count import Automaton, token_counts, vocabulary

    for n in (64, 256, 1024, 4096):
        rows = [(1, even_odd(n, "ab") + " w1 w2 w3"), (2, even_odd(n, "ba") + " w1 w2 w3")]
        assert all(r["kept"] for r in near_duplicates(documents(spark, rows)).collect())
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    machine = Automaton(vocabulary(path))
    rows = [(i, even_odd(1024, x)) for i, x in enumerate(("ab", "ba", "th", "ht"))]
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts(documents(spark, rows).coalesce(1), path).collect()} == {i: machine.count(b" " + t.encode()) for i, t in rows}


def test_unlike_spans():
    from spanlake.llm.textvec import unlike

    words = [b"a", b"ab", b"ab", b"x" * 40, b"x" * 40, b"x" * 39 + b"y", b"12345678", b"12345678", b"123456789"]
    data = np.frombuffer(b"".join(words), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = end - [len(w) for w in words]
    for shift in range(len(words)):
        other = np.roll(np.arange(len(words)), shift)
        assert unlike(data, start, end, other).tolist() == [words[i] != words[j] for i, j in enumerate(other)]


def test_pairs_of_a_large_bucket_are_met_in_blocks(spark, monkeypatch):
    """Blocks of three classes give the links that whole buckets give."""
    from spanlake.llm import hyperminhash

    base = text_of(200, 77).split()
    rows = []
    for i in range(40):  # a chain: each is near the next, and not near those further on
        rows.append((i, " ".join(base[3 * i :] + [f"new{j}" for j in range(3 * i)])))
    monkeypatch.setattr(hyperminhash, "BLOCK", 3)
    monkeypatch.setattr(hyperminhash, "PER_TASK", 2)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in hyperminhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == set(brute_near(rows))


def near_rows():
    r, rows = random.Random(11), []
    for g in range(12):
        base = text_of(r.choice([8, 30, 100, 300]), 500 + g).split()
        for c in range(r.randrange(1, 12)):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 25))):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((r.randrange(10**6), " ".join(w)))
    chain = text_of(200, 900).split()
    for i in range(12):  # each like the next, the ends unlike
        chain = chain[4:] + text_of(4, 950 + i).split()
        rows.append((2_000_000 + i, " ".join(chain)))
    return rows + odd_rows()


def test_near_duplicates_equal_brute_force(spark):
    from spanlake.llm.hyperminhash import dedup, near_duplicates

    rows = near_rows()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(documents(spark, rows)).collect()), key=repr)
    assert got == brute_near(rows)
    left = dedup(documents(spark, rows), shingle=5)
    assert left.columns == documents(spark, rows).columns
    assert Counter(r["doc_id"] for r in left.collect()) == Counter(r[0] for r in brute_near(rows, 5) if r[3] or r[0] is None and r[2] is None)
    assert near_duplicates(documents(spark, [])).count() == 0


def test_sketch_estimates():
    from spanlake.llm.hyperminhash import document_sets, estimate, registers

    errors = []
    for seed in range(40):
        a = text_of(400, seed).split()
        b = list(a)
        for i in range(0, 400, random.Random(seed).randrange(20, 80)):
            b[i] = "other"
        texts = [" ".join(a).encode(), " ".join(b).encode()]
        data = np.frombuffer(b"".join(texts), np.uint8)
        values, bounds = document_sets(data, np.array([0, len(texts[0]), len(texts[0]) + len(texts[1])]))
        x, y = set(values[: bounds[1]].tolist()), set(values[bounds[1] :].tolist())
        sketch = registers(values, bounds)
        errors.append(float(estimate(sketch[0], sketch[1])) - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.16


def test_components(spark):
    from spanlake.llm.graph import components

    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 199)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 30)}, 200: 199}


# ---- op 10


def brute_filters(text):
    """The filters of one text, window by window."""
    from spanlake.llm.digest import FILTER_BITS, FUNCTIONS, PER_FILTER, POINTS, TYPICAL, WEAK, WINDOW
    from spanlake.llm.textvec import span_hash

    data = text.encode()
    if not data:
        return []
    if len(data) < WINDOW:
        picked = [(0, len(data))]
    else:
        keys = []
        for i in range(len(data) - WINDOW + 1):
            total = sum(round(c * np.log2(c) * 65536) for c in Counter(data[i : i + WINDOW]).values())
            e = (round(WINDOW * np.log2(WINDOW) * 65536) - total) * 1000 // round(WINDOW * np.log2(WINDOW) * 65536)
            keys.append((1 << 19 if e < WEAK else 1000 - abs(e - TYPICAL), i))
        points = Counter(m[1] for i in range(len(keys) - WINDOW + 1) if (m := min(keys[i : i + WINDOW]))[0] < 1 << 19)
        picked = [(i, i + WINDOW) for i in sorted(points) if points[i] >= POINTS] or [(min(keys)[1], min(keys)[1] + WINDOW)]
    out, seen = [], set()
    for a, b in picked:
        if data[a:b] in seen:
            continue
        if len(seen) % PER_FILTER == 0:
            out.append(np.zeros(FILTER_BITS, bool))
        seen.add(data[a:b])
        h = int(span_hash(np.frombuffer(data, np.uint8), np.array([a]), np.array([b]))[0])
        for i in range(FUNCTIONS):
            out[-1][(h >> 11 * i) % FILTER_BITS] = True
    return out


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    scores = []
    for f in a:
        best = 0.0
        for g in b:
            most, chance = min(f.sum(), g.sum()), f.sum() * g.sum() / len(f)
            best = max(best, min(max((int((f & g).sum()) - chance) / max(most - chance, 1e-9), 0), 1))
        scores.append(best)
    return float(np.mean(scores))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_digests_equal_brute_force(spark, kind):
    """Every row of the result, repeated rows and null ids among them."""
    from spanlake.llm.digest import digests

    rows = odd_rows() + [(1 << 60, "large"), ((1 << 60) + 1, "larger"), (3, "x" * 300)] + [(100 + i, text_of(20 * i, i)) for i in range(16)]
    rows = [(i, t[:4000] if t else t) for i, t in rows]
    if kind == "string":
        rows = [(None if i is None else f"id:{i}é", t) for i, t in rows]
    docs = spark.createDataFrame([(*r, "x") for r in rows], f"doc_id {kind}, text string, hash string").repartition(5)
    hashed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text", "h").collect()
    order = sorted(((r[0] is not None, r[0] or ("" if kind == "string" else 0), r[2], r[1] or "") for r in hashed), reverse=True)
    want = Counter()
    for (known, i, _, t), (_, _, _, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        changed = t[: len(t) - half] + n[:half]
        own, after, following = brute_filters(t), brute_filters(changed), brute_filters(n)
        text = lambda fs: base64.b64encode(b"".join(np.packbits(f).tobytes() for f in fs)).decode()
        want[i if known else None, len(t), hashlib.sha256(changed.encode()).hexdigest(), text(own), text(after), round(brute_likeness(own, after), 9), round(brute_likeness(own, following), 9)] += 1
    got = Counter((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in digests(docs).collect())
    assert got == want


def test_digests_of_few_rows_and_of_odd_ids(spark):
    from spanlake.llm.digest import digests

    (single,) = digests(documents(spark, [(5, "only one text here")])).collect()
    assert single["near_next"] == 1.0
    assert digests(documents(spark, [])).count() == 0
    with pytest.raises(TypeError, match="double"):
        digests(spark.createDataFrame([(1.5, "x")], "doc_id double, text string"))


def test_entropies_equal_direct_ones():
    from spanlake.llm.digest import WINDOW, entropies

    r = np.random.default_rng(3)
    for n in (10, 64, 65, 600, 1500):
        data = r.integers(97, 97 + r.integers(1, 26), n).astype(np.uint8)
        e = entropies(data)
        assert len(e) == max(n - WINDOW + 1, 0)
        for i in range(0, len(e), 37):
            p = np.bincount(data[i : i + WINDOW])
            p = p[p > 0] / WINDOW
            assert abs(e[i] - 1000 * -(p * np.log2(p)).sum() / 6) < 1.5


def test_likeness():
    from spanlake.llm.digest import filters, likeness

    a, b = text_of(400, 1), text_of(400, 2)
    fa, fb, fm, f0 = filters(pa.array([a, b, a[: len(a) // 2] + b[: len(a) // 2], ""]))
    assert likeness(fa, fa) == 1.0 and likeness(f0, f0) == 1.0 and likeness(fa, f0) == 0.0
    assert likeness(fa, fm) > likeness(fa, fb) + 0.2
