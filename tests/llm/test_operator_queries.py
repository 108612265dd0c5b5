"""The operators' queries against SQL, and the pipeline against brute force."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import both, connect
from test_operators import brute_lines, brute_near, brute_windows, graded_corpus, text_of

import corpus_pipeline
from spanlake.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, data, name):
    got, want = both(QUERIES[name](spark, data), ORACLES[name], connect(data))
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    rows = df.collect()
    assert rows and (name == "op5_passages" or {r["doc_id"] for r in rows} == {r["doc_id"] for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()})


def brute_tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: t.encode(x, add_special_tokens=False).ids + [1] for i, x in docs}


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels = graded_corpus(300)
    lines = "\n".join(text_of(9, 7000 + i) for i in range(4))
    bench = [(1, text_of(30, 8001)), (2, "two words")]
    docs = [(i, t + "\n" + "\n".join(text_of(6, 9000 + 10 * i + j) for j in range(3))) for i, t in docs]
    clean = [i for i, (_, q, t) in zip(range(300), labels) if q and not t]
    docs += [(1000 + k, docs[clean[k]][1]) for k in range(5)]  # copies
    docs += [(1100 + k, docs[clean[k + 10]][1].replace(" ", " new ", 1)) for k in range(5)]  # near copies
    docs += [(1200 + k, text_of(60, 8100 + k) + "\n" + lines + "\n" + text_of(20, 8200 + k)) for k in range(4)]  # shared lines
    docs += [(1300, text_of(20, 8300) + " " + " ".join(bench[0][1].split()[3:20]) + " " + text_of(20, 8301)), (1301, "has1 two words in2 it3"), (1302, "one7 line8")]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stages["quality"](spark, now, sf)
    assert kept.columns == now.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    bad = {i for i, q, t in labels if not q or t}
    assert sum(i in bad for i, _ in rows) <= 5 and len({i for i, _ in docs} - bad - {i for i, _ in rows}) <= 5

    after_lines = [(i, t) for i, t, n, gone in brute_lines(rows) if gone < n or not gone]
    keep = {d for d, _, _, kept_ in brute_near(after_lines, 5) if kept_}
    after_near = [(i, t) for i, t in after_lines if i in keep]
    hit = {r[0] for r in brute_windows(after_near, bench) if r[5]}
    left = {i: t for i, t in after_near if i not in hit}
    assert 1300 in hit and 1302 in left
    tokens = brute_tokens(left.items())
    got, covered = corpus_pipeline.run(spark, sf).collect(), defaultdict(Counter)
    for r in got:
        ids = tokens[r["doc_id"]]
        assert len(ids) == r["doc_tokens"]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        covered[r["doc_id"]].update(range(r["start"], r["start"] + r["length"]))
    assert {i: Counter(range(len(t))) for i, t in tokens.items()} == dict(covered)
