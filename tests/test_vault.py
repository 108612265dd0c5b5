"""The vault as an edited table, aliases given out in parallel, and identities of keys of any type."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.functions import spans
from spanlake.operators import aliases, pseudonym, restore
from spanlake.operators.vault_table import VaultTable


def found(spark, n=120, kind="long"):
    rows = [((f"k{i:03d}" if kind == "string" else i), i % 3, "EMAIL" if i % 3 else "PHONE", f"Name {i % 40}") for i in range(n)]
    return spark.createDataFrame(rows, f"doc {kind}, start int, entity_type string, text string")


def plain(df):
    return {r["id"]: r for r in df.collect()}


def test_edits_equal_brute_force(spark, tmp_path):
    """Random edits, deletions and compactions against a dictionary."""
    t, r = VaultTable(spark, str(tmp_path)), random.Random(1)
    t.put(pseudonym.vault_update(found(spark), "doc"))
    state = {i: {**x.asDict()} for i, x in plain(t.load()).items()}
    assert {x["updated"] for x in state.values()} == {1} and len(state) > 50
    snapshots = {1: dict(state)}
    for turn in range(4):
        edits = []
        for i in r.sample(sorted(state), 9) + ["no such id"]:
            edits.append((i, r.choice([None, "synthetic", "placeholder"]), r.choice([None, "", "Some One"]), r.choice([None, True, False]), r.choice([None, "note"]), r.random() < 0.2))
        version = t.edit(spark.createDataFrame(edits, "id string, mode string, synthetic_value string, pinned boolean, notes string, deleted boolean"))
        state = {i: dict(x) for i, x in state.items()}
        for i, mode, value, pinned, note, gone in edits:
            if i not in state:
                continue
            for field, v in (("mode", mode), ("synthetic_value", value), ("pinned", pinned), ("notes", note)):
                state[i][field] = state[i][field] if v is None else v
            if state[i]["mode"] == "synthetic" and state[i]["synthetic_value"] == "":
                state[i]["mode"] = "placeholder"
            state[i]["updated"] = version
            if gone:
                del state[i]
        snapshots[version] = dict(state)
        if turn % 2:
            assert t.compact() == version
        assert {i: x.asDict() for i, x in plain(t.load()).items()} == state
    for version, then in snapshots.items():  # earlier versions stay readable
        assert {i: x.asDict() for i, x in plain(t.load(version)).items()} == then


def test_numbers_are_not_given_again(spark, tmp_path):
    t = VaultTable(spark, str(tmp_path))
    with pytest.raises(ValueError):
        t.load()
    t.put(pseudonym.vault_update(found(spark, 30), "doc"))
    most = t.counters()
    last = t.load().where((F.col("entity_type") == "EMAIL") & (F.col("index") == most["EMAIL"]))
    t.edit(last.select("id", F.lit(True).alias("deleted")))
    t.compact()
    assert t.counters() == most and t.load().count() == sum(most.values()) - 1
    new = pseudonym.numbered(pseudonym.identities(found(spark, 45), "doc"), t.load(), t.counters())
    assert min(r["index"] for r in new.where("entity_type = 'EMAIL'").collect()) == most["EMAIL"] + 1
    version = t.put(new)
    once = plain(t.load())
    t.put(new, version)  # written again after a lost driver
    assert plain(t.load()) == once


def test_broken_records_and_unfinished_versions_are_left_out(spark, tmp_path):
    t = VaultTable(spark, str(tmp_path))
    good = pseudonym.vault_update(found(spark, 6), "doc")
    bad = [good.limit(1).withColumn("id", F.lit(x)).withColumn(c, F.lit(v)) for x, c, v in (("a", "entity_type", "NOPE"), ("b", "mode", "odd"), ("c", "placeholder", "[EMAIL_99]"), ("d", "placeholder", "EMAIL_1"), ("e", "original_text", None))]
    rows = good
    for b in bad:
        rows = rows.unionByName(b)
    t.put(rows)
    assert set(plain(t.load())) == set(plain(good))
    (tmp_path / "changes" / "version=2").mkdir()
    assert t.version == 1


def test_reverse_index(spark, tmp_path):
    t = VaultTable(spark, str(tmp_path))
    t.put(pseudonym.vault_update(found(spark, 12), "doc"))
    rows = sorted(t.load().where("entity_type = 'EMAIL'").collect(), key=lambda r: r["index"])
    t.edit(spark.createDataFrame([(rows[0]["id"], "Same Name")], "id string, synthetic_value string"))
    t.edit(spark.createDataFrame([(rows[1]["id"], "Same Name")], "id string, synthetic_value string"))
    got = {r["token"]: r for r in t.reverse().collect()}
    assert got["Same Name"]["id"] == rows[1]["id"] and got["Same Name"]["clashes"] == 1
    assert got["[EMAIL_1]"]["original_text"] == rows[0]["original_text"] and "" not in got


def brute_aliases(names, taken, counter=0):
    """Rounds of numbers in order; losers go on."""
    from spanlake.code.rename import alias

    waiting, out = sorted(names, key=lambda n: (n[2], n[3], n[0])), {}
    while waiting:
        lost = []
        for k, n in enumerate(waiting):
            a = alias(n[0], n[1], counter + k + 1)
            if a in taken:
                lost.append(n)
            else:
                out[n[0]] = a
        counter, waiting = counter + len(waiting), lost
    return out


def test_aliases_equal_brute_force_and_do_not_depend_on_partitions(spark):
    r = random.Random(2)
    names = [(f"{r.choice(['_', ''])}name{r.choice(['_', ''])}x{i}", r.choice(["function", "variable", "class", "constant"]), r.randrange(50), r.randrange(9)) for i in range(300)]
    taken = {f"{w}{k}" for k in range(0, 700, 3) for w in ("func", "var", "Class")} | {"func_4", "var_8"}
    t = spark.createDataFrame([(a,) for a in sorted(taken)] * 2 + [(None,)], "alias string")
    want = brute_aliases(names, taken, 7)
    for parts in (1, 7):
        df = spark.createDataFrame(names, "name string, role string, k long, first int").repartition(parts)
        got = aliases.allocated(df, t, 7).collect()
        assert {x["name"]: x["alias"] for x in got} == want
        assert len({x["index"] for x in got}) == len(got) == len({x["alias"] for x in got})
    assert aliases.allocated(df.limit(0), t).collect() == []


def test_known_names_keep_their_aliases(spark, tmp_path):
    t = VaultTable(spark, str(tmp_path))
    t.put(pseudonym.vault_update(found(spark, 6), "doc"))
    schema, none = "name string, role string, k long, first int, uses int", spark.createDataFrame([], "alias string")
    t.upsert_aliases(spark.createDataFrame([("load", "function", 1, 0, 2), ("size", "variable", 2, 0, 1), ("var3", "variable", 3, 0, 1)], schema), none)
    first = {r["original_text"]: r for r in t.load().where("entity_type = 'IDENTIFIER'").collect()}
    assert {n: r["synthetic_value"] for n, r in first.items()} == {"load": "func1", "size": "var2", "var3": "var3"} or first["var3"]["synthetic_value"] != "var3"
    again = spark.createDataFrame([("load", "function", 9, 0, 5), ("fresh", "function", 9, 1, 1), ("size", "variable", 9, 2, 4)], schema)
    taken = spark.createDataFrame([("var2",)], "alias string")
    shown = {r["name"]: r["alias"] for r in t.preview(again, taken).collect()}
    before = t.version
    assert shown["load"] == "func1" and "size" not in shown and t.version == before
    t.upsert_aliases(again, taken)
    now = {r["original_text"]: r for r in t.load().where("entity_type = 'IDENTIFIER'").collect()}
    assert now["load"]["usage_count"] == 7 and now["size"]["usage_count"] == 1 and now["fresh"]["synthetic_value"] == shown["fresh"]


def test_vault_of_string_keys(spark):
    a, b = (pseudonym.vault_update(found(spark, kind=k), "doc").collect() for k in ("long", "string"))
    assert {(r["entity_type"], r["normalized_key"], r["index"]) for r in a} == {(r["entity_type"], r["normalized_key"], r["index"]) for r in b} and b[0]["first_key"].startswith("k")


def test_control_characters_stay(spark):
    text = "a\x01b [EMAIL_1] c\x02\x01 [NOPE_2]\x02 [EMAIL_1]"
    df = spark.createDataFrame([(text, {"[EMAIL_1]": "x@y.org"}), ("\x01 none \x02", {"[EMAIL_1]": "x"}), ("[EMAIL_1]", {"[EMAIL_1]": "\x01$0\\1"})], "t string, m map<string,string>")
    got = [r[0] for r in df.select(restore.strict(F.col("t"), F.col("m"))).collect()]
    assert got == [text.replace("[EMAIL_1]", "x@y.org"), "\x01 none \x02", "\x01$0\\1"]
    text = "\x02 x\x01 a@example.org\x01, \x01b@example.org \x02\x02c@example.org"
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(spans.recognized(F.col("t"), ("EMAIL",))).alias("s")).select("s.*").collect()
    assert [(r["start"], r["text"]) for r in got] == [(text.find(m), m) for m in ("a@example.org", "b@example.org", "c@example.org")]
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_a_vault_stream_reads_many_files(spark, tmp_path):
    """The halves of the documents were once written, and read, as one file each."""
    from pathlib import Path

    from spanlake.plans.scratch import shared_dir
    from spanlake.queries import QUERIES

    docs = [(i, f"mail ann{i}@example.org now", "en", "s", 20) for i in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    shared = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:"))
    before = set(shared.glob("vault-stream-*"))
    assert QUERIES["stream_vault"](spark, str(tmp_path)).count() == 40
    (made,) = set(shared.glob("vault-stream-*")) - before
    assert len([*made.glob("documents/*.parquet")]) > 2
