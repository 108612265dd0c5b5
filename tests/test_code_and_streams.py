"""Code analysis, corpora, stores and streams."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanlake.code import identifiers, regions, rename, traces
from spanlake.operators import synthetic
from spanlake.plans import fixtures
from spanlake.sources import corpus
from spanlake.streaming import observe


def test_regions():
    value = "a\n````py\nx\n```\ny\n````\nb <code>z</code>\n```\nopen"
    assert [value[a:b] for a, b in sorted(regions.code_regions(value))] == ["````py\nx\n```\ny\n````", "<code>z</code>", "```\nopen"]
    assert regions.subtracted([(0, 10), (20, 30)], [(2, 4), (8, 22)]) == [(0, 2), (4, 8), (22, 30)]
    assert regions.code_runs("Hello there my friend.\nconst a = 1;\nlet b = f(a);\nBye now dear friend.")
    assert not regions.code_runs("Just prose.\nAnd a second line of it, nothing more.")


@pytest.mark.parametrize("code,lang", [("def f(x):\n    self.y = None\n    return x", "python"), ("package main\nfunc f() {\n x := 1\n fmt.Println(x)\n}", "go"), ("fn main() { let mut x = vec![1]; println!(\"{}\", x); }", "rust"), ("select a from b where c group by d", "sql"), ("hello", "unknown")])
def test_languages(code, lang):
    assert regions.language_of(code)[0] == lang


def test_runs_of_code():
    runs = lambda t: [t[a:b] for a, b in regions.code_runs(t)]
    assert runs("It is defined there. let x = 1;\nThanks a lot for this") == ["let x = 1;"]
    assert runs("Look at this:\nint a = 1; var b = a;") == ["int a = 1; var b = a;"]
    assert runs("class A:\n    total: int = 0\n    def f(self):\n        return 1\n\nThe end of it all") == ["class A:\n    total: int = 0\n    def f(self):\n        return 1"]
    assert runs("if the weather is fine, we go") == runs("don't you know it won't work (at all)") == runs("Name: Anna\nAge: 3") == []


@pytest.mark.parametrize(
    "code,lang",
    [
        ("module Main where\nimport qualified Data.Map as M\nmain :: IO ()", "haskell"), ("local function f(a)\n  local x = 1\nend", "lua"), ("import Foundation\nguard let x = y else { return }", "swift"), ("use strict;\nmy $x = 1;", "perl"),
        ("defmodule A do\n  def f(), do: IO.puts \"x\"\nend", "elixir"), ("module a(input wire clk);\nalways @(posedge clk) begin end\nendmodule", "verilog"), ("(ns a.b (:require [c]))\n(defn f [x] (let [y 1] y))", "clojure"),
        ("program a\nimplicit none\ninteger :: i\nend program a", "fortran"), ("x <- c(1,2)\nlibrary(dplyr)\ny <- x %>% f()", "r"), ("section .text\nglobal _start\n mov eax, 1", "x86asm"), ("using System;\nnamespace A { class B { public int X { get; set; } } }", "csharp"),
    ],
)
def test_more_languages(code, lang):
    assert regions.language_of(code)[0] == lang


def test_labels():
    assert [regions.language_of("x", label)[0] for label in ("c#", "PWSH {1}", "tsx", "yml", "nothing")] == ["csharp", "powershell", "typescript", "yaml", "unknown"]


OUTPUT = {
    "node": "TypeError: Cannot read properties of undefined (reading 'total')\n    at InvoiceService.loadInvoice (/app/src/invoice.ts:42:13)\n    at async Object.run [as go] (/app/node_modules/x/index.js:1:2)\n    at /app/src/index.js:5:3\n    at Array.map (<anonymous>)",
    "dotnet": "Unhandled exception. System.NullReferenceException: Object reference not set\n   at Acme.InvoiceService.Load(Int32 id) in C:\\src\\InvoiceService.cs:line 42\n   at System.Threading.Tasks.Task.Execute()\n   --- End of inner exception stack trace ---",
    "mono": "System.Exception: bad\n  at Acme.Foo.Bar (System.Int32 id) [0x00012] in /src/Foo.cs:12 ",
    "java": "Exception in thread \"main\" java.lang.IllegalStateException: no 'customer'\n\tat com.acme.Billing.load(Billing.java:12)\n\tat java.util.List.get(List.java:3)\nCaused by: com.acme.LedgerException\n\t... 3 more",
    "javac": "Invoice.java:12: error: cannot find symbol\n    total = custmerName;\n            ^\n  symbol:   variable custmerName\n  location: class Invoice",
    "go": "goroutine 1 [running]:\nmain.(*Ledger).load(0xc0000)\n\t/home/anna/ledger.go:12 +0x1d\ncreated by main.start in goroutine 1\n\t/home/anna/main.go:9 +0x11",
    "rust": "stack backtrace:\n   0: rust_begin_unwind\n             at /rustc/abc/library/std/src/panicking.rs:5:5\n   1: ledger::load_invoice\n             at ./src/main.rs:5:10",
    "rustc": "error[E0425]: cannot find value `customer_nam` in this scope\n  --> src/main.rs:4:5\n   |\n4  |     customer_nam\n   |     ^^^^ help: `customer_name`",
    "tsc": "src/invoice.ts:12:5 - error TS2339: Property 'customerName' does not exist",
    "gcc": "main.c:12:5: error: 'total' undeclared\n   12 |     total = 1;\n      |     ^~~~~",
    "kotlin": "e: file:///src/Main.kt:5:13 Unresolved reference: customerName",
    "csc": "C:\\src\\Foo.cs(42,17): error CS0103: The name 'customer' does not exist",
}
NAMES = {
    "node": "type:TypeError mention:total function:InvoiceService.loadInvoice path:/app/src/invoice.ts function:Object.run* path:/app/node_modules/x/index.js* path:/app/src/index.js function:Array.map",
    "dotnet": "type:System.NullReferenceException function:Acme.InvoiceService.Load path:C:\\src\\InvoiceService.cs function:System.Threading.Tasks.Task.Execute*",
    "mono": "type:System.Exception function:Acme.Foo.Bar path:/src/Foo.cs",
    "java": "type:java.lang.IllegalStateException mention:customer function:com.acme.Billing.load path:Billing.java function:java.util.List.get* path:List.java* type:com.acme.LedgerException",
    "javac": "path:Invoice.java mention:custmerName mention:Invoice",
    "go": "function:main.(*Ledger).load path:/home/anna/ledger.go function:main.start path:/home/anna/main.go",
    "rust": "function:rust_begin_unwind* path:/rustc/abc/library/std/src/panicking.rs* function:ledger::load_invoice path:./src/main.rs",
    "rustc": "mention:customer_nam path:src/main.rs", "tsc": "path:src/invoice.ts mention:customerName", "gcc": "path:main.c mention:total", "kotlin": "path:/src/Main.kt mention:customerName", "csc": "path:C:\\src\\Foo.cs mention:customer",
}


@pytest.mark.parametrize("kind", sorted(OUTPUT))
def test_error_output(kind):
    """Whole outputs are one region; a * marks library frames."""
    text = OUTPUT[kind]
    assert " ".join(f"{s.kind}:{s.name}{'*' * s.library}" for s in traces.error_slots(text)) == NAMES[kind]
    assert traces.error_regions("We ran it.\n\n" + text + "\nThat is all we know")[0] == (12, 12 + len(text))
    assert all(text[s.start : s.end] == s.name for s in traces.error_slots(text))


def test_prose_is_no_error_output():
    assert traces.error_slots("We met at home (2020) and saw an error: nothing else.\nat work (see below)\n  at noon (maybe)\nIt was a Fault\nerror: see the manual page\n1: first\n | table | cell |") == []
    assert traces.error_regions("x" * 100_000 + " Error\n" + "a.b" * 50_000 + ":" + " at" * 50_000) == []


def test_traces():
    value = fixtures.CODE[2][1]
    slots = {(s.name, s.kind, s.library) for s in traces.error_slots(value)}
    assert {("load_invoice", "function", False), ("run", "function", True), ("ValueError", "type", False), ("customer_id", "mention", False)} <= slots
    assert traces.frames_as_code(value) == "load_invoice();"
    assert [value[a:b] for a, b in traces.error_regions(value)] == [value]
    assert traces.error_slots("plain text") == []
    for _, t in fixtures.CODE:
        assert all(t[s.start : s.end] == s.name for s in traces.error_slots(t))


def test_single_lines_of_error_output(spark):
    from spanlake.code import columns

    want = {
        (11, "./main.go", "path"), (11, "customerName", "mention"), (12, "src/a.kt", "path"), (12, "loadInvoice", "mention"), (13, "KeyboardInterrupt", "type"), (14, "com.acme.BillingExit", "type"), (15, "java.lang.Throwable", "type"),
        (16, "acme.LedgerPanic", "type"), (17, "acme.SegmentFault", "type"), (18, "src/ledger.rs", "path"), (19, "/home/anna/app/main.py", "path"), (19, "load_invoice", "function"), (20, "/home/anna/ledger.go", "path"),
    }
    assert {(r["id"], r["name"], r["kind"]) for r in fixtures.code(spark).where("id > 10").select("id", F.explode(columns.error_slots(F.col("text"))).alias("s")).select("id", "s.*").collect()} == want
    assert traces.error_slots("console.log(total)\nledger.load(a, b)") == []


def test_gate_lets_code_through(spark):
    from spanlake.code import columns

    values = ["const total=1\nlet rest=2", "  $(total)", "a=1\nb=2", "x->y\na::b", "  const a\n  let b ", "if a&&b", "<CODE>x</CODE>", *(t for _, t in fixtures.CODE)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(values)], "i int, t string")
    got = {r["i"]: [(x["start"], x["end"]) for x in r["r"]] for r in df.select("i", columns.code_regions(F.col("t")).alias("r")).collect()}
    assert all(bool(got[i]) == bool(regions.all_code(t)) for i, t in enumerate(values)) and all(got[i] for i in range(7))


def test_identifiers():
    assert identifiers.words("getHTTPServer_name2X") == ["get", "HTTP", "Server", "name2", "X"]
    value = "see loadAnnaInvoice and anna_total"
    view, places = identifiers.split_view(value, [(0, len(value))])
    assert view == "see load Anna Invoice and anna total"
    at = view.index("Anna")
    assert [value[a:b] for a, b in identifiers.to_original(value, places, [(at, at + 4)])] == ["Anna"]
    assert len(identifiers.propagated(value, [(0, len(value))], ["Anna"])) == 2
    assert identifiers.only_generic("getUserName", 3, 11, True) and not identifiers.only_generic("Anna", 0, 4, True)
    assert len(identifiers.path_view("/home/anna/x")) == len("/home/anna/x")


def test_rename_is_consistent():
    value = fixtures.CODE[0][1]
    out, names = rename.renamed(value)
    assert set(names) == {"load_invoice", "customer_name", "total", "invoice_total"} and "pandas" in out
    assert all(n not in out for n in ("load_invoice", "customer_name", "invoice_total"))
    back = out
    for old, new in sorted(names.items(), key=lambda kv: -len(kv[1])):
        back = back.replace(new, old)
    assert back == value
    assert rename.renamed("no code here") == ("no code here", {})
    assert rename.alias("MAX_SIZE", "constant", 4) == "CONST_4" and rename.alias("_Invoice", "class", 1) == "_Class1" and rename.alias("ClientName", "property", 3) == "Field3"


def test_synthetic_links():
    a = synthetic.synthetic_link("https://secret.corp:8080/Team/2024/plan.pdf?user=ann&id=7#Top")
    assert a == synthetic.synthetic_link("https://secret.corp:8080/Team/2024/plan.pdf?user=ann&id=7#Top")
    assert a.startswith("https://") and ":8080/" in a and a.count("/") == 5 and ".pdf?user=" in a and "&id=" in a and "secret" not in a
    p = synthetic.synthetic_path(r"C:\Users\Anna\plan.docx")
    assert p.startswith("C:\\Users\\") and p.endswith(".docx") and "Anna" not in p


def test_corpus_round_trip(spark, tmp_path):
    raw = [
        {"id": 1, "language": "en-US", "source_text": "Héllo Ann", "privacy_mask": [{"start": 6, "end": 9, "value": "Ann", "label": "FIRSTNAME"}]},
        {"uid": "x", "lang": "german", "text": "Bo wohnt in Ulm", "span_labels": json.dumps([[0, 2, "GIVENNAME", "Bo"], [99, 120, "CITY", "Ulm"]])},
        {"id": 3, "language": "fr", "text": "non"}, {"id": 4, "language": "de", "text": ""},
    ]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.jsonl").write_text("\n".join(json.dumps(r) for r in raw[:2]) + "\n\n")
    (tmp_path / "raw" / "b.json").write_text(json.dumps({"data": raw[2:]}))
    ex = corpus.examples_from_raw(corpus.read_raw(spark, str(tmp_path / "raw")))
    got = {r["source"]["recordId"]: r for r in ex.collect()}
    assert set(got) == {"1", "x"}
    assert [tuple(s) for s in got["1"]["goldSpans"]] == [(7, 10, "PERSON", "Ann")]
    assert [tuple(s) for s in got["x"]["goldSpans"]] == [(12, 15, "LOCATION", "Ulm")]
    corpus.write_corpus(ex, str(tmp_path / "out"), "test")
    again = corpus.read_corpus(spark, str(tmp_path / "out"))
    assert again.count() == 2 and again.where("error IS NOT NULL").count() == 0


def test_corpus_errors(spark, tmp_path):
    good = {"recordType": "example", "id": "a", "language": "en", "lengthBucket": "short", "text": "é Ann", "goldSpans": [{"start": 3, "end": 6, "entity_type": "PERSON", "text": "Ann"}], "source": {"dataset": "d", "recordId": "1"}}
    bad = [good | {"language": "xx"}, good | {"goldSpans": [{"start": 1, "end": 6, "entity_type": "PERSON", "text": "Ann"}]}, good | {"id": ""}]
    (tmp_path / "c.jsonl").write_text("\n".join([json.dumps({"recordType": "metadata", "spanOffsetUnit": "utf8-bytes"}), "", json.dumps(good), *map(json.dumps, bad), "{broken"]))
    rows = corpus.read_corpus(spark, str(tmp_path / "c.jsonl"), fail=False).orderBy("line").collect()
    assert [r["error"] is None for r in rows] == [True, False, False, False, False] and rows[0]["line"] == 3
    with pytest.raises(Exception, match="language must be"):
        corpus.read_corpus(spark, str(tmp_path / "c.jsonl")).collect()
    (tmp_path / "d.jsonl").write_text(json.dumps(good))
    with pytest.raises(ValueError, match="exactly one metadata"):
        corpus.check_corpus(spark, str(tmp_path / "d.jsonl"))


def test_broken_lines_are_joined():
    assert list(corpus.records_of('{"a": "x\ny"}\n{"a": 1}')) == [{"a": "x\ny"}, {"a": 1}]
    with pytest.raises(ValueError):
        list(corpus.records_of('{"a": }\n'))
    assert corpus.quota(25, list("abcdef")) == {"a": 5, "b": 4, "c": 4, "d": 4, "e": 4, "f": 4}


def test_transcript():
    html = "<html><head><style>x{}</style><script>var a='<p>';</script></head><body><p>One <b>two</b></p><div contenteditable>no</div><textarea>no</textarea><br>three &amp; four</body></html>"
    assert corpus.transcript(html) == "One\ntwo\nthree & four"
    assert corpus.transcript(None) is None


def test_stores(spark):
    e = spark.createDataFrame([(i % 60, i, "o" * 3, "a" * (30_000 if i == 199 else 3)) for i in range(200)], "id int, created long, original string, anonymized string")
    h = corpus.history(e).collect()
    assert len(h) == 50 and h[0]["created"] == 199 and h[0]["truncated"] and len(h[0]["anonymized"]) == 20_000
    c = corpus.conversations(spark.createDataFrame([("c", "[A_1]"), ("c", "[A_1]")], "conversation string, token string"), spark.createDataFrame([("c", "[A_2]", "x")], "conversation string, token string, original string")).first()
    assert c["tokens"] == ["[A_1]", "[A_2]"] and c["originals"] == {"[A_2]": "x"}


def stream_of(spark, tmp_path, name, rows, schema, files=2):
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))


def run(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive
    return df.sparkSession.table(name).collect()


def test_vault_stream(spark, tmp_path):
    """Two batches, each with new and known identities; the second is run again."""
    rows = [(i, 0, "EMAIL" if i % 3 else "PHONE", f"Name {i % (8 + 4 * (i % 2))}") for i in range(60)]
    stream = stream_of(spark, tmp_path, "v", rows, "k long, start int, entity_type string, text string")
    path, state = str(tmp_path / "vault"), str(tmp_path / "state")
    for _ in range(2):
        q = observe.vault_stream(stream, "k", path, state)
        q.awaitTermination(120)
    got = spark.read.parquet(f"{path}/records").collect()
    assert {r["batch"] for r in got} == {0, 1}
    for kind in ("EMAIL", "PHONE"):
        own = [r for r in got if r["entity_type"] == kind]
        assert sorted(r["index"] for r in own) == list(range(1, len(own) + 1)) and len({r["normalized_key"] for r in own}) == len(own)
    assert {(r["entity_type"], r["normalized_key"]) for r in got} == {(t, n.lower()) for _, _, t, n in rows}
    used = Counter((t, n.lower()) for _, _, t, n in rows)
    assert {(r["entity_type"], r["normalized_key"]): r["usage_count"] for r in observe.stream_vault(spark, path).collect()} == used
    # the last batch's commit is lost: it is run again, and changes nothing
    (tmp_path / "state" / "commits" / "1").unlink()
    (tmp_path / "state" / "commits" / ".1.crc").unlink(missing_ok=True)
    observe.vault_stream(stream, "k", path, state).awaitTermination(120)
    assert {(r["entity_type"], r["normalized_key"]): r["usage_count"] for r in observe.stream_vault(spark, path).collect()} == used


def test_quiet_periods_in_a_stream(spark, tmp_path):
    rows = [("a", 0.0, "x"), ("a", 0.3, "y"), ("a", 2.0, "z"), ("b", 0.1, "q"), ("z", 100.0, "end"), ("z", 200.0, "end")]
    schema = "k string, s double, v string"
    df = stream_of(spark, tmp_path, "d", rows, schema, files=1).withColumn("t", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))
    got = run(observe.quiet_periods(df, "k", "t", "v", late="1 second"), "quiet_s", tmp_path)
    assert {(r["k"], r["n_updates"], r["last_value"]) for r in got if r["k"] != "z"} == {("a", 2, "y"), ("a", 1, "z"), ("b", 1, "q")}


def test_changed_stream_equals_table(spark, tmp_path):
    """Three batches, out of order; a last check far later lets the watermark pass the others."""
    rows = [("k" + str(i % 2), 5000.0 + i, "abba"[i // 2 % 4]) for i in range(16)]
    schema = "k string, s double, v string"
    at = lambda df: df.withColumn("t", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    for lot in (rows[8:], rows[:8], [("end", 6000.0, "x"), ("end", 7000.0, "y")]):
        df = stream_of(spark, tmp_path, "c", lot, schema, files=1)
    got = run(observe.changed_stream(at(df), "k", "t", "v", late="60 seconds"), "changed_s", tmp_path)
    table = observe.changed(at(spark.createDataFrame(rows, schema)), "k", "t", "v").select("k", "t", "v").collect()
    assert sorted(tuple(r) for r in got if r["k"] != "end") == sorted(map(tuple, table))


def test_a_key_with_many_checks_has_one_timer(spark, tmp_path):
    """Each of a key's checks once had a timer, and each timer read all that waited."""
    import time

    rows = [("k", 5000.0 + i, "ab"[i // 3 % 2]) for i in range(6000)]
    schema = "k string, s double, v string"
    for lot in (rows, [("end", 50000.0, "x")], [("end", 60000.0, "y")]):
        df = stream_of(spark, tmp_path, "many", lot, schema, files=1)
    at = df.withColumn("t", F.timestamp_micros((F.col("s") * 1_000_000).cast("long"))).drop("s")
    begun = time.time()
    got = run(observe.changed_stream(at, "k", "t", "v", late="60 seconds"), "changed_many", tmp_path)
    assert len([r for r in got if r["k"] == "k"]) == 2000 and time.time() - begun < 60


def test_scratch_tables_are_dropped(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    from spanlake.plans import scratch

    begun = scratch.mark()
    a, b = (scratch.stored(spark.range(5), f"test-{x}") for x in "ab")
    folders = [Path(urlparse(f).path).parent for df in (a, b) for f in df.inputFiles()[:1]]
    assert all(f.exists() for f in folders)
    scratch.dropped(spark, begun, keep=b)
    assert [f.exists() for f in folders] == [False, True] and b.count() == 5
    scratch.dropped(spark, begun)
    assert not any(f.exists() for f in folders)
