"""The lexer, the evidence of names in nine languages, and the order of decisions."""

import time

import pytest
from pyspark.sql import functions as F

from spanlake.code import lexicon, regions, rename, symbols
from spanlake.code.lexer import tokens
from spanlake.operators import symbols as decisions


def names(code, language):
    return " ".join(t.text for t in tokens(code, language) if t.kind == "name")


@pytest.mark.parametrize(
    "language,code,want",
    [
        ("javascript", "a = `x ${f({b: `y ${c.d} }`})} z ${e}`; // g\nh", "a f b c d e h"), ("python", 'x = f"a {b:>{w}} {{no}} {d["k"]} {g(f\'{h}\')}" # i', "x b w d g h"), ("swift", 'let s = "a \\(b(c: "q \\(d)")) e"; /* f /* g */ h */ let i', "let s b c d let i"),
        ("kotlin", 'val s = "a $b ${c.map { "x$d" }} e"', "val s b c map d"), ("ruby", 'puts "a #{b.map { |c| "#{d}" }} e" # f', "puts b map c d"), ("rust", "fn f<'a>(x: &'a str) -> char { 'b' } /* c /* d */ e */", "fn f x str char"),
        ("csharp", 'var s = $"a {b:0.0} {{c}} {d ?? "e"}"; var t = @"f ""g"" \\"; h', "var s b d var t h"), ("sql", "select 'it''s' as a -- b\nfrom c", "select as a from c"), ("php", 'echo "a $b {$c->d} ${e}" . \'$f\';', "echo b c d e"),
        ("python", '"""a\nb"""\n\'\'\'c\'\'\' d', "d"), ("go", "`a\\` b", "b"), ("java", "'x' + c /* d */ // e", "c"), ("lua", "--[[ a\nb ]] c -- d", "c"), ("javascript", "'open\nb", "b"), ("javascript", "`open ${a", "a"),
    ],
)
def test_lexer(language, code, want):
    assert names(code, language) == want


@pytest.mark.parametrize("code,language", [("`${" * 30000, "javascript"), ("/*" * 50000, "rust"), ('"\\(' * 30000, "swift"), ("'" * 50001, "python"), ("a b c = d(\n" * 8000, "java"), ("((((" * 20000 + "))))" * 20000, "javascript"), ("f({a: 1, b: {c: 2}});\n" * 5000, "javascript")])
def test_long_code_takes_linear_time(code, language):
    start = time.time()
    symbols.evidence(code, language)
    assert time.time() - start < 12


#: language, code, and name=role of what it declares, ^name for imports, name<receiver, name{callee for options.
CASES = [
    ("python", "import pandas as pd\nfrom .ledger import Invoice\nclass Billing(Base):\n    total: int = 0\n    def load(self, customer, *rows, limit=3):\n        self.cache = {}\n        frame = pd.read_csv(customer, sep=';')\n        a, b = frame.head(limit), 2\n        for k, v in rows:\n            pass\n        with open(p) as handle, x as y:\n            pass\n        return [lambda q, w: q for item in rows]\ntry: pass\nexcept ValueError as err: pass\n",
     "Invoice=class Billing=class total=variable load=function customer=parameter rows=parameter limit=parameter cache=property frame=variable a=variable b=variable k=variable v=variable handle=variable y=variable q=parameter w=parameter item=variable err=variable ledger=namespace ^pandas ^pd read_csv<pd head<pd sep{pd"),
    ("javascript", "import React, { useState } from 'react';\nimport { helper } from './util';\nconst fs = require('fs'), el = $('#x'); el.addClass('y');\nlet a = 1, { b } = obj, [e1, f1] = list;\n$.ajax({ url: target, success: (data) => render(data) });\nclass Foo extends Bar { count = 0; async loadAll(id, { deep = true }) { this.items = id; } }\nfunction calc(x, ...rest) { return x.map(v => v.total); }\nsettings({ color: 1 });",
     "helper=function el=variable a=variable b=variable e1=variable f1=variable data=parameter Foo=class count=property loadAll=function id=parameter deep=parameter items=property calc=function x=parameter rest=parameter v=parameter ^React ^useState ^fs addClass<$ ajax<$ url{$ success{$ color{settings"),
    ("java", "package com.acme;\nimport java.util.List;\npublic class InvoiceService extends Base {\n    private final Map<String, List<Order>> cache = new HashMap<>();\n    private static int MAX_SIZE = 3;\n    public Order loadInvoice(int invoiceId, String... names) throws IOException {\n        for (Order o : orders) { o.pay(); }\n        List<String> parts = Arrays.asList(names);\n        parts.stream().map(p -> p.trim());\n        try { x(); } catch (IOException ex) { log(ex); }\n    }\n}",
     "com=namespace acme=namespace InvoiceService=class cache=property MAX_SIZE=constant loadInvoice=function invoiceId=parameter names=parameter o=variable parts=variable p=parameter ex=variable ^java ^util ^List asList<Arrays map<Arrays pay<o"),
    ("go", 'package main\nimport (\n  "fmt"\n  "github.com/gin-gonic/gin"\n)\ntype Ledger struct {\n\tTotal int\n\trows []string\n}\nfunc (l *Ledger) Load(id, size int, name string) error {\n\tsum, err := l.fetch(id)\n\tfor _, price := range items { sum += price }\n\tfmt.Println(sum)\n}',
     "main=namespace Ledger=class Total=property rows=property l=parameter Load=function id=parameter size=parameter name=parameter sum=variable err=variable _=variable price=variable ^fmt ^gin Println<fmt fetch<l"),
    ("rust", "use std::collections::HashMap;\nuse crate::ledger::Book;\npub struct Invoice { pub total: u32, name: String }\nimpl Invoice { fn load(&self, id: u64, mut buf: Vec<u8>) -> Result<u32, Error> { let mut sum = 0; let (a, b) = id.split(); let m = HashMap::new(); m.insert(sum, |x| x + 1); sum } }\nenum Kind { Paid, Open(u32) }",
     "ledger=function Book=class Invoice=class total=property name=property load=function id=parameter buf=parameter sum=variable a=variable b=variable m=variable x=parameter Kind=class Paid=constant Open=constant ^std ^collections ^HashMap insert<HashMap"),
    ("csharp", "using System.Linq;\nnamespace Acme.Billing { public class Service : Base { public int Total { get; set; } private readonly ILogger<Service> _logger; public async Task<Order> LoadAsync(int id, string name = \"x\") { var order = await _db.Find(id); foreach (var row in order.Rows) { Console.WriteLine(row); } return order; } } }",
     "Acme=namespace Billing=namespace Service=class Total=property _logger=property LoadAsync=function id=parameter name=parameter order=variable row=variable ^System ^Linq WriteLine<Console Find<_db"),
    ("kotlin", "import kotlinx.coroutines.launch\ndata class Invoice(val total: Int, var name: String?)\nfun load(id: Int, names: List<String>): Invoice { val sum = names.map { n -> n.length }; return Invoice(total = 1, name = null) }",
     "Invoice=class total=parameter name=parameter load=function id=parameter names=parameter sum=variable n=parameter ^kotlinx ^coroutines ^launch"),
    ("php", "<?php\nuse App\\Models\\User;\nclass Billing { private $cache; public function load(User $user, $limit = 3) { $total = $user->sum($limit); foreach ($rows as $key => $row) { echo \"x {$row->name}\"; } return $this->cache; } }",
     "Billing=class cache=property load=function user=parameter limit=parameter total=variable key=variable row=variable ^App ^Models ^User sum<user"),
    ("typescript", "interface User { id: number; fullName?: string; load(x: number): void }\ntype Rows = User[];\nexport const pick = (user: User, n = 2): string => user.fullName;\nenum Color { Red, Green = 2 }",
     "User=class id=property fullName=property load=function x=parameter Rows=class pick=variable user=parameter n=parameter Color=class Red=constant Green=constant"),
]


@pytest.mark.parametrize("language,code,want", CASES, ids=[c[0] for c in CASES])
def test_evidence(language, code, want):
    found = symbols.merged([symbols.evidence(code, language)])
    declared, rest = [w for w in want.split() if "=" in w], [w for w in want.split() if "=" not in w]
    assert sorted(f"{n}={e.role}" for n, e in found.items() if e.declared) == sorted(declared)
    for w in rest:
        if w[0] == "^":
            assert found[w[1:]].imported, w
        else:
            sign = "<" if "<" in w else "{"
            name, of = w.split(sign)
            assert of in (found[name].receivers if sign == "<" else found[name].options), w


def test_each_step_decides(spark):
    text = "```python\nimport pandas as pd\ndef load(rows):\n    frame = pd.read_csv(rows, sep=1)\n    return wrap(frame.head(), len(rows), helper, shown, hidden)\n```"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z"), (4, "prose about nothing", "w")], "doc long, t string, name string")
    verdicts = spark.createDataFrame([("shown", True), ("hidden", False), ("hidden", True), ("load", False)], "name string, own boolean")
    got = {r["name"]: (r["step"], r["own"]) for r in decisions.decided(decisions.evidence(df, "doc", "t"), "doc", verdicts=verdicts, fallback=("helper",)).collect()}
    assert got == {
        "pandas": ("imported", False), "pd": ("imported", False), "load": ("declared", True), "rows": ("declared", True), "frame": ("declared", True), "read_csv": ("receiver", False), "sep": ("option", False), "wrap": ("undeclared", True),
        "head": ("receiver", False), "len": ("lexicon", False), "helper": ("fallback", False), "shown": ("verdict", True), "hidden": ("verdict", False),
    }
    known = spark.createDataFrame([("python", "wrap"), ("python", "wrap")], "language string, name string")
    assert {r["name"]: r["step"] for r in decisions.decided(decisions.evidence(df, "doc", "t"), "doc", known).collect()}["wrap"] == "lexicon"


def test_decisions_in_a_row_and_by_joins_agree(spark):
    texts = [(k, f"```{language}\n{code}\n```") for k, (language, code, _) in enumerate(CASES)]
    df = spark.createDataFrame(texts, "doc long, t string")
    got = {(r["doc"], r["name"]): (r["role"], r["step"]) for r in decisions.decided(decisions.evidence(df, "doc", "t"), "doc").collect()}
    want = {}
    for k, t in texts:
        for n, decided in symbols.decide(rename.names_of(t, regions.languages(t)), lexicon.known, set(), set(lexicon.RESERVED)).items():
            want[k, n] = decided
    assert got == want


def test_error_output_is_no_code_but_names_own_functions():
    text = "```python\ndef load_invoice(customer):\n    return customer\n```\nTraceback (most recent call last):\n  File \"/home/anna/app/main.py\", line 3, in load_invoice\n    x = 1\n  File \"/usr/lib/python3/site-packages/a.py\", line 9, in run\nValueError: bad 'customer'\n"
    out, names = rename.renamed(text)
    assert names == {"load_invoice": "func_1", "customer": "param2"}
    assert "in func_1" in out and "bad 'param2'" in out and "Traceback (most recent call last)" in out and "in run" in out


def test_unclosed_tags_take_linear_time():
    start = time.time()
    assert regions.code_regions("<code>" * 100_000) == [] and regions.code_regions("<pre>a<code>b</pre>c</code>") == [(0, 19)]
    assert time.time() - start < 5


def test_languages_without_labels():
    for code, want in (
        ("interface User { id: number; name: string }\nexport const a = (u: User): string => u.name;", "typescript"), ("#include <iostream>\nint main() {\n  std::cout << 1;\n}", "cpp"), ("#include <stdio.h>\nint main(void) {\n  printf(\"x\");\n  return 0;\n}", "c"),
        ("class A\n  attr_accessor :b\n  def c\n    puts @b\n  end\nend", "ruby"), ("<?php\nfunction f($a) {\n  echo $a;\n  $this->b = 1;\n}", "php"), ("Imports System\nPublic Class A\n  Dim x As Integer\nEnd Class", "vbnet"), ("(defun f (x) (format t \"a\"))\n(setf y 1)", "lisp"),
        ("entity a is\nend a;\narchitecture b of a is\nsignal c : std_logic;\nbegin\nend b;", "vhdl"), ("let rec f x = match x with\n  | [] -> 0\n;;", "ocaml"), ("open System\nlet f x = x |> List.map id\nprintfn \"a\"", "fsharp"), ("This is a sentence. Another one: with a list, and words.", "unknown"), ("x = 1", "unknown"),
    ):
        assert regions.language_of(code)[0] == want


def test_planted_words(spark):
    from spanlake.plans import planted

    df = spark.createDataFrame([(1, "Some words of this kind here"), (2, None), (3, "ab")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in planted.coded(df).collect()}
    assert rows[1]["words"] == ["somew", "wordsx", "thisy", "kindz"] and rows[2]["words"] == ["alphaw", "bravox", "caroly", "deltaz"]
    assert rows[1]["code"] == planted.PIECES[1].format(*rows[1]["words"]) and rows[3]["text"] == "ab\n\n" + rows[3]["code"] + "\n\n"
    assert df.select(F.lit(1)).count() == 3


def test_unknown_code_keeps_words_that_are_names_elsewhere():
    """array is a function of PHP and a module of Python; in code of neither it is one's own."""
    value = "see <code>osezciw_lamentearx = array(ieieezz)</code>"
    assert rename.renamed(value) == ("see <code>var_1 = func2(var3)</code>", {"osezciw_lamentearx": "var_1", "array": "func2", "ieieezz": "var3"})
    assert all(lexicon.known("unknown", n) for n in ("console", "println", "len", "Math")) and lexicon.known("php", "array") and lexicon.known("python", "array")
