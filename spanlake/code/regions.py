"""Where a text holds code, in which language, and against which libraries."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable

Range = tuple[int, int]

FENCE = re.compile(r"^(`{3,})(.*)$")
TAG = re.compile(r"<(/?)(code|pre)(?:\s[^<>]*)?>", re.I)


def fenced(text: str) -> list[tuple[int, int, str]]:
    """(start, end, label) of blocks between fences; an open one runs to the end. A fence
    closes if it has as many ticks at least and nothing after them."""
    out, at, open_ = [], 0, None
    for line in text.split("\n"):
        m = FENCE.match(line)
        if m:
            ticks, rest = len(m[1]), m[2].strip()
            if open_ is None:
                open_ = (at, ticks, rest)
            elif ticks >= open_[1] and not rest:
                out.append((open_[0], at + len(line), open_[2]))
                open_ = None
        at += len(line) + 1
    if open_ is not None:
        out.append((open_[0], len(text), open_[2]))
    return out


def tagged(text: str) -> list[Range]:
    """From <code> or <pre> to the next closing tag of its kind; what is within it, or never
    closed, opens nothing. Tags are found once, and closing ones looked up from the right."""
    tags = [(m.start(), m.end(), m[2].lower(), m[1] == "/") for m in TAG.finditer(text)]
    closes: dict[str, int] = {}
    close_of: list[int | None] = [None] * len(tags)
    for k in range(len(tags) - 1, -1, -1):
        _, end, kind, closing = tags[k]
        close_of[k] = closes.get(kind)
        if closing:
            closes[kind] = end
    out, at = [], 0
    for (start, _, _, closing), end in zip(tags, close_of):
        if not closing and start >= at and end is not None:
            out.append((start, end))
            at = end
    return out


def code_regions(text: str) -> list[Range]:
    return [(a, b) for a, b, _ in fenced(text)] + tagged(text)


# ---- runs of lines that look like code

# Words that begin lines of code, and others that are no prose.
KEYWORDS = (
    "import", "from", "export", "package", "using", "#include", "def", "class", "interface", "enum", "struct", "impl", "fn", "func", "function", "const", "let", "var", "val", "public", "private", "protected", "static", "return",
    "if", "elif", "else", "for", "while", "switch", "case", "try", "catch", "except", "finally", "async", "await", "raise", "throw",
)
CODE_WORDS = (*KEYWORDS, "in", "is", "not", "and", "or", "new", "of", "as", "int", "string", "void", "bool", "boolean", "char", "long", "double", "float", "null", "true", "false")
#: Signs that prose doesn't use.
SIGNS = ("=>", "->", "::", "==", "===", "!=", "!==", "&&", "||")
ASSIGNS = ("=", "+=", ":=")
#: Words, numbers, strings, signs of several characters, and any other character.
TOKEN = re.compile(r"#include|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|\"[^\"]*\"|'[^']*'|`[^`]*`|===|!==|=>|->|::|:=|==|!=|\+=|&&|\|\||\S")
_WORDS, _CODE = frozenset(KEYWORDS), frozenset(CODE_WORDS)
_SENTENCE = re.compile(r"[.!?:]\s+")
#: Any text in which line_points(), fenced() or tagged() finds something has one of these.
MAY_BE = r"(?mU)```|(?i:<code|<pre)|[;{}=]|->|::|&&|\|\||[\w$]\(|\(\s*$|\)\s*:|^\s*(?:" + "|".join(KEYWORDS) + r")(?![\w$])"


def _is_word(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def is_prose(tokens: list[str]) -> bool:
    """Three plain words in a row, with or without commas between them."""
    row = 0
    for t in tokens:
        if t.isalpha() and t not in _CODE:
            row += 1
            if row == 3:
                return True
        elif t != ",":
            row = 0
    return False


def _dotted(tokens: list[str]) -> int:
    """How many tokens a dotted name at the beginning takes."""
    if not tokens or not _is_word(tokens[0]):
        return 0
    n = 1
    while n + 1 < len(tokens) and tokens[n] == "." and _is_word(tokens[n + 1]):
        n += 2
    return n


def line_points(line: str) -> int:
    """Evidence that a line is code, a point for each: a word that begins statements, an
    end that prose doesn't have, a sign of operators; two for a call or several
    statements that make up the line. Two points are enough for a run."""
    line = line.strip()
    tokens = TOKEN.findall(line)
    if not tokens:
        return 0
    last = tokens[-1]
    ends = last in (";", "{", "}", "=>", "(") or last == ":" and tokens[-2:-1] == [")"]
    statements = last == ";" and tokens.count(";") > 1 and ("=" in tokens or "(" in tokens)
    if not ends and is_prose(tokens):
        return 0
    name = _dotted(tokens)
    after = tokens[name : name + 1]
    assigns = name > 0 and after[:1] and after[0] in ASSIGNS and len(tokens) > name + 1
    called = name > 0 and after == ["("] and line.startswith("".join(tokens[:name]) + "(") and tokens[-2 if last == ";" else -1] == ")"
    signs = assigns or any(t in SIGNS for t in tokens) or line.find("();") >= 0
    return (tokens[0] in _WORDS) + ends + bool(signs) + 2 * (called or statements)


def is_member(line: str) -> bool:
    """An indented name with a type: total: int = 0, age?: number;"""
    if not line[:1].isspace():
        return False
    tokens = TOKEN.findall(line)
    at = 1 + (tokens[1:2] in (["?"], ["!"]))
    return len(tokens) > at + 1 and _is_word(tokens[0]) and tokens[at] == ":" and _is_word(tokens[at + 1]) and not is_prose(tokens)


def code_from(line: str) -> tuple[int, int]:
    """Where code begins in a line and its points; after a sentence it must suffice for a run."""
    for m in _SENTENCE.finditer(line):
        first = TOKEN.match(line, m.end())
        if first and first[0] in _WORDS and not line_points(line[: m.start()]) and (p := line_points(line[m.end() :])) > 1:
            return m.end(), p
    points = line_points(line)
    return len(line) - len(line.lstrip()) if points else 0, points


def code_runs(text: str) -> list[Range]:
    """Runs of code lines, and member lines and blanks between them, with two points or more."""
    out, at, run, points = [], 0, None, 0
    for line in [*text.split("\n"), None]:
        begins, p = (0, -1) if line is None else code_from(line)
        inside = run is not None and line is not None and (not line.strip() or is_member(line) or line[:1] in " \t}")
        if line is not None and (p > 0 or inside):
            if run is None:
                run, points = [at + (begins if line[:begins].strip() else 0), at], 0
            points += max(p, 0)
            if line.strip():
                run[1] = at + len(line)
        elif run is not None:
            if points >= 2:
                out.append((run[0], run[1]))
            run = None
        at += len(line or "") + 1
    return out


def subtracted(ranges: Iterable[Range], holes: Iterable[Range]) -> list[Range]:
    """What of the ranges is outside the holes."""
    holes, out = sorted(holes), []
    for a, b in sorted(ranges):
        for x, y in holes:
            if y <= a or x >= b:
                continue
            if a < x:
                out.append((a, x))
            a = max(a, y)
        if a < b:
            out.append((a, b))
    return out


def all_code(text: str) -> list[Range]:
    """Marked regions, and runs outside them."""
    marked = code_regions(text)
    return sorted(marked + subtracted(code_runs(text), marked))


# ---- languages

# Languages and the labels of fences that name them.
LABELS = {
    "javascript": "js jsx mjs cjs node", "typescript": "ts tsx mts", "python": "py python3 py3 ipython", "csharp": "cs c# dotnet", "java": "", "kotlin": "kt kts", "go": "golang", "rust": "rs", "php": "",
    "cpp": "c++ cc cxx hpp hh", "c": "h", "ruby": "rb rake gemspec", "swift": "", "sql": "mysql postgresql postgres psql plsql tsql sqlite", "bash": "sh shell zsh console shellscript", "powershell": "ps ps1 pwsh",
    "r": "rscript", "dart": "flutter", "scala": "sc", "lua": "", "perl": "pl pm", "haskell": "hs", "elixir": "ex exs", "erlang": "erl", "julia": "jl", "objectivec": "objc objective-c mm", "vbnet": "vb vb.net visualbasic",
    "fsharp": "fs f# fsx", "groovy": "gradle", "clojure": "clj cljs edn", "ocaml": "ml", "matlab": "octave", "fortran": "f90 f95 f03", "delphi": "pas pascal dpr lazarus", "x86asm": "asm nasm assembly masm", "ada": "adb ads",
    "lisp": "elisp emacs-lisp commonlisp cl", "scheme": "scm racket rkt", "prolog": "", "smalltalk": "st", "tcl": "tk", "vbscript": "vbs", "d": "dlang", "nim": "", "crystal": "cr", "elm": "", "haxe": "hx", "coffeescript": "coffee",
    "vhdl": "vhd", "verilog": "v sv systemverilog",
}
#: Formats whose labels are known besides; they have no signals.
FORMATS = {"html": "htm", "css": "", "json": "", "yaml": "yml"}
_LABEL = {label: name for name, labels in (LABELS | FORMATS).items() for label in (name, *labels.split())}
#: How code in a language looks, as we describe it: words that lines begin with, what begins
#: a comment, lines that close a block, pieces of text that hardly any other language has
#: (~ is a blank), and whether statements end in semicolons. Of these rows all else is derived.
GRAMMARS = {
    "python": ("def class import from elif except return with for while try raise", "#", "", "self. None __init__ ):", False),
    "javascript": ("const let var function return for import export class async if", "//", "} });", "=> === console. function( document. window.", True),
    "typescript": ("const let interface type export import enum class function readonly private", "//", "} });", ":string :number :boolean :void => readonly", True),
    "java": ("public private protected package import class return for if final", "//", "}", "System.out new @Override String[] throws void", True),
    "csharp": ("using namespace public private protected internal class return foreach if", "//", "}", "get; set; Console. async string var", True),
    "go": ("package import func type return for if var defer go", "//", "}", ":= fmt. err!=nil chan []string map[string]", False),
    "rust": ("fn let use pub impl struct enum mod match for", "//", "}", "println! vec![ &mut ->Result &str let~mut ::new( unwrap()", True),
    "kotlin": ("fun val var class import package data when object override", "//", "}", "println( ?. !! fun val :String :Int", False),
    "php": ("echo function class use namespace public return foreach if", "//", "}", "<?php $this-> array( echo =>", True),
    "cpp": ("#include using template class struct namespace return for int auto", "//", "};", "std:: cout<< <vector> <iostream> template< ::", True),
    "c": ("#include #define int void char struct return for static typedef", "//", "}", "printf( .h> malloc( char* sizeof( NULL", True),
    "ruby": ("def class module require attr_accessor puts end unless elsif begin", "#", "end", "puts .each nil? @ do| :", False),
    "swift": ("import func let var guard struct class enum extension protocol", "//", "}", "guard~let if~let ->String @State nil ??", False),
    "sql": ("select from where insert update create group order join left delete", "--", ");", "select from where group~by order~by insert~into", True),
    "bash": ("echo export if then fi for do done cd sudo case", "#", "fi done esac", "$( ${ ]]; $1 |grep", False),
    "powershell": ("param function if foreach Write-Host Get-Content Import-Module try", "#", "}", "Write- Get- $_ -eq $true [string]", False),
    "r": ("library function if for source require", "#", "}", "<- %>% c( data.frame( TRUE", False),
    "dart": ("import void class final return Widget late", "//", "}", "package: @override Widget StatelessWidget setState(", True),
    "scala": ("object def val var class trait import package case", "//", "}", "case~class extends~App => :Int= List( Option[", False),
    "lua": ("local function if end elseif for return repeat until", "--", "end", "local ~= .. nil then ipairs", False),
    "perl": ("use my sub package foreach unless print if", "#", "}", "my~$ my~@ =~ ->{ use~strict @_", True),
    "haskell": ("module import data type instance where newtype class deriving", "--", "", "::IO <- >>= where -> Maybe qualified", False),
    "elixir": ("defmodule def defp use alias import case end", "#", "end", "|> do: IO. %{ defp ->", False),
    "erlang": ("-module -export -include -spec -record", "%", "", "io:format -> -export ). ++", False),
    "julia": ("function using end struct for module mutable", "#", "end", "::Int ::Float64 println( .+ end", False),
    "objectivec": ("#import @interface @implementation @property @end", "//", "@end", "NSString NSLog( alloc] @\" @end", True),
    "vbnet": ("Imports Public Dim End Sub Function If Private", "'", "End~Sub End~Function", "As~String As~Integer End~If ByVal Handles", False),
    "vbscript": ("Dim Set Option WScript.Echo MsgBox End Sub", "'", "End~Sub", "CreateObject( WScript. MsgBox vbCrLf", False),
    "fsharp": ("let open module type match member namespace", "//", "", "|> printfn -> let~mutable |", False),
    "groovy": ("def apply dependencies plugins repositories implementation task", "//", "}", "println apply~plugin: implementation~' it. mavenCentral()", False),
    "clojure": ("(ns (defn (def (let (defmacro (:require", ";", "", "(ns (defn (:require [] #(", False),
    "ocaml": ("let open module type match and", "(*", ";;", "let~rec -> ;; Printf. | List.", False),
    "matlab": ("function end for plot clear clc figure", "%", "end", "zeros( disp( linspace( .* ... end;", True),
    "fortran": ("program subroutine implicit integer real end do call print use", "!", "end", "implicit~none :: end~program end~do write(*", False),
    "delphi": ("unit uses program begin procedure function var end. interface", "//", "end; end.", ":= WriteLn( end. begin TForm", True),
    "x86asm": ("section global mov push call int jmp xor", ";", "ret", "eax rax .text _start 0x80 rsp", False),
    "ada": ("with use procedure begin end package function is", "--", "end", "Put_Line Ada.  is Integer~range end~loop", True),
    "lisp": ("(defun (defvar (setf (defmacro (format (let", ";", "", "(defun (setf (format~t (car", False),
    "scheme": ("(define (display (let (lambda #lang (cond", ";", "", "(define~( (display (cond call/cc racket", False),
    "prolog": (":- ?-", "%", "", ":- ?- use_module( ), is", False),
    "smalltalk": ("Transcript Object ^self |", '"', "!", "ifTrue: show: subclass: ^self value:", False),
    "tcl": ("proc set puts foreach package expr", "#", "}", "[expr puts~$ set proc [list", False),
    "d": ("import module void auto immutable struct unittest", "//", "}", "std. writeln( immutable foreach( .length", True),
    "nim": ("proc import echo var let type template", "#", "", "echo seq[ strutils ref~object", False),
    "crystal": ("require property getter def class struct end", "#", "end", "Int32 :String Array(", False),
    "elm": ("module import type main view update", "--", "", "exposing Html. type~alias ->Msg |>", False),
    "haxe": ("package import class static function var trace", "//", "}", "trace( class~Main static~function~main ->Void haxe.", True),
    "coffeescript": ("class unless module.exports require", "#", "", "-> => @ unless ?", False),
    "vhdl": ("library use entity architecture signal port begin process end", "--", "end", "std_logic ieee rising_edge <= architecture", True),
    "verilog": ("module input output reg wire always assign endmodule", "//", "endmodule", "posedge input~wire output~reg always~@ endmodule <=", True),
}
#: Points that make a guess, its lead over the next, and how alike first words make relatives.
ENOUGH, LEAD, RELATED = 1.5, 0.4, 0.3
_FIRST = re.compile(r"^\s*((?:[-#@(:?^]{1,2})?[^\W\d][\w.-]*|[:?]-)", re.M)


@functools.cache
def _grammars() -> tuple:
    """(weights of first words by word and language, weights of marks, relatives)."""
    heads: dict[str, list[str]] = {}
    marks: dict[str, list[str]] = {}
    for name, (words, _, _, pieces, _) in GRAMMARS.items():
        for w in words.split():
            heads.setdefault(w, []).append(name)
        for m in pieces.split():
            marks.setdefault(m, []).append(name)
    own = {name: set(g[0].split()) for name, g in GRAMMARS.items()}
    near = {(a, b) for a in own for b in own if len(own[a] & own[b]) > RELATED * len(own[a] | own[b])}
    find = [(re.compile(_piece(m)), names) for m, names in marks.items()]
    return heads, find, near


def _piece(mark: str) -> str:
    """A mark as a pattern: blanks may stand between its words and signs, and must where it has a ~."""
    parts = re.findall(r"\w+|[^\w]", mark)
    edge = r"(?<![\w$])" if parts[0][0].isalnum() else ""
    tail = r"(?![\w])" if parts[-1][-1].isalnum() else ""
    return edge + "".join(r"\s+" if p == "~" else re.escape(p) + (r"[ \t]*" if k + 1 < len(parts) and parts[k + 1] != "~" and (p[-1].isalnum() != parts[k + 1][0].isalnum()) else "") for k, p in enumerate(parts)) + tail


def evidence(code: str) -> dict[str, float]:
    """Points of each language. A line's first word, a mark, a comment or a closing line
    counts once, and less the more languages have it."""
    heads, marks, _ = _grammars()
    points = dict.fromkeys(GRAMMARS, 0.0)
    first = set(_FIRST.findall(code))
    for word in first:
        names = heads.get(word) or heads.get(word.lower() if word.isupper() else "") or ()
        for n in names:
            points[n] += 1.0 / len(names) ** 0.5
    for p, names in marks:
        if p.search(code):
            for n in names:
                points[n] += 1.0 / len(names) ** 0.5
    lines = [x.strip() for x in code.split("\n") if x.strip() and not x.startswith("```")]
    ended = sum(x.endswith(";") for x in lines) * 3 > len(lines)
    for name, (_, comment, ends, _, semicolons) in GRAMMARS.items():
        points[name] += 0.25 * any(x.startswith(comment) for x in lines) + 0.25 * any(x.rstrip(";") == e.replace("~", " ") for x in lines for e in ends.split())
        points[name] -= 1.0 * (ended and not semicolons)
    return points


def language_of(code: str, label: str = "") -> tuple[str, float]:
    """(language or unknown, confidence): a known label decides; else the language with the
    most points, if it leads all that are not its relatives."""
    name = re.split(r"[\s{,]", label.strip().lower())[0]
    if name in _LABEL:
        return _LABEL[name], 1.0
    points, near = evidence(code), _grammars()[2]
    lang = max(points, key=lambda k: (points[k], k))
    best = points[lang]
    rival = max((v for k, v in points.items() if k != lang and (k, lang) not in near), default=0.0)
    if best < ENOUGH or best - rival < LEAD:
        return "unknown", 0.0
    return lang, min(1.0, 0.55 + 0.08 * best + 0.05 * (best - rival))


SURE = 0.85


def languages(text: str) -> list[tuple[int, int, str]]:
    """Each region with its language; unknown ones take the only language that others have for sure."""
    labels = {(a, b): label for a, b, label in fenced(text)}
    found = [(a, b, *language_of(text[a:b], labels.get((a, b), ""))) for a, b in all_code(text)]
    sure = {lang for _, _, lang, c in found if c >= SURE}
    shared = sure.pop() if len(sure) == 1 else "unknown"
    return [(a, b, shared if lang == "unknown" else lang) for a, b, lang, _ in found]


#: Signals of libraries; any one is enough.
PROFILES = {
    "react": [r"\bfrom ['\"]react['\"]", r"\buseState\("], "vue": [r"\bfrom ['\"]vue['\"]", r"\bdefineComponent\("], "angular": [r"@angular/"], "express": [r"\brequire\(['\"]express['\"]\)", r"\bexpress\(\)"],
    "node": [r"\brequire\(['\"](?:fs|path|http|os)['\"]\)", r"\bprocess\.env\b"], "jest": [r"\bdescribe\(.*\bit\(|\bexpect\(.*\)\.to[A-Z]"], "django": [r"\bfrom django\b"], "flask": [r"\bfrom flask\b", r"@app\.route\("],
    "pandas": [r"\bimport pandas\b", r"\bpd\.DataFrame\b"], "numpy": [r"\bimport numpy\b", r"\bnp\.array\("], "pytest": [r"\bimport pytest\b"], "spring": [r"\borg\.springframework\b", r"@(?:Autowired|RestController)\b"],
    "junit": [r"\borg\.junit\b"], "aspnet": [r"\bMicrosoft\.AspNetCore\b"], "efcore": [r"\bDbContext\b"], "gin": [r"github\.com/gin-gonic/gin"], "serde": [r"\bserde::", r"#\[derive\(.*Serialize"],
}
#: One of these stands in each text that a profile's patterns match; looked for first.
PROFILE_NEEDS = {
    "react": ["react", "useState("], "vue": ["vue", "defineComponent("], "angular": ["@angular/"], "express": ["express"], "node": ["require(", "process.env"], "jest": ["describe(", "expect("], "django": ["from django"],
    "flask": ["from flask", "@app.route("], "pandas": ["import pandas", "pd.DataFrame"], "numpy": ["import numpy", "np.array("], "pytest": ["import pytest"], "spring": ["org.springframework", "@Autowired", "@RestController"],
    "junit": ["org.junit"], "aspnet": ["Microsoft.AspNetCore"], "efcore": ["DbContext"], "gin": ["github.com/gin-gonic/gin"], "serde": ["serde::", "#[derive("],
}
