"""Tokens of code in any of the languages: a pushdown lexer, linear in the code.

A stack of modes says what ends what: code within an interpolation ends at the
bracket that opened it, however deep brackets, strings and further interpolations
are nested; comments nest in the languages that let them.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

# What begins and ends comments, by language; every other language has those of C.
HASH = {"python", "ruby", "bash", "yaml", "powershell", "r", "perl", "elixir", "julia", "nim", "crystal", "coffeescript", "tcl"}
DASH = {"sql", "haskell", "lua", "elm", "ada", "vhdl"}
SEMICOLON = {"lisp", "scheme", "clojure", "x86asm"}
PERCENT = {"erlang", "prolog", "matlab"}
BLOCKS = {"haskell": ("{-", "-}"), "elm": ("{-", "-}"), "ocaml": ("(*", "*)"), "fsharp": ("(*", "*)"), "julia": ("#=", "=#"), "lua": ("--[[", "]]"), "powershell": ("<#", "#>"), "lisp": ("#|", "|#"), "scheme": ("#|", "|#"), "nim": ("#[", "]#")}
NESTED = {"rust", "swift", "kotlin", "scala", "dart", "haskell", "elm", "ocaml", "fsharp", "julia", "lisp", "scheme", "nim"}
# Quotes: three of them for texts of several lines, backticks, and whether ' is for single characters.
TRIPLE = {"python": ('"""', "'''"), "dart": ('"""', "'''"), **dict.fromkeys(("kotlin", "swift", "scala", "java", "julia", "elixir", "groovy", "csharp", "nim", "coffeescript", "crystal"), ('"""',))}
BACKTICK = {"javascript", "typescript", "go", "unknown"}
CHARACTER = {"rust", "c", "cpp", "java", "csharp", "kotlin", "scala", "haskell", "ocaml", "swift", "ada", "elm", "d", "erlang", "lisp", "scheme", "clojure", "verilog", "vhdl"}
# What opens code within a string; NAMED: a $ alone is followed by a name.
OPENERS = {
    "javascript": ("${",), "typescript": ("${",), "unknown": ("${",), "kotlin": ("${",), "dart": ("${",), "scala": ("${",), "groovy": ("${",), "php": ("{$", "${"), "perl": ("${", "@{"), "bash": ("${", "$("), "powershell": ("$(",), "ruby": ("#{",), "crystal": ("#{",),
    "coffeescript": ("#{",), "elixir": ("#{",), "swift": ("\\(",), "julia": ("$(",), "python": ("{",), "csharp": ("{",),
}
NAMED = {"kotlin", "dart", "scala", "groovy", "php", "perl", "bash", "powershell", "julia"}
SIGNS = "=== !== ... ?. => -> :: == != <= >= += -= *= /= := && || ?? ** <- |> =~ ~= ++ --".split()
_CLOSE = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str  # name, number, string, comment, sign or line
    start: int
    end: int
    text: str


@functools.cache
def _code(language: str) -> re.Pattern:
    """What comes next in code."""
    line = "#" if language in HASH else "--" if language in DASH else ";" if language in SEMICOLON else "%" if language in PERCENT else None
    block = BLOCKS.get(language) or (None if line else ("/*", "*/"))
    comments = [re.escape(block[0])] if block else []
    lines = [re.escape(line) if line else "//"] + (["#"] if language == "php" else [])
    quotes = [*TRIPLE.get(language, ()), '"', "'", *(["`"] if language in BACKTICK else [])]
    parts = [
        *([rf"(?P<block>{'|'.join(comments)})"] if comments else []), rf"(?P<comment>(?:{'|'.join(lines)})[^\n]*)",
        *([r"(?P<char>'(?:\\.[^'\n]{0,8}|[^'\\\n])')", r"(?P<life>'[^\W\d]\w*)"] if language in CHARACTER else []),
        rf"(?P<string>(?:[fFrRbBuU]{{1,2}}|[$@]{{1,2}}|[sf])?(?:{'|'.join(re.escape(q) for q in quotes)}))",
        r"(?P<name>[@$]?[^\W\d][\w$]*|\$)", r"(?P<number>\d[\w.]*)", r"(?P<line>\n)", "(?P<sign>" + "|".join(re.escape(s) for s in SIGNS) + r"|[^\s\w])",
    ]
    return re.compile("|".join(parts))


@functools.cache
def _text(quote: str, openers: tuple[str, ...], named: bool, raw: bool, doubled: bool) -> re.Pattern:
    """What comes next in a string: an escape, an interpolation, its end."""
    parts = [rf"(?P<end>{re.escape(quote)})"]
    if doubled:
        parts.insert(0, rf"(?P<twice>{re.escape(quote) * 2})")
    if openers:
        parts.insert(0, "(?P<open>" + "|".join(re.escape(o) for o in openers) + ")")
        if "{" in openers:
            parts.insert(0, r"(?P<brace>\{\{)")
    if named:
        parts.append(r"\$(?P<name>[^\W\d]\w*)")
    if not raw:
        parts.append(r"(?P<escape>\\.)")
    if len(quote) == 1 and quote != "`":
        parts.append(r"(?P<cut>\n)")
    return re.compile("|".join(parts), re.S)


def _string(language: str, begin: str) -> tuple[str, re.Pattern]:
    """The quote of a string that begins so, and what may come in it."""
    quote = begin.lstrip("fFrRbBuU$@s") if begin not in ("'", '"') else begin
    prefix = begin[: len(begin) - len(quote)]
    openers: tuple[str, ...] = OPENERS.get(language, ())
    if language == "python" and "f" not in prefix.lower() or language == "csharp" and "$" not in prefix or language == "scala" and not prefix:
        openers = ()
    if language in ("javascript", "typescript", "unknown") and quote != "`" or quote == "'" and language in ("php", "perl", "bash", "ruby", "groovy", "powershell", "crystal", "coffeescript", "elixir", "julia"):
        openers = ()
    raw = "r" in prefix.lower() or "@" in prefix or language == "go" and quote == "`" or quote == "'" and language in ("bash", "sql")
    return quote, _text(quote, openers, bool(openers) and language in NAMED, raw, "@" in prefix or language == "sql" or language in ("vbnet", "delphi", "ada"))


def tokens(code: str, language: str = "unknown") -> list[Token]:
    """All tokens of the code but blanks. A string is a token for each piece between interpolations;
    what is in these are tokens of code."""
    out: list[Token] = []
    pattern = _code(language)
    block = BLOCKS.get(language, ("/*", "*/"))
    stack: list[list] = []  # strings that are open: [pattern, closing bracket of the interpolation, depth of it]
    at = 0
    while at < len(code):
        m = pattern.search(code, at)
        if m is None:
            break
        kind, at = m.lastgroup, m.end()
        if kind == "block":
            depth, edge = 1, re.compile("|".join(re.escape(b) for b in block))
            while depth and (e := edge.search(code, at)):
                depth, at = depth + (1 if e[0] == block[0] and language in NESTED else -1 if e[0] == block[1] else 0), e.end()
            at = len(code) if depth else at
            out.append(Token("comment", m.start(), at, code[m.start() : at]))
            continue
        if kind == "string":
            stack.append([_string(language, m[0])[1], None, 0])
            at = _piece(code, m.start(), at, stack, out)
            continue
        if kind in ("char", "life"):
            kind = "string" if kind == "char" else "sign"
        start = m.start()
        if kind == "name" and m[0][0] in "@$" and len(m[0]) > 1:
            out.append(Token("sign", start, start + 1, m[0][0]))
            start += 1
        if kind == "sign" and stack and stack[-1][1]:
            top = stack[-1]
            if m[0] == top[1] and not top[2]:
                top[1] = None
                at = _piece(code, m.start(), at, stack, out)
                continue
            top[2] += (_CLOSE.get(m[0]) == top[1]) - (m[0] == top[1])
        out.append(Token(kind, start, at, code[start:at]))
    return out


def _piece(code: str, start: int, at: int, stack: list[list], out: list[Token]) -> int:
    """Go on in the string on top, from after its quote or an interpolation, to its end or the next one."""
    top = stack[-1]
    while True:
        m = top[0].search(code, at)
        if m is None or m.lastgroup in ("end", "cut"):
            at = len(code) if m is None else m.end() if m.lastgroup == "end" else m.start()
            out.append(Token("string", start, at, code[start:at]))
            stack.pop()
            return at
        at = m.end()
        if m.lastgroup == "open":
            out.append(Token("string", start, at, code[start:at]))
            top[1], top[2] = _CLOSE[m[0].strip("$#@\\")[0]], 0
            return at
        if m.lastgroup == "name":
            out.append(Token("string", start, m.start("name"), code[start : m.start("name")]))
            out.append(Token("name", m.start("name"), at, m["name"]))
            start = at
