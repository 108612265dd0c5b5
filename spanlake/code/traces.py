"""Error output: stack traces and compiler messages, their names and places.

Each line is read by what it begins with: an indented "at", a quoted file, a
place in a file, a head that a runtime writes, or the name of something thrown.
A place is read by one rule wherever it stands. Lines that say little by
themselves (gutters, carets, details, calls above a Go place) count beside
others only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: A file with an extension and a line: a.py:3, a.ts(3,5), A.cs:line 3.
PLACE = re.compile(r"(?:file://)?(?P<path>(?:[A-Za-z]:[\\/])?[^:\"()<>|*?\n]*?[^\s:\"()<>|*?/\\]\.[A-Za-z]\w*)(?::(?:line )?\d+(?::\d+)?|:? ?\(\d+(?:,\s?\d+)*\))")
NAME = re.compile(r"[\w$<>.:/~\[\]@`*{}#,-]+")
WORD = re.compile(r"[^\W\d][\w$]*")
# What the names of thrown types end in, and what may stand before them.
THROWN = ("Error", "Exception", "Exit", "Interrupt", "Throwable", "Panic", "Fault")
BEFORE_THROWN = ("Caused by: ", "Suppressed: ", "Uncaught ", "(in promise) ", "Unhandled exception. ", "Unhandled Exception: ", "---> ", "[cause]: ")
# Lines that Python and Rust write as they are.
HEADS = (
    "Traceback (most recent call last):",
    "During handling of the above exception, another exception occurred:",
    "The above exception was the direct cause of the following exception:",
    "stack backtrace:",
)
SEVERITIES = ("fatal error", "error", "warning")
#: Any text with a line that is evidence by itself has one of these.
HINTS = r'Traceback|above exception|File "|^\s+at |[Pp]anic|goroutine|stack backtrace|[Ww]arning|[Ee]rror|' + "|".join(t for t in THROWN if t not in ("Error", "Panic")) + r"|\.go:\d|^[ew]: |-->"
HINT = re.compile(HINTS, re.M)
LIBRARY = re.compile(r"node_modules|site-packages|dist-packages|/usr/lib|/rustc/|\.cargo|/usr/local/go/|<frozen|\bnode:|^(?:java|javax|jdk|sun|kotlin|scala|org\.(?:junit|springframework|apache)|System|Microsoft|runtime|std|core|alloc)[.:/]")
QUOTES = {"'": "'", '"': '"', "`": "`", "‘": "’", "“": "”"}


@dataclass(frozen=True)
class Slot:
    start: int
    end: int
    name: str
    kind: str  # function, path, type or mention
    library: bool


@dataclass
class Line:
    """What a line of error output holds. weak: it is none without its neighbours."""

    parts: list[tuple[int, int, str]] = field(default_factory=list)
    weak: bool = False
    echo: bool = False  # a line of source may follow


def _named(line: str, start: int, end: int, kind: str) -> tuple[int, int, str]:
    text = line[start:end]
    return start + len(text) - len(text.lstrip()), end - (len(text) - len(text.rstrip())), kind


def _place(line: str, start: int, end: int | None = None) -> tuple[int, int, str] | None:
    """The path of a place that makes up line[start:end]."""
    m = PLACE.fullmatch(line, start, len(line.rstrip()) if end is None else end)
    return m and (m.start("path"), m.end("path"), "path")


def _at(line: str) -> Line | None:
    """Frames of JavaScript, Java, .NET and Mono, and places in Rust backtraces."""
    start = len(line) - len(line.lstrip())
    if not start or not line.startswith("at ", start):
        return None
    start += 3
    for word in ("async ", "new "):
        start += len(word) * line.startswith(word, start)
    if place := _place(line, start):
        return Line([place])
    opened = line.find("(", start)
    if opened < 0:
        return None
    name_end = opened
    if line[start:opened].rstrip().endswith("]") and " [as " in line[start:opened]:
        name_end = line.index(" [as ", start)
    name = _named(line, start, name_end, "function")
    if not NAME.fullmatch(line, name[0], name[1]):
        return None
    closed = line.rfind(")")
    inner = line[opened + 1 : closed] if closed > opened else ""
    after = line[line.find(")", opened) + 1 :]
    if " in " in after:  # .NET and Mono: the place stands behind the parameters
        at = len(line) - len(after) + after.index(" in ") + 4
        place = _place(line, at)
        return Line([name, place]) if place else None
    if place := _place(line, opened + 1, closed):
        return Line([name, place])
    if inner in ("Native Method", "Unknown Source", "native", "<anonymous>"):
        return Line([name])
    if re.fullmatch(r"[\w$-]+\.\w+", inner) and inner.rpartition(".")[2] in ("java", "kt", "scala", "groovy", "clj"):
        return Line([name, (opened + 1, closed, "path")])
    dotted = "." in line[name[0] : name[1]]
    return Line([name]) if dotted and line.rstrip().endswith(")") else None


def _python(line: str) -> Line | None:
    start = len(line) - len(line.lstrip())
    if not line.startswith('File "', start):
        return None
    end = line.find('"', start + 6)
    where = re.fullmatch(r", line \d+(?:, in (.+?))?\s*", line[end + 1 :]) if end > 0 else None
    if not where:
        return None
    parts = [(start + 6, end, "path")]
    if where[1] and where[1] != "<module>":
        parts.append((end + 1 + where.start(1), end + 1 + where.end(1), "function"))
    return Line(parts, echo=True)


def mentions(line: str, start: int) -> Iterator[tuple[int, int, str]]:
    """Names that a message quotes, or states after a colon as compilers do."""
    i = start
    while i < len(line):
        if line[i] in QUOTES:
            end = line.find(QUOTES[line[i]], i + 1)
            name = line[i + 1 : end].removesuffix("()") if end > 0 else ""
            if name and all(WORD.fullmatch(p) for p in re.split(r"\.|::", name)):
                yield i + 1, i + 1 + len(name), "mention"
                i = end
        i += 1
    for lead in ("undefined: ", "nresolved reference: ", "nresolved reference "):
        at = line.find(lead, start)
        m = WORD.match(line, at + len(lead)) if at >= 0 else None
        if m:
            yield m.start(), m.end(), "mention"
            break


def _message(line: str) -> Line | None:
    """A compiler's message: a place, a severity with or without a code, and what is wrong."""
    start = 3 if line[:3] in ("e: ", "w: ") else 0
    place = PLACE.match(line, start)
    at = place.end() if place else start
    if place:
        at += len(re.match(r"(?::| -)? ?", line[at:])[0])
    severity = next((s for s in SEVERITIES if line.startswith(s, at)), None)
    if severity:
        rest = re.match(r"(?:\[[\w-]+\]| [A-Z]+\d+)?: ", line[at + len(severity) :])
        if not rest:
            return None
        coded = len(rest[0]) > 2
        at += len(severity) + len(rest[0])
    elif not (place and (start or place["path"].endswith(".go"))):
        return None
    parts = [(place.start("path"), place.end("path"), "path")] if place else []
    return Line([*parts, *mentions(line, at)], weak=not place and not coded, echo=bool(place))


def _thrown(line: str) -> Line | None:
    """A type that is thrown, with or without a message."""
    at, found = len(line) - len(line.lstrip()), True
    if line.startswith('Exception in thread "', at):
        at = line.find('" ', at + 21) + 2
        if at < 2:
            return None
    while found:
        found = next((b for b in BEFORE_THROWN if line.startswith(b, at)), "")
        at += len(found)
    m = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*").match(line, at)
    if not m or not m[0].endswith(THROWN) or line[m.end() :].strip() and line[m.end()] != ":":
        return None
    if at and at == len(line) - len(line.lstrip()):  # indented, as the text of something else
        return None
    return Line([(m.start(), m.end(), "type"), *mentions(line, m.end())])


def _go_or_rust(line: str, following: str) -> Line | None:
    for head in ("panic: ", "fatal error: "):
        if line.startswith(head):
            return Line(list(mentions(line, len(head))))
    if line.startswith("goroutine ") and line.rstrip().endswith("]:") or line.startswith("[signal "):
        return Line(weak=line[0] == "[")
    if line.startswith("thread '") and "' panicked at " in line:
        at = line.index("' panicked at ") + 14
        m = PLACE.match(line, at)
        return Line([(m.start("path"), m.end("path"), "path")] if m else list(mentions(line, at)))
    if line[:1] == "\t":
        m = PLACE.match(line, 1)
        if m and m["path"].endswith(".go") and re.fullmatch(r"(?: \+0x[0-9a-f]+)?\s*", line[m.end() :]):
            return Line([(m.start("path"), m.end("path"), "path")], echo=True)
    if following[:1] == "\t" and ".go:" in following:  # a call stands above its place
        made = len("created by ") * line.startswith("created by ")
        end = line.rfind("(") if line.rstrip().endswith(")") else (line.find(" in goroutine ") + 1 or len(line) + 1) - 1
        if end > made and NAME.fullmatch(re.sub(r"[(*)]", "", line[made:end]) or " "):
            return Line([(made, end, "function")], weak=True)
    entry = re.match(r"\s+\d+:\s+(?:0x[0-9a-f]+ - )?", line)
    if entry and line[entry.end() :].strip():
        return Line([_named(line, entry.end(), len(line), "function")], weak=True)
    arrow = len(line) - len(line.lstrip())
    if line.startswith("--> ", arrow) and (place := _place(line, arrow + 4)):
        return Line([place], echo=True)
    return None


def _beside(line: str) -> Line | None:
    """Lines that go on with what is above them."""
    bare = line.strip()
    if re.match(r"\d*\s*\|", bare):
        return Line(weak=True, echo=True)
    if bare and set(bare) <= set("^~ -") and set(bare) & set("^~"):
        return Line(weak=True)
    if bare.startswith(("= note:", "= help:", "note: run with `RUST_BACKTRACE", "--- End of ", "[Previous line repeated ", "Node.js v")):
        return Line(weak=True)
    if bare.startswith("... ") and bare.endswith((" more", " common frames omitted")):
        return Line(weak=True)
    if line[:1].isspace() and bare.startswith(("symbol:", "location:")):
        words = list(WORD.finditer(line))
        kinds = [m[0] for m in words]
        # symbol: variable x, symbol: method f(int), location: class C
        if len(words) > 2 and kinds[1] in ("variable", "method", "class", "interface", "enum", "record", "constructor"):
            return Line([(words[2].start(), words[2].end(), "mention")], weak=True)
        return Line(weak=True)
    if (place := _place(line, 0)) and re.search(r"[\\/]", line[place[0] : place[1]]):
        return Line([place], weak=True, echo=True)
    return None


def read(line: str, following: str = "") -> Line | None:
    """A line as error output; null if it is none. following: the next line."""
    bare = line.rstrip("\r")
    if bare.strip() in HEADS:
        return Line()
    return _python(bare) or _at(bare) or _go_or_rust(bare, following) or _message(bare) or _thrown(bare) or _beside(bare)


def _lines(text: str) -> Iterator[tuple[int, str, Line | None]]:
    at, lines = 0, text.split("\n")
    for i, line in enumerate(lines):
        yield at, line, read(line, lines[i + 1] if i + 1 < len(lines) else "")
        at += len(line) + 1


def _runs(text: str) -> Iterator[list[tuple[int, str, Line]]]:
    """Runs of lines of error output of which one is evidence by itself."""
    run: list[tuple[int, str, Line]] = []
    for at, line, found in [*_lines(text), (len(text) + 1, "", None)]:
        if found is None and run and run[-1][2].echo and line[:1].isspace():
            found = Line(weak=True)
        if found is not None:
            run.append((at, line, found))
        else:
            if any(not x.weak for _, _, x in run):
                yield run
            run = []


def error_regions(text: str) -> list[tuple[int, int]]:
    """Where error output stands, in whole lines."""
    if not HINT.search(text):
        return []
    return [(run[0][0], run[-1][0] + len(run[-1][1])) for run in _runs(text)]


def error_slots(text: str) -> list[Slot]:
    """Functions, paths, exception types and quoted names in error output."""
    if not HINT.search(text):
        return []
    out = []
    for run in _runs(text):
        for i, (at, line, found) in enumerate(run):
            names = [(a, b, kind, line[a:b]) for a, b, kind in found.parts]
            library = any(kind in ("function", "path") and LIBRARY.search(name) for _, _, kind, name in names)
            if found.weak and i + 1 < len(run):  # a call is where the line below it says
                library = library or any(kind == "path" and LIBRARY.search(run[i + 1][1][a:b]) for a, b, kind in run[i + 1][2].parts)
            out += [Slot(at + a, at + b, name, kind, library and kind in ("function", "path", "type")) for a, b, kind, name in names]
    return out


def frames_as_code(text: str) -> str:
    """The calls that a trace names, as code: own frames only."""
    names = [re.split(r"[.:]+", s.name)[-1] for s in error_slots(text) if s.kind == "function" and not s.library]
    return "\n".join(f"{n}();" for n in dict.fromkeys(names) if re.fullmatch(r"[^\W\d]\w*", n))
