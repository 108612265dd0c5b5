"""Identifiers: their words, views of texts with words apart, and spans within them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

IDENTIFIER = re.compile(r"[^\W\d][\w$]*|\$[\w$]+")
WORD_EDGE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

#: Words that say nothing about anybody; our own list.
GENERIC = set(
    "get set is has add new old id ids key keys val value values name names type types item items list map data info user users file files path node text line lines "
    "count size index total start end begin first last next prev max min sum avg tmp temp test tests main init load save read write open close create update delete remove "
    "find search sort filter parse format print log error errors result results response request handler service client server config options settings state props event events "
    "date time day month year hour page row rows col cols column columns table field fields string number bool int float double char byte array object class function method".split()
)


def words(identifier: str) -> list[str]:
    """snake, camel and Pascal case taken apart."""
    return [w for part in re.split(r"[_$]+", identifier) for w in WORD_EDGE.split(part) if w]


def split_view(text: str, regions: Iterable[tuple[int, int]]) -> tuple[str, list[int]]:
    """The text with identifiers in regions cut to words (_ and $ become blanks, a blank goes
    before an upper-case word), and for each place of the view its place in the text."""
    out, places, at = [], [], 0

    def copy(a: int, b: int) -> None:
        out.append(text[a:b])
        places.extend(range(a, b))

    for a, b in sorted(regions):
        for m in IDENTIFIER.finditer(text, max(a, at), b):
            copy(at, m.start())
            edges = {e.start() for e in WORD_EDGE.finditer(m[0])}
            for i, c in enumerate(m[0]):
                if i in edges:
                    out.append(" ")
                    places.append(m.start() + i)
                out.append(" " if c in "_$" else c)
                places.append(m.start() + i)
            at = m.end()
    copy(at, len(text))
    return "".join(out), [*places, len(text)]


def to_original(text: str, places: Sequence[int], spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of a view as ranges of its text, without _ at their edges."""
    out = []
    for a, b in spans:
        if a < b:
            x, y = places[a], places[b - 1] + 1
            while x < y and text[x] == "_":
                x += 1
            while y > x and text[y - 1] == "_":
                y -= 1
            if x < y:
                out.append((x, y))
    return out


def path_view(text: str) -> str:
    """Separators within paths as blanks, so their names stand alone; same length."""
    return re.sub(r"(?:(?<=[\w~.])[\\/](?=[\w.])|(?<![\w:/])[\\/](?=\w+[\\/]))", " ", text)


def whole_identifier(text: str, a: int, b: int) -> tuple[int, int]:
    while a and re.match(r"[\w$]", text[a - 1]):
        a -= 1
    while b < len(text) and re.match(r"[\w$]", text[b]):
        b += 1
    return a, b


def propagated(text: str, regions: Sequence[tuple[int, int]], flagged: Iterable[str]) -> list[tuple[int, int, str]]:
    """Every identifier in code that has a flagged word, wherever it stands: (start, end, word)."""
    want = {w.lower() for w in flagged if len(w) > 2 and w.lower() not in GENERIC}
    out = []
    for a, b in regions:
        for m in IDENTIFIER.finditer(text, a, b):
            for w in words(m[0]):
                if w.lower() in want:
                    at = m.start() + m[0].find(w)
                    out.append((at, at + len(w), w))
    return out


def widened(text: str, regions: Sequence[tuple[int, int]], spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans inside code as whole identifiers, at every place where these stand in code."""
    names = {text[slice(*whole_identifier(text, a, b))] for a, b in spans if any(x <= a < y for x, y in regions)}
    return sorted({m.span() for a, b in regions for m in IDENTIFIER.finditer(text, a, b) if m[0] in names})


def only_generic(text: str, a: int, b: int, in_code: bool, generic: frozenset[str] | set[str] = frozenset(GENERIC)) -> bool:
    """Whether a span has generic words alone and is glued, compound, or in code."""
    parts = [w.lower() for i in IDENTIFIER.findall(text[a:b]) for w in words(i)]
    glued = (a > 0 and re.match(r"[\w$]", text[a - 1])) or (b < len(text) and re.match(r"[\w$]", text[b]))
    return bool(parts) and all(w in generic for w in parts) and bool(in_code or glued or len(parts) > 1)


def takes_bare(text: str, a: int, b: int) -> bool:
    """Whether a replacement at this place must be bare, as within an identifier or an
    attribute; in strings and prose it keeps its brackets."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if re.match(r"[\w$]", before) or re.match(r"[\w$]", after):
        return True
    line = text[text.rfind("\n", 0, a) + 1 : a]
    quoted = any((len(re.findall(rf"(?<!\\){q}", line)) % 2) for q in "\"'`")
    return not quoted and bool(re.match(r"[.(\[:=]", after) or before == ".")
