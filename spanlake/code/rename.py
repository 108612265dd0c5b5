"""Own names in code and their aliases: which names are one's own, every place of
them, and one alias for each, everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from spanlake.code import lexicon, symbols, traces
from spanlake.code.identifiers import IDENTIFIER
from spanlake.code.lexer import tokens
from spanlake.code.regions import TAG, languages, subtracted


@dataclass
class Plan:
    roles: dict[str, str] = field(default_factory=dict)
    occurrences: list[tuple[int, int, str]] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)
    identifiers: set[str] = field(default_factory=set)


def inner(text: str, a: int, b: int) -> tuple[int, int]:
    """A region without the lines of its fences or its tags."""
    if text.startswith("<", a) and (m := TAG.match(text, a, b)):
        return m.end(), max(m.end(), text.rfind("<", a, b)) if text[b - 1 : b] == ">" else b
    if text.startswith("```", a):
        first = text.find("\n", a, b)
        a = b if first < 0 else first + 1
        last = text.rfind("\n", a, b)
        if last >= 0 and text[last + 1 : b].strip().strip("`") == "":
            b = last
    return a, b


def telling(name: str) -> bool:
    """Whether a word can hardly be prose."""
    return "_" in name or bool(re.search(r"[a-z][A-Z]", name))


def bodies(text: str, regions: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The code of regions, without fences and tags, and without error output."""
    errors = traces.error_regions(text)
    return [(x, y, lang) for a, b, lang in regions for x, y in subtracted([inner(text, a, b)], errors)]


def framed(text: str) -> list[tuple[traces.Slot, list[tuple[int, str]]]]:
    """What error output names: each slot with the identifiers in it, (place, name)."""
    return [(s, [(m.start(), m[0]) for m in IDENTIFIER.finditer(text, s.start, s.end)]) for s in traces.error_slots(text) if s.kind != "path"]


def names_of(text: str, regions: list[tuple[int, int, str]]) -> dict[str, symbols.Evidence]:
    """The evidence of all of a text's code, and of its own functions in error output."""
    out = symbols.merged([symbols.evidence(text[a:b], lang, a) for a, b, lang in bodies(text, regions)])
    for slot, names in framed(text):
        if slot.kind != "function" or slot.library:
            continue
        for at, name in names:
            role = "function" if (at, name) == names[-1] else "class" if name[:1].isupper() else "namespace"
            e = out.setdefault(name, symbols.Evidence(name, "unknown", at, role))
            e.declared, e.first, e.uses = e.declared or not e.imported, min(e.first, at), e.uses + 1
    return out


def rename_plan(text: str, regions: list[tuple[int, int, str]] | None = None) -> Plan:
    """Own names of the code in a text and every place of them: in code, its comments, and
    in prose where they could be nothing else."""
    found = languages(text) if regions is None else regions
    names = names_of(text, found)
    steps = symbols.decide(names, lexicon.known, set(), set(lexicon.RESERVED))
    regions = bodies(text, found)
    own = {n: role for n, (role, step) in steps.items() if step in ("declared", "undeclared")}
    plan = Plan(own, languages=[lang for _, _, lang in regions])
    taken = set()
    for a, b, lang in regions:
        plan.identifiers |= set(IDENTIFIER.findall(text[a:b]))
        for t in tokens(text[a:b], lang):
            places = [(a + t.start, a + t.end)] if t.kind == "name" else [m.span() for m in IDENTIFIER.finditer(text, a + t.start, a + t.end)] if t.kind == "comment" else []
            for x, y in places:
                if text[x:y] in own and (x, y) not in taken and (t.kind == "name" or telling(text[x:y]) or len(text[x:y]) > 2):
                    taken.add((x, y))
                    plan.occurrences.append((x, y, text[x:y]))
    for _, named in framed(text):
        for x, name in named:
            if name in own and (x, x + len(name)) not in taken:
                taken.add((x, x + len(name)))
                plan.occurrences.append((x, x + len(name), name))
    inside = [(a, b) for a, b, _ in regions]
    for m in IDENTIFIER.finditer(text):
        if m[0] in own and telling(m[0]) and m.span() not in taken and not any(a <= m.start() < b for a, b in inside):
            plan.occurrences.append((*m.span(), m[0]))
    plan.occurrences.sort()
    return plan


#: The word of each role; fixed values.
STEMS = {"class": "Class", "type": "Class", "function": "func", "variable": "var", "constant": "CONST", "parameter": "param", "property": "field", "namespace": "ns"}


def alias(name: str, role: str, index: int) -> str:
    """An alias in the case of the name: var1, _field2, Field3, CONST_4, func_5, Class6."""
    bare = name.lstrip("_")
    lead, word = name[: len(name) - len(bare)], STEMS.get(role, "var")
    if word == "Class":
        return f"{lead}Class{index}"
    if len(bare) > 1 and re.fullmatch(r"[A-Z][A-Z0-9_]*", bare):
        return f"{lead}{word.upper()}_{index}"
    if bare[:1].isupper():
        return f"{lead}{word.capitalize()}{index}"
    return f"{lead}{word.lower()}_{index}" if "_" in bare else f"{lead}{word.lower()}{index}"


def aliases(plan: Plan, taken: set[str] = frozenset()) -> dict[str, str]:
    """One alias for each own name, numbered by first place; none that the text already has."""
    used, out, count = set(taken) | plan.identifiers, {}, 0
    first = dict(reversed([(n, a) for a, _, n in plan.occurrences]))
    for name in sorted(plan.roles, key=lambda n: (first.get(n, 1 << 60), n)):
        role = plan.roles[name]
        while True:
            count += 1
            new = alias(name, role, count)
            if new not in used:
                break
        used.add(new)
        out[name] = new
    return out


def renamed(text: str) -> tuple[str, dict[str, str]]:
    """The text with its own names replaced, and the aliases."""
    plan = rename_plan(text)
    names, out, at = aliases(plan), [], 0
    for a, b, n in plan.occurrences:
        if a >= at:
            out += [text[at:a], names[n]]
            at = b
    return "".join([*out, text[at:]]), names
