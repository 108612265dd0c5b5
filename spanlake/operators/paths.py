"""Filesystem paths in texts; an Arrow function, as ends depend on what follows.

Texts without a slash or $HOME are answered natively and never reach Python.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.arrow import arrow
from spanlake import rules
from spanlake.functions.spans import SPANS, no_spans
from spanlake.functions.urls import PUNCTUATION, private_path

URL = re.compile(rules.URL)
PATHS = [re.compile(p) for p in (rules.UNC_PATH, rules.WINDOWS_PATH, rules.UNIX_PATH)]
MORE_WORD = re.compile(r"""^ [^\\/:*?"<>|\s]+""")
EXTENSION = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,4}$")
MORE_WORDS = 5
OPENERS = "\"'`=([{,:;>~"


def trim(s: str) -> str:
    while s and (s[-1] in PUNCTUATION or s[-1] == ")" and s.count("(") < s.count(")")):
        s = s[:-1]
    return s


#: Fixed value: characters that file names can't have.
NOT_IN_NAMES = frozenset("<>|*?\"")


def path_may_start(text: str, at: int) -> bool:
    """At the text's start, after file://, white space, or an opening mark."""
    return at == 0 or text.endswith("file://", 0, at) or text[at - 1].isspace() or text[at - 1] in OPENERS


def extended(text: str, start: int, end: int) -> int:
    """The end of a path whose file name has spaces: up to the closing quote if it is quoted
    and nothing before it that names can't have; else, if the last name has no dot, over at
    most MORE_WORDS words that lead to a file extension."""
    line = text.find("\n", end)
    rest = text[end : line if line >= 0 else len(text)]
    quote = text[start - 1] if start and text[start - 1] in "\"'`" else ""
    if quote:
        close = rest.find(quote)
        if close >= 0 and not set(rest[:close]) & NOT_IN_NAMES:
            return end + close
    name = re.split(r"[\\/]", text[start:end])[-1]
    if not name or "." in name:
        return end
    at = 0
    for _ in range(MORE_WORDS):
        m = MORE_WORD.match(rest[at:])
        if not m:
            break
        at += m.end()
        word = trim(rest[:at])
        if EXTENSION.search(word):
            return end + len(word)
    return end


def path_ranges(text: str) -> list[tuple[int, int]]:
    """Code point ranges of the paths outside links, shares first, then drives, then the rest."""
    taken = [(m.start(), m.start() + len(trim(m[0]))) for m in URL.finditer(text)]
    out: list[tuple[int, int]] = []
    for pattern in PATHS:
        for m in pattern.finditer(text):
            a = m.start()
            b = extended(text, a, a + len(trim(m[0])))
            if b > a and path_may_start(text, a) and not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                out.append((a, b))
    return out


@arrow(SPANS)
def _candidates(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        own = []
        for a, b in path_ranges(text):
            start = len(text[:a].encode())
            own.append({"start": start, "end": start + len(text[a:b].encode()), "entity_type": "FILE_PATH", "score": rules.PATH_SCORE, "text": text[a:b], "source": "regex", "ord": 110})
        out.append(own)
    return pd.Series(out)


def path_candidates(text: Column) -> Column:
    return F.when(text.rlike(r"[/\\]|\$HOME"), _candidates(F.when(text.rlike(r"[/\\]|\$HOME"), text).otherwise(F.lit("")))).otherwise(no_spans())


def private_paths(candidates: Column) -> Column:
    return F.filter(candidates, lambda s: private_path(s["text"]))
