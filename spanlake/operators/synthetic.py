"""Stand-ins for links and paths that keep their shape, the same for the same original."""

from __future__ import annotations

import re

import pandas as pd

from spanlake.functions.arrow import arrow

WORDS = "amber birch cedar delta ember fjord grove haven iris jade kelp lotus maple north ocean pearl quartz river slate tulip umber vista willow zephyr".split()
MASK = 0xFFFFFFFF


def seed_of(text: str) -> int:
    """FNV-1a over UTF-8, 32 bits."""
    h = 2166136261
    for b in text.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * 16777619 & MASK
    return h


class Draws:
    """A small seeded generator of 32-bit numbers (an odd Weyl step and two multiplications)."""

    def __init__(self, seed: int):
        self.state = seed & MASK

    def below(self, n: int) -> int:
        self.state = self.state + 0x6D2B79F5 & MASK
        x = (self.state ^ self.state >> 15) * (self.state | 1) & MASK
        x ^= x + ((x ^ x >> 7) * (x | 61) & MASK) & MASK
        return ((x ^ x >> 14) & MASK) % n


def shaped(part: str, draw: Draws) -> str:
    """A word for a word, a digit for a digit, the extension kept."""
    stem, dot, ext = part.rpartition(".") if re.search(r"\.[A-Za-z0-9]{1,5}$", part) else (part, "", "")
    if re.fullmatch(r"[0-9]+", stem):
        return "".join(str(draw.below(10)) for _ in stem) + dot + ext
    if re.fullmatch(r"[0-9a-fA-F-]{16,}", stem):
        return "".join(c if c == "-" else "0123456789abcdef"[draw.below(16)] for c in stem) + dot + ext
    words = re.split(r"([^A-Za-z0-9]+)", stem)
    out = [w if i % 2 or not w else (WORDS[draw.below(len(WORDS))].capitalize() if w[0].isupper() else WORDS[draw.below(len(WORDS))]) for i, w in enumerate(words)]
    return "".join(out) + dot + ext


def synthetic_link(url: str) -> str:
    """Scheme, depth, query keys and extension of a link, nothing else of it."""
    draw = Draws(seed_of(url))
    m = re.match(r"^((?:[a-z][a-z0-9+.-]*:)?//|www\.)?([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$", url, re.I | re.S)
    scheme, host, path, query, fragment = (x or "" for x in m.groups())
    port = re.search(r":\d+$", host)
    out = scheme + WORDS[draw.below(len(WORDS))] + ".example.com" + (port[0] if port else "")
    out += "/".join(shaped(p, draw) if p else p for p in path.split("/"))
    if query:
        out += "?" + "&".join(k + (eq and eq + shaped(v, draw)) for k, eq, v in (p.partition("=") for p in query[1:].split("&")))
    return out + ("#" + shaped(fragment[1:], draw) if fragment else "")


KEPT = {"users", "home", "documents", "downloads", "desktop", "mnt", "media", "run", "var", "tmp", "src", "bin", "lib", "etc", "~", "$home", ""}


def synthetic_path(path: str) -> str:
    """Root, separators, depth, usual folders and extension of a path."""
    draw = Draws(seed_of(path))
    return "".join(p if i % 2 or p.lower() in KEPT or re.fullmatch("[A-Za-z]:", p) else shaped(p, draw) for i, p in enumerate(re.split(r"([\\/]+)", path)))


@arrow("string")
def links(urls: pd.Series) -> pd.Series:
    return urls.map(lambda u: None if u is None else synthetic_link(u))


@arrow("string")
def paths(values: pd.Series) -> pd.Series:
    return values.map(lambda p: None if p is None else synthetic_path(p))
