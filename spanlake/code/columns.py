"""Code analysis as columns. Offsets are UTF-8 bytes, like those of spans.

Texts without any sign of code or of error output are answered natively.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.code import identifiers, regions, rename, traces
from spanlake.functions.arrow import arrow

MAY_BE_CODE = regions.MAY_BE
MAY_BE_TRACE = f"(?mU){traces.HINTS}"
REGIONS = "array<struct<start:int,end:int,language:string>>"
SLOTS = "array<struct<start:int,end:int,name:string,kind:string,library:boolean>>"


class Bytes:
    """Byte offsets of ascending or any code point offsets of a text."""

    def __init__(self, text: str):
        self.text, self.plain = text, text.isascii()

    def __call__(self, at: int) -> int:
        return at if self.plain else len(self.text[:at].encode())


@arrow(REGIONS)
def _regions(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        b = Bytes(text)
        out.append([{"start": b(x), "end": b(y), "language": lang} for x, y, lang in regions.languages(text)])
    return pd.Series(out)


@arrow("array<struct<start:int,end:int>>")
def _marked(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        b = Bytes(text)
        out.append([{"start": b(x), "end": b(y)} for x, y in sorted(regions.code_regions(text))])
    return pd.Series(out)


@arrow(SLOTS)
def _slots(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        b = Bytes(text)
        out.append([{"start": b(s.start), "end": b(s.end), "name": s.name, "kind": s.kind, "library": s.library} for s in traces.error_slots(text)])
    return pd.Series(out)


@arrow("struct<renamed:string,aliases:map<string,string>>")
def _renamed(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([rename.renamed(t) for t in texts], columns=["renamed", "aliases"])


@arrow("string")
def _frames(texts: pd.Series) -> pd.Series:
    return texts.map(traces.frames_as_code)


@arrow("string")
def _split(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: identifiers.split_view(t, regions.all_code(t))[0])


def _gated(text: Column, gate: str, f, empty: Column) -> Column:
    has = F.coalesce(text, F.lit("")).rlike(gate)
    return F.when(has, f(F.when(has, text).otherwise(F.lit("")))).otherwise(empty)


def code_regions(text: Column) -> Column:
    """Regions and runs of code with their languages."""
    return _gated(text, MAY_BE_CODE, _regions, F.array().cast(REGIONS))


def marked_regions(text: Column) -> Column:
    """Fenced and HTML regions only."""
    return _gated(text, "(?i)```|<code|<pre", _marked, F.array().cast("array<struct<start:int,end:int>>"))


def error_slots(text: Column) -> Column:
    return _gated(text, MAY_BE_TRACE, _slots, F.array().cast(SLOTS))


def renamed(text: Column) -> Column:
    """STRUCT(renamed, aliases)."""
    return _gated(text, MAY_BE_CODE, _renamed, F.struct(text.alias("renamed"), F.create_map().cast("map<string,string>").alias("aliases")))


def frames_as_code(text: Column) -> Column:
    return _gated(text, MAY_BE_TRACE, _frames, F.lit(""))


def split_identifiers(text: Column) -> Column:
    return _gated(text, MAY_BE_CODE, _split, text)


def profiles(text: Column) -> Column:
    """Libraries whose signals a text has."""
    found = []
    for name, patterns in sorted(regions.PROFILES.items()):
        has = reduce(or_, (F.contains(text, F.lit(needle)) for needle in regions.PROFILE_NEEDS[name]))
        found.append(F.when(has & text.rlike("(?m)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)))
    return F.array_compact(F.array(*found))


def alias(role: Column, name: Column, index: Column) -> Column:
    """rename.alias() natively."""
    word = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in rename.STEMS.items() for x in kv)), role), F.lit("var"))
    lead, bare, n = F.regexp_extract(name, "^_*", 0), F.regexp_replace(name, "^_+", ""), index.cast("string")
    styled = (
        F.when(word == "Class", F.concat(F.lit("Class"), n))
        .when(bare.rlike("^[A-Z][A-Z0-9_]+$"), F.concat(F.upper(word), F.lit("_"), n))
        .when(bare.rlike("^[A-Z]"), F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.call_function("substring", word, F.lit(2))), n))
        .when(bare.contains("_"), F.concat(F.lower(word), F.lit("_"), n))
        .otherwise(F.concat(F.lower(word), n))
    )
    return F.concat(lead, styled)


# ---- spans and code together

RANGES = "array<struct<start:int,end:int,text:string>>"


def _chars(text: str, at: int) -> int:
    """Code points before a byte offset."""
    return at if text.isascii() else len(text.encode()[:at].decode("utf-8", "ignore"))


def _ranged(text: str, found) -> list[dict]:
    b = Bytes(text)
    return [{"start": b(x), "end": b(y), "text": text[x:y]} for x, y in found]


@arrow(RANGES)
def _propagated(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, spans):
        flagged = [w for s in own for w in identifiers.words(s["text"].replace(" ", "_"))]
        out.append(_ranged(text, [(a, b) for a, b, _ in identifiers.propagated(text, regions.all_code(text), flagged)]))
    return pd.Series(out)


@arrow(RANGES)
def _widened(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, own in zip(texts, spans):
        ranges = [(_chars(text, s["start"]), _chars(text, s["end"])) for s in own]
        out.append(_ranged(text, identifiers.widened(text, regions.all_code(text), ranges)))
    return pd.Series(out)


@arrow("array<boolean>")
def _bare(texts: pd.Series, spans: pd.Series) -> pd.Series:
    return pd.Series([[identifiers.takes_bare(t, _chars(t, s["start"]), _chars(t, s["end"])) for s in own] for t, own in zip(texts, spans)])


def propagated(text: Column, spans: Column) -> Column:
    """The words of spans, at every identifier in code that has them."""
    return _propagated(F.coalesce(text, F.lit("")), spans)


def widened(text: Column, spans: Column) -> Column:
    """Spans in code as whole identifiers, everywhere in code."""
    return _widened(F.coalesce(text, F.lit("")), spans)


def without_generic(text: Column, spans: Column, generic: Iterable[str] = identifiers.GENERIC) -> Column:
    """Without a model's spans that are generic words within identifiers or code."""
    known = frozenset(generic)

    @arrow("array<boolean>")
    def marked(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, spans):
            code = regions.all_code(text)
            ranges = [(_chars(text, s["start"]), _chars(text, s["end"])) for s in own]
            out.append([identifiers.only_generic(text, a, b, any(x <= a < y for x, y in code), known) for a, b in ranges])
        return pd.Series(out)

    zipped = F.arrays_zip(spans.alias("s"), marked(F.coalesce(text, F.lit("")), spans).alias("g"))
    return F.transform(F.filter(zipped, lambda z: ~((z["s"]["source"] == "ner") & z["g"])), lambda z: z["s"])


def takes_bare(text: Column, spans: Column) -> Column:
    """For each span whether its replacement must go without brackets."""
    return _bare(F.coalesce(text, F.lit("")), spans)


@arrow("string")
def path_view(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else identifiers.path_view(t))
