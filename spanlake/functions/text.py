"""Keys, fingerprints, offsets and labels of texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.functions.arrow import arrow
from spanlake.functions.spans import let
from spanlake import rules


def normalized_key(text: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def normalized_for_match(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), r"(?U)^\s+|\s+$", "")


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes before a code point offset."""
    return F.octet_length(F.left(text, chars))


def char_offset(text: Column, offset: Column) -> Column:
    """Code points before a byte offset."""
    return F.length(F.call_function("substring", F.encode(text, "UTF-8"), F.lit(1), offset).cast("string"))


def length_bucket(text: Column) -> Column:
    """short up to 120 UTF-16 units, medium up to 260, else long."""
    units = F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.when(units <= 120, "short").when(units <= 260, "medium").otherwise("long")


def language(value: Column) -> Column:
    """en or de; null for others."""
    v = F.lower(value)
    head = F.substring_index(F.substring_index(v, "-", 1), "_", 1)
    return F.when(head.isin("en", "de"), head).when(head == "english", "en").when(head.isin("german", "deutsch"), "de")


#: Labels of raw corpora that name a type otherwise; fixed values.
LABELS = {
    "ACCOUNT_NAME": "USERNAME", "AGE": "MISC", "BIRTH_DATE": "DATE", "BUILDING_NUMBER": "ADDRESS", "CITY": "LOCATION", "COUNTRY": "LOCATION",
    "CREDIT_CARD_NUMBER": "CREDIT_CARD", "CREDITCARDNUMBER": "CREDIT_CARD", "DATE_OF_BIRTH": "DATE", "DOB": "DATE", "DRIVER_LICENSE": "MISC",
    "DRIVER_LICENSE_NUMBER": "MISC", "EMAIL_ADDRESS": "EMAIL", "FIRST_NAME": "PERSON", "FIRSTNAME": "PERSON", "FULL_NAME": "PERSON", "GENDER": "MISC",
    "GIVEN_NAME": "PERSON", "ID_CARD": "MISC", "ID_CARD_NUMBER": "MISC", "LAST_NAME": "PERSON", "LASTNAME": "PERSON", "NAME": "PERSON", "PASSPORT": "MISC",
    "PASSPORT_NUMBER": "MISC", "PHONE_NUMBER": "PHONE", "PIN": "MISC", "POSTAL_CODE": "MISC", "SOCIALNUMBER": "SSN", "SOCIAL_SECURITY_NUMBER": "SSN",
    "STATE": "LOCATION", "STREET": "ADDRESS", "STREET_ADDRESS": "ADDRESS", "TAX_ID": "MISC", "TAX_IDENTIFICATION_NUMBER": "MISC", "ZIP_CODE": "MISC",
}


def corpus_label(label: Column) -> Column:
    """An entity type, or null."""
    from spanlake.functions.spans import lookup

    n = F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(n.isin(*rules.ENTITY_TYPES), n).otherwise(lookup(LABELS, n))


@arrow("string")
def fingerprint(texts: pd.Series) -> pd.Series:
    """Length in base 36 and 53 bits of a two-lane multiplicative hash over UTF-16 units."""
    known = texts[texts.notna()]
    return pd.Series(text_fingerprints(known.tolist()), known.index, dtype=object).reindex(texts.index, fill_value=None)


def base36(n: int) -> str:
    out = ""
    while True:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
        if not n:
            return out


#: Texts that are hashed side by side; when fewer are left, each goes on by itself.
SIDE_BY_SIDE = 24
_MASK = 0xFFFFFFFF
_LANES = (2654435761, 1597334677)


def text_fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of some texts, hashed side by side, the longest first, unit by unit."""
    units = [np.frombuffer(t.replace("\r\n", "\n").strip().encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    order = sorted(range(len(units)), key=lambda i: -len(units[i]))
    sizes = np.array([len(units[i]) for i in order], np.int64)
    flat = np.concatenate([units[i] for i in order]) if order else np.zeros(0, np.uint16)
    starts = np.cumsum(sizes) - sizes
    one, two = np.full(len(order), 0xDEADBEEF, np.uint64), np.full(len(order), 0x41C6CE57, np.uint64)
    at = int(sizes[SIDE_BY_SIDE - 1]) if len(order) >= SIDE_BY_SIDE else 0
    live = len(order)
    for p in range(at):
        while live and sizes[live - 1] <= p:
            live -= 1
        u = flat[starts[:live] + p]
        for lane, factor in zip((one, two), _LANES):
            lane[:live] = (lane[:live] ^ u) * np.uint64(factor) & np.uint64(_MASK)
    out = [""] * len(order)
    for k, i in enumerate(order):
        out[i] = _finished(int(sizes[k]), *_on(int(one[k]), int(two[k]), units[i][at:]))
    return out


def _on(one: int, two: int, units: np.ndarray) -> tuple[int, int]:
    for u in units.tolist():
        one = (one ^ u) * _LANES[0] & _MASK
        two = (two ^ u) * _LANES[1] & _MASK
    return one, two


def _finished(size: int, one: int, two: int) -> str:
    one = ((one ^ one >> 16) * 2246822507 & _MASK) ^ ((two ^ two >> 13) * 3266489909 & _MASK)
    two = ((two ^ two >> 16) * 2246822507 & _MASK) ^ ((one ^ one >> 13) * 3266489909 & _MASK)  # of the new one
    return f"{base36(size)}-{base36(4294967296 * (2097151 & two) + one)}"


def text_fingerprint(text: str) -> str:
    return text_fingerprints([text])[0]


def context(text: Column, piece: Column, around: int = 48) -> Column:
    """A piece of a text with what is around it, white space collapsed and cuts marked; the
    text's beginning if the piece isn't in it."""
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")

    def cut(x: Column) -> Column:
        t, p = x["t"], x["p"]
        at = F.call_function("locate", p, t) - 1
        a, b = F.greatest(at - around, F.lit(0)), F.least(at + F.length(p) + around, F.length(t))
        found = F.concat(F.when(a > 0, "...").otherwise(""), F.call_function("substring", t, (a + 1).cast("int"), (b - a).cast("int")), F.when(b < F.length(t), "...").otherwise(""))
        head = F.when(F.length(t) <= 2 * around, t).otherwise(F.concat(F.left(t, F.lit(2 * around - 3)), F.lit("...")))
        return F.when((p != "") & (at >= 0), found).otherwise(head)

    return let(F.struct(flat(text).alias("t"), flat(piece).alias("p")), cut)
