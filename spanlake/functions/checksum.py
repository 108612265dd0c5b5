"""Checks of numbers by their digits, natively."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn(text: Column) -> Column:
    """13 to 19 ASCII digits that pass the Luhn sum."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban(text: Column) -> Column:
    """ISO 13616: the number with its first four characters last is 1 modulo 97."""
    clean = F.regexp_replace(text, r"(?U)\s", "")
    moved = F.concat(F.call_function("substring", clean, F.lit(5)), F.substring(clean, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97))
    shape = clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$")
    return F.when(shape, rest == 1).otherwise(F.lit(False))


def ssn(text: Column) -> Column:
    """Three parts; area not 0, 666 or from 900 on, group and serial not 0."""
    parts = F.split(text, "-", -1)
    n = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in (1, 2, 3)]
    plain = text.rlike("^[+]?[0-9]+-[+]?[0-9]+-[+]?[0-9]+$")
    good = ~n[0].isin(0, 666) & (n[0] < 900) & (n[1] != 0) & (n[2] != 0)
    return (F.size(parts) == 3) & plain & F.coalesce(good, F.lit(False))


def valid(span: Column) -> Column:
    """Whether a pattern span passes its type's check; other types have none."""
    t, text = span["entity_type"], span["text"]
    return F.when(t == "CREDIT_CARD", luhn(text)).when(t == "IBAN", iban(text)).when(t == "SSN", ssn(text)).otherwise(F.lit(True))
