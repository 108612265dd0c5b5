"""Putting originals back: strict, tolerant of mangled placeholders, and by vault.

The strict form is native. The tolerant forms look at what surrounds a match and
at what was matched before, so they are Arrow functions over (text, map); texts
without the shape of a token are answered natively.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.arrow import arrow
from spanlake.plans.scratch import stored
from spanlake.operators.pseudonym import PLACEHOLDER

SHAPE = r"\[?[A-Z]{2,}[A-Z_]*[_ ]?[0-9]+(?![0-9])\]?"
TOKEN = re.compile(r"\[([A-Z]+(?:_[A-Z]+)*)_([0-9]+)\]")
VARIANT = re.compile(r"(\[)?([A-Za-z]+(?:_[A-Za-z]+)*?)[_ ]?([0-9]+)(?![0-9])(\])?")


def has_shape(text: Column) -> Column:
    """Whether something in the text may be a placeholder, mangled or not."""
    return text.rlike(SHAPE)


def strict(text: Column, tokens: Column) -> Column:
    """Known placeholders in brackets replaced (tokens: MAP token -> original)."""
    rest = F.split(text, PLACEHOLDER, -1)
    found = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), 1)
    put = F.zip_with(found, F.slice(rest, F.lit(2), F.size(rest)), lambda t, after: F.concat(F.coalesce(F.try_element_at(tokens, t), t), after))
    return F.when(text.rlike(PLACEHOLDER), F.concat(F.element_at(rest, 1), F.array_join(put, ""))).otherwise(text)


def _word(c: str) -> bool:
    return c == "_" or c.isalnum()


def _embedded(text: str, a: int, b: int, token: str) -> bool:
    """A placeholder without brackets as written into identifiers: what is before it is
    lower case, a digit or _; after it comes _, a capitalized word, or nothing."""
    if text[a:b] != token[1:-1]:
        return False
    before, after, third = text[a - 1 : a], text[b : b + 1], text[b + 1 : b + 2]
    fine = not before or not _word(before) or re.match(r"[a-z0-9_$]", before)
    return bool(fine) and (not after or not _word(after) or after == "_" or bool(re.match(r"[A-Z]", after) and re.match(r"[a-z]", third)))


def variant_matches(text: str, tokens: Iterable[str]) -> list[tuple[int, int, str]]:
    """(start, end, token) of known placeholders: brackets optional, any case, _, blank
    or nothing before the number; higher numbers first, no overlaps."""
    known = sorted(((int(m[2]), len(t), t, m[1]) for t in tokens if (m := TOKEN.fullmatch(t))), reverse=True)
    out: list[tuple[int, int, str]] = []
    for n, _, token, kind in known:
        for m in re.finditer(rf"(\[)?{re.escape(kind)}[_ ]?{n}(?![0-9])(\])?", text, re.I):
            a, b = m.span()
            glued = (not m[1] and a and _word(text[a - 1])) or (not m[2] and b < len(text) and _word(text[b]))
            if glued and not _embedded(text, a, b, token):
                continue
            if not any(a < y and x < b for x, y, _ in out):
                out.append((a, b, token))
    return sorted(out)


def _bounded(text: str, a: int, b: int) -> bool:
    left = not a or not _word(text[a - 1]) or not _word(text[a])
    return left and (b == len(text) or not _word(text[b]) or not _word(text[b - 1]))


def _apply(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, value in sorted(found):
        out += [text[at:a], value]
        at = b
    return "".join([*out, text[at:]])


def literal_matches(text: str, needles: Iterable[str], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Whole-word occurrences, longer needles first, outside what is taken and each other."""
    out = list(taken)
    for needle in sorted(needles, key=lambda n: (-len(n), n)):
        at = text.find(needle) if needle else -1
        while at >= 0:
            end = at + len(needle)
            if _bounded(text, at, end) and not any(at < y and x < end for x, y, _ in out):
                out.append((at, end, needle))
                at = text.find(needle, end)
            else:
                at = text.find(needle, at + 1)
    return out[len(taken) :]


def resolve(text: str, tokens: Mapping[str, str], strict_only: Iterable[str] = ()) -> tuple[str, list[tuple[int, int, str]]]:
    """Tolerant placeholders first, then literal keys; one pass, nothing is read twice."""
    held = set(strict_only)
    tolerant = [t for t in tokens if TOKEN.fullmatch(t) and t not in held]
    found = variant_matches(text, tolerant)
    found += literal_matches(text, [t for t in tokens if t not in set(tolerant)], found)
    return _apply(text, [(a, b, tokens[t]) for a, b, t in found]), sorted(found)


def restore_with_vault(text: str, records: list[tuple[str, str, str]]) -> str:
    """Records (placeholder, synthetic value, original): placeholders, then their variants, then synthetic
    values in what these leave. What was put back isn't read again: an original may look like another record's value."""
    tokens: dict[str, str] = {}
    for token, _, original in records:
        tokens.setdefault(token, original)
    found = [(*m.span(), tokens[m[0]]) for m in TOKEN.finditer(text) if m[0] in tokens]
    held = list(found)
    found += [(a, b, tokens[t]) for a, b, t in variant_matches(text, tokens) if not any(a < y and x < b for x, y, _ in held)]
    for _, needle, original in sorted((r for r in records if r[1]), key=lambda r: -len(r[1])):
        found += [(a, b, original) for a, b, _ in literal_matches(text, [needle], found)]
    return _apply(text, found)


@arrow("struct<restored:string,found:array<string>>")
def _resolve(texts: pd.Series, maps: pd.Series, held: pd.Series) -> pd.DataFrame:
    rows = []
    for text, tokens, strict_only in zip(texts, maps, held):
        if text is None or tokens is None:
            rows.append((text, []))
        else:
            out, found = resolve(text, dict(tokens), () if strict_only is None else strict_only)
            rows.append((out, list(dict.fromkeys(t for _, _, t in found))))
    return pd.DataFrame(rows, columns=["restored", "found"])


def resolved(text: Column, tokens: Column, strict_only: Column | None = None) -> Column:
    """STRUCT(restored, found tokens)."""
    return _resolve(text, tokens, F.array().cast("array<string>") if strict_only is None else strict_only)


@arrow("string")
def _restore_vault(texts: pd.Series, records: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or r is None else restore_with_vault(t, [(x["placeholder"], x["synthetic_value"] or "", x["original_text"]) for x in r]) for t, r in zip(texts, records)])


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[^\w]+", -1), lambda w: w != "")


#: log2 of the bits of the map of values that runs of words are held against first.
GATE_BITS = 20


def _gate(values: DataFrame, run: str):
    """A test that lets through every text of a column, and few others: a map of hashes of a fixed size, as a literal.
    The driver sees one number for each bit that is set."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << GATE_BITS))
    packed = bytearray(1 << (GATE_BITS - 3))
    for r in values.select(slot(F.col(run)).alias("s")).distinct().collect():
        packed[r["s"] >> 3] |= 1 << (r["s"] & 7)
    bits = F.lit(bytes(packed))

    def passes(c: Column) -> Column:
        byte = F.conv(F.hex(F.call_function("substring", bits, (F.shiftright(slot(c), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return F.pmod(F.call_function("shiftright", byte, F.pmod(slot(c), F.lit(8)).cast("int")), F.lit(2)) == 1

    return passes


def restored_by_vault(replies: DataFrame, vault: DataFrame, text: str = "reply") -> DataFrame:
    """replies plus restored. A reply meets only the records whose placeholder (in any
    variant) or synthetic value it may hold: those of its tokens' numbers, and those whose
    synthetic value has the words of a run of its words; joined on the whole run, as many
    values share their first words. The runs' lengths are those of the vault's values, and
    runs that can be none of them stop at a map of hashes."""
    rows = stored(replies.withColumn("row__", F.monotonically_increasing_id()), "replies")
    value = vault.where("synthetic_value != ''").withColumn("w__", _words(F.col("synthetic_value")))
    sizes = sorted(r[0] for r in value.select(F.size("w__")).distinct().collect() if r[0])  # as many as pools have lengths
    words = _words(F.col(text))
    runs = [F.transform(F.sequence(F.lit(1), F.size("w__") - n + 1), lambda i, n=n: F.array_join(F.slice("w__", i, n), " ")) for n in sizes]
    passes = _gate(value.select(F.array_join("w__", " ").alias("run")), "run")
    some = [F.when(F.size("w__") >= n, F.filter(r, passes)).otherwise(F.array().cast("array<string>")) for n, r in zip(sizes, runs)]
    digits = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([0-9]+)"), 1), lambda n: F.concat(F.lit("#"), F.regexp_replace(n, "^0+(?=.)", "")))
    asked = rows.select("row__", digits.alias("d__"), words.alias("w__")).select("row__", F.explode(F.array_distinct(F.concat("d__", *some))).alias("k"))
    record = ["placeholder", "synthetic_value", "original_text"]
    keys = vault.select(*record, F.concat(F.lit("#"), F.col("index").cast("string")).alias("k")).unionByName(value.select(*record, F.array_join("w__", " ").alias("k")).where("k != ''"))
    hits = asked.join(keys, "k").groupBy("row__").agg(F.array_sort(F.collect_set(F.struct(*record))).alias("records__"))
    return rows.join(hits, "row__", "left").withColumn("restored", F.coalesce(_restore_vault(F.col(text), F.col("records__")), F.col(text))).drop("row__", "records__")


def reversible(text: Column, tokens: Column) -> Column:
    """Whether a text holds a placeholder's shape or one of the keys."""
    return has_shape(text) | F.exists(F.map_keys(tokens), lambda k: (k != "") & F.contains(text, k))


def used_mappings(text: Column, tokens: Column) -> Column:
    """The pairs whose token, with brackets or without, occurs."""
    return F.map_filter(tokens, lambda k, _: F.contains(text, k) | F.contains(text, F.regexp_replace(k, r"^\[|\]$", "")))


def visible_tokens(text: Column, known: Column) -> Column:
    return F.filter(known, lambda t: F.contains(text, t))


# ---- conversations and history


def conversation_scope(recorded: DataFrame, ledger: DataFrame, observed: DataFrame) -> DataFrame:
    """scope, token, original, strict: tokens a reply may resolve. Tables (scope, token,
    original); those only observed hold in their strict form."""
    parts = [df.select("scope", "token", "original", F.lit(o).alias("only_seen")) for df, o in ((recorded, False), (ledger, False), (observed, True))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("scope", "token").agg(F.min_by("original", F.struct("only_seen", "original")).alias("original"), F.min("only_seen").alias("strict"))


def augmented(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    """(scope, token, original) plus the other form, placeholder or synthetic value, of the
    records whose one form is there."""
    v = vault.select("placeholder", "synthetic_value", F.col("original_text").alias("original"))
    other = tokens.join(v.where("synthetic_value != ''").select(F.col("placeholder").alias("token"), F.col("synthetic_value").alias("more"), F.col("original").alias("o")), "token").select("scope", F.col("more").alias("token"), F.col("o").alias("original"))
    back = tokens.join(v.where("synthetic_value != ''").select(F.col("synthetic_value").alias("token"), F.col("placeholder").alias("more"), F.col("original").alias("o")), "token").select("scope", F.col("more").alias("token"), F.col("o").alias("original"))
    return tokens.unionByName(other).unionByName(back).dropDuplicates(["scope", "token"])


def best_history(replies: DataFrame, entries: DataFrame) -> DataFrame:
    """reply_id, entry_id, hits: for each reply the entry with the most distinct tokens in
    it, the newest on ties. replies (reply_id, reply), entries (entry_id, created, token)."""
    seen = replies.select("reply_id", F.explode(F.array_distinct(F.regexp_extract_all("reply", F.lit(f"({PLACEHOLDER})"), 1))).alias("token"))
    hits = seen.join(entries, "token").groupBy("reply_id", "entry_id", "created").agg(F.countDistinct("token").alias("hits"))
    best = hits.groupBy("reply_id").agg(F.max(F.struct("hits", "created", "entry_id")).alias("b"))
    return best.select("reply_id", "b.entry_id", "b.hits")


def exact_copy(texts: DataFrame, entries: DataFrame) -> DataFrame:
    """text_id, entry_id of the newest entry whose anonymized text is the same but for
    line ends and outer blanks."""
    from spanlake.functions.text import normalized_for_match

    a = texts.select("text_id", normalized_for_match(F.col("text")).alias("n"))
    b = entries.select("entry_id", "created", normalized_for_match(F.col("anonymized")).alias("n"))
    return a.join(b, "n").groupBy("text_id").agg(F.max_by("entry_id", F.struct("created", "entry_id")).alias("entry_id"))
