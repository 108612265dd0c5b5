"""Spans as columns: arrays of structs with UTF-8 byte offsets, built natively."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import rules

SPAN = "struct<start:int,end:int,entity_type:string,score:double,text:string,source:string,ord:int>"
SPANS = f"array<{SPAN}>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once, whatever is built on it.

    Filters on a column, also those that explode() brings along, are pushed through
    projections by putting its whole expression in its place, again and again for
    stacked columns. A generator of one row stops that, while filters on the other
    columns still reach the scan.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c != name]
    if name in df.columns:
        return df.select(*kept, F.explode(F.array(value)).alias("new__")).withColumnRenamed("new__", name)
    return df.select(*kept, F.explode(F.array(value)).alias(name))


def span(start: Column, end: Column, entity_type: Column, score: Column, text: Column, source: Column, order: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), entity_type.alias("entity_type"), score.cast("double").alias("score"), text.alias("text"), source.alias("source"), order.cast("int").alias("ord"))


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """text between two byte offsets."""
    return F.call_function("substring", F.encode(text, "UTF-8"), start + 1, F.greatest(end - start, F.lit(0))).cast("string")


def scan(text: Column, pattern: str, entity_type: str, score: float, order: int, prefix: str | None = None, source: str = "regex") -> Column:
    """Non-overlapping leftmost matches of pattern. With prefix, that pattern must
    come right before and is no part of the span.

    Matches are put between two marks, the text is split at the first, and lengths
    are added up; texts without a match skip all of that. Where the text has a mark
    itself, another control character stands for it meanwhile.
    """
    whole = pattern if prefix is None else f"({prefix})({pattern})"
    mark = "\x01$0\x02" if prefix is None else "$1\x01$2\x02"
    unicode = "(?U)" + whole
    clean = F.translate(text, "\x01\x02", "\x03\x04")
    cut = F.split(F.regexp_replace(clean, unicode, mark), "\x01", -1)

    def add(acc: Column, part: Column) -> Column:
        found = F.substring_index(part, "\x02", 1)
        size = F.octet_length(found)
        own = span(acc["at"], acc["at"] + size, F.lit(entity_type), F.lit(score), F.when(text.rlike("[\x01\x02]"), byte_slice(text, acc["at"], acc["at"] + size)).otherwise(found), F.lit(source), F.lit(order))
        return F.struct((acc["at"] + F.octet_length(part) - 1).alias("at"), F.concat(acc["spans"], F.array(own)).alias("spans"))

    begin = lambda parts: F.struct(F.octet_length(F.element_at(parts, 1)).alias("at"), no_spans().alias("spans"))
    every = let(cut, lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), begin(parts), add)["spans"])
    return F.when(clean.rlike(unicode), every).otherwise(no_spans())


#: What each pattern needs: an @, or a digit of any script. Most texts have neither.
NEEDS = {"EMAIL": "@"}
DIGIT = r"\p{Nd}"


def recognized(text: Column, types: tuple[str, ...] | None = None) -> Column:
    """Candidate spans of the pattern recognizers, in their order. Patterns run only
    over texts that have what they need."""
    plain, numeric = [], []
    for order, (entity_type, pattern, score) in enumerate(rules.RECOGNIZERS):
        if types is None or entity_type in types:
            own = scan(text, pattern, entity_type, score, order)
            if entity_type == "PHONE":  # a date in full is no phone number
                own = F.filter(own, lambda s: F.regexp_extract(s["text"], "(?U)" + rules.DATE, 0) != s["text"])
            if entity_type in NEEDS:
                plain.append(F.when(F.contains(text, F.lit(NEEDS[entity_type])), own).otherwise(no_spans()))
            else:
                numeric.append(own)
    if numeric:
        plain.append(F.when(text.rlike(DIGIT), F.concat(*numeric)).otherwise(no_spans()))
    return F.concat(*plain)


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def precedence(s: Column) -> Column:
    return F.when(s["source"] == "manual", 3).when((s["source"] == "regex") & s["entity_type"].isin(*rules.STRUCTURED), 2).otherwise(1)


def in_order(spans: Column) -> Column:
    """By start, then falling score, then the order of detection."""
    key = F.transform(spans, lambda s: F.struct(s["start"].alias("k1"), (-s["score"]).alias("k2"), s["ord"].alias("k3"), s.alias("s")))
    return F.transform(F.array_sort(key), lambda k: k["s"])


def merged(spans: Column) -> Column:
    """Overlaps resolved from left to right: a span is held against the last one
    kept and takes its place by precedence, then by a higher score."""
    ordered = in_order(spans)

    def step(kept: Column, s: Column) -> Column:
        last = F.element_at(kept, -1)
        wins = (precedence(s) > precedence(last)) | ((precedence(s) == precedence(last)) & (s["score"] > last["score"]))
        swapped = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))
        clash = (F.size(kept) > 0) & F.coalesce(overlaps(F.try_element_at(kept, F.lit(-1)), s), F.lit(False))
        return F.when(~clash, F.concat(kept, F.array(s))).when(wins, swapped).otherwise(kept)

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(ordered, no_spans(), step))


def lookup(table: dict, key: Column) -> Column:
    """table[key], null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


TOKEN = r"[\p{IsAlphabetic}\p{N}'\-]"


def boosted(spans: Column, text: Column, window: int = 5, boost: float = 0.15) -> Column:
    """Scores raised once where a keyword of the type is among the window + 1 nearest
    tokens on either side. A token that runs over the span's edge is none."""
    words = F.create_map(*(x for t, ks in rules.KEYWORDS.items() for x in (F.lit(t), F.array(*(F.lit(k) for k in ks)))))

    def near(s: Column) -> Column:
        before, after = byte_slice(text, F.lit(0), s["start"]), byte_slice(text, s["end"], F.octet_length(text))
        before = F.when(s["text"].rlike(f"^{TOKEN}"), F.regexp_replace(before, f"{TOKEN}+$", "")).otherwise(before)
        after = F.when(s["text"].rlike(f"{TOKEN}$"), F.regexp_replace(after, f"^{TOKEN}+", "")).otherwise(after)
        left = F.slice(F.reverse(F.regexp_extract_all(F.lower(before), F.lit(f"({TOKEN}+)"), 1)), 1, window + 1)
        right = F.slice(F.regexp_extract_all(F.lower(after), F.lit(f"({TOKEN}+)"), 1), 1, window + 1)
        return F.coalesce(F.arrays_overlap(F.concat(left, right), F.try_element_at(words, s["entity_type"])), F.lit(False))

    raised = F.transform(spans, lambda s: s.withField("score", F.when(near(s), F.least(F.lit(1.0), s["score"] + boost)).otherwise(s["score"])))
    return F.when(F.size(spans) == 0, spans).otherwise(raised)


def confident(spans: Column, minimum: float = 0.5) -> Column:
    """Spans at or above the minimum; a model's also above that of its type."""
    least = lambda s: F.when(s["source"] == "ner", F.greatest(F.lit(minimum), F.coalesce(lookup(rules.MODEL_MINIMUM, s["entity_type"]), F.lit(minimum)))).otherwise(F.lit(minimum))
    return F.filter(spans, lambda s: s["score"] >= least(s))
