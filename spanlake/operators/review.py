"""Filters between detection and replacement: groups, sensitivity, lists, feedback.

Lists are literals in the plan; they are settings, not data.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.functions.spans import computed, lookup, merged, scan
from spanlake.functions.urls import normalized_domain


@dataclass(frozen=True)
class Entry:
    pattern: str
    scope: str = "any"


@dataclass(frozen=True)
class Settings:
    slider: float = 0.5
    individual: bool = False
    group_sliders: dict = field(default_factory=dict)
    groups_on: dict = field(default_factory=lambda: {g: g not in rules.GROUPS_OFF for g in rules.GROUPS})
    allow: tuple[Entry, ...] = ()
    block: tuple[Entry, ...] = ()


    @classmethod
    def normalized(cls, given: dict | None) -> Settings:
        """Settings of a stored object: unknown, missing or ill-typed values give defaults."""
        given = given if isinstance(given, dict) else {}
        part = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 <= v <= 1
        sliders, on = given.get("groupThresholds"), given.get("groupsEnabled")
        base = cls()
        groups_on = dict(base.groups_on) | {g: v for g, v in (on if isinstance(on, dict) else {}).items() if g in rules.GROUPS and isinstance(v, bool)}

        def entries(name: str) -> tuple[Entry, ...]:
            rows = given.get(name) if isinstance(given.get(name), list) else []
            return tuple(Entry(r["pattern"].strip(), r.get("scope") if r.get("scope") in rules.ENTITY_TYPES else "any") for r in rows if isinstance(r, dict) and isinstance(r.get("pattern"), str) and r["pattern"].strip())

        return cls(
            slider=float(given["minConfidence"]) if part(given.get("minConfidence")) else base.slider,
            individual=given.get("sensitivityMode") == "individual",
            group_sliders={g: float(v) for g, v in (sliders if isinstance(sliders, dict) else {}).items() if g in rules.GROUPS and part(v)},
            groups_on=groups_on,
            allow=entries("allowlist"),
            block=entries("blocklist"),
        )


# ---- groups and thresholds


def in_enabled_groups(spans: Column, groups_on: dict) -> Column:
    """Spans whose group isn't off; types without a group go."""
    on = [t for t, g in rules.GROUP_OF.items() if groups_on.get(g) is not False]
    return F.filter(spans, lambda s: s["entity_type"].isin(*on)) if on else F.filter(spans, lambda s: F.lit(False))


def threshold(settings: Settings, entity_type: str) -> float:
    """From the highest (slider at 0) to the lowest (at 1), in a straight line."""
    slider = settings.slider
    if settings.individual:
        slider = settings.group_sliders.get(rules.GROUP_OF.get(entity_type), slider)
    base, delta = rules.SENSITIVITY[entity_type]
    high, low = min(1.0, max(0.0, base + delta)), min(1.0, max(0.0, base - delta))
    return high - slider * (high - low)


def thresholds(settings: Settings) -> dict[str, float]:
    return {t: threshold(settings, t) for t in rules.ENTITY_TYPES}


def pipeline_floor(settings: Settings) -> float:
    """What detection may already drop."""
    return min(thresholds(settings).values())


def above_thresholds(spans: Column, settings: Settings) -> Column:
    return F.filter(spans, lambda s: s["score"] >= F.coalesce(lookup(thresholds(settings), s["entity_type"]), F.lit(settings.slider)))


# ---- allow and block lists


def pattern_regex(pattern: str) -> str:
    """Whole words, any case; * is one or more word characters. Java syntax."""
    parts = [re.sub(r"([.+?^${}()|\[\]\\])", r"\\\1", p) for p in pattern.split("*")]
    return r"(?i)(?<![A-Za-z0-9_])(?:" + r"[A-Za-z0-9_]+".join(parts) + r")(?![A-Za-z0-9_])"


def pattern_matches(text: Column, pattern: str, entity_type: str = "MISC", order: int = 0) -> Column:
    return scan(text, pattern_regex(pattern), entity_type, 1.0, order, source="manual")


def allowed_out(spans: Column, allow: Sequence[Entry]) -> Column:
    """Without spans whose whole text an entry matches."""
    if not allow:
        return spans
    any_of = "|".join(f"(?:{pattern_regex(e.pattern)})" for e in allow)
    return F.filter(spans, lambda s: ~s["text"].rlike(f"^(?:{any_of})$"))


def allowed_out_of_text(spans: Column, text: Column, allow: Sequence[Entry]) -> Column:
    """Also without spans inside a stretch of the text that an entry matches."""
    if not allow:
        return spans
    ranges = F.concat(*(pattern_matches(text, e.pattern) for e in allow))
    return F.filter(allowed_out(spans, allow), lambda s: ~F.exists(ranges, lambda r: (r["start"] <= s["start"]) & (r["end"] >= s["end"])))


def blocked_in(spans: Column, text: Column, block: Sequence[Entry]) -> Column:
    """With a manual span for each match of an entry that isn't a span already. Offsets
    are bytes, like all others, and overlaps are resolved, the manual span first."""
    for i, e in enumerate(block):
        own = pattern_matches(text, e.pattern, "MISC" if e.scope == "any" else e.scope, 2000 + i)
        before = spans
        spans = F.concat(before, F.filter(own, lambda m: ~F.exists(before, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]))))
    return merged(spans) if block else spans


# ---- feedback


def adaptive_thresholds(log: DataFrame, base: float) -> DataFrame:
    """entity_type, threshold: raised by up to 0.2 for types that are dismissed, lowered
    for types that are missed. log: detected_type, corrected_type (NOT_PII: dismissed)."""
    kind = F.when(F.col("detected_type").isNotNull() & (F.col("corrected_type") == "NOT_PII"), F.lit("dismissed")).when(F.col("detected_type").isNull() & (F.col("corrected_type") != "NOT_PII"), F.lit("added"))
    rows = log.withColumn("kind", kind).where("kind IS NOT NULL").withColumn("entity_type", F.coalesce("detected_type", "corrected_type"))
    rate = F.avg(F.when(F.col("kind") == "dismissed", 1.0).otherwise(0.0))
    return rows.groupBy("entity_type").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.lit(base) + (rate - 0.5) * 0.4)).alias("threshold"))


def above_adaptive(spans: DataFrame, adaptive: DataFrame, default: float) -> DataFrame:
    """Long spans at or above their type's threshold. The table has a row for each type;
    Spark broadcasts it if it is small."""
    known = adaptive.select("entity_type", F.col("threshold").alias("least__"))
    return spans.join(known, "entity_type", "left").where(F.col("score") >= F.coalesce("least__", F.lit(default))).drop("least__")


# ---- the chain


def review(df: DataFrame, settings: Settings = Settings(), text: str = "text", regions: str | None = None) -> DataFrame:
    """Groups, allow list, thresholds, block list, then a tag for code blocks, in this order.
    regions: a column of byte ranges of code; adds in_code (an array beside spans)."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = computed(df, "spans", in_enabled_groups(F.col("spans"), settings.groups_on))
    df = computed(df, "spans", allowed_out_of_text(F.col("spans"), t, settings.allow))
    df = computed(df, "spans", above_thresholds(F.col("spans"), settings))
    df = computed(df, "spans", blocked_in(F.col("spans"), t, settings.block))
    if regions is None:
        return df
    return df.withColumn("in_code", F.transform("spans", lambda s: F.exists(regions, lambda r: (r["start"] <= s["start"]) & (s["start"] < r["end"]))))


def auto_approved(spans: Column, in_code: Column, least: float) -> Column:
    """Spans outside code at or above a score."""
    return F.transform(F.filter(F.arrays_zip(spans.alias("s"), in_code.alias("c")), lambda z: ~z["c"] & (z["s"]["score"] >= least)), lambda z: z["s"])


def conflicts(allow: DataFrame, block: DataFrame) -> DataFrame:
    """Entries on both lists, compared without case and surrounding or repeated blanks."""
    from spanlake.functions.text import normalized_key

    return allow.select(F.col("pattern").alias("allowed"), normalized_key(F.col("pattern")).alias("k")).join(block.select(F.col("pattern").alias("blocked"), normalized_key(F.col("pattern")).alias("k")), "k").drop("k")


def public_domain(entry: Column) -> Column:
    return normalized_domain(entry)


def without_known_replacements(spans: Column, emitted: Column) -> Column:
    """Without spans whose trimmed text is a replacement that was emitted before."""
    return F.filter(spans, lambda s: ~F.array_contains(emitted, F.trim(s["text"])))
