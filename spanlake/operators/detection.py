"""The detection pipeline: texts and options to scored, disjoint spans.

Each stage is a column expression; only path ends need Python, and only for
texts with a slash. Nothing is shuffled, unless a model's spans are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.config import Config
from spanlake.functions.checksum import valid
from spanlake.functions.spans import SPANS, boosted, byte_slice, computed, confident, merged, no_spans, overlaps, recognized, scan, span
from spanlake.functions.urls import private_links, private_url
from spanlake.operators.paths import path_candidates, private_paths

# Secrets, our own design: type, what comes before (no part of the span), pattern.
SECRETS = (
    ("SECRET", None, r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("SECRET", None, r"\bgh[pousr]_[A-Za-z0-9]{36,}\b|\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("SECRET", None, r"\bsk-(?:ant-|proj-)?[A-Za-z0-9_\-]{20,}"),
    ("SECRET", None, r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    ("SECRET", None, r"\bxox[abeoprs]-[A-Za-z0-9\-]{10,}"),
    ("SECRET", None, r"\bAIza[0-9A-Za-z_\-]{35}"),
    ("SECRET", None, r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}"),
    ("SECRET", None, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("PASSWORD", r"""(?i)(?:password|passwd|pwd|passphrase)["']?\s*(?::=|=|:)\s*["']""", r"""[^"'\s]{4,}(?=["'])"""),
    ("SECRET", r"""(?i)(?:api[_\-]?key|secret|token|access[_\-]?key)["']?\s*(?::=|=|:)\s*["']""", r"""[^"'\s]{8,}(?=["'])"""),
    ("USERNAME", r"\b[a-z][a-z0-9+.\-]*://", r"[^\s:/@]+(?=:[^\s/@]+@)"),
    ("PASSWORD", r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:", r"[^\s/@]+(?=@)"),
    ("HOSTNAME", r"\b[a-z][a-z0-9+.\-]*://[^\s:/@]+:[^\s/@]+@", r"[A-Za-z0-9.\-]+"),
)
SECRET_SCORE = 0.90
#: For each of them, what a text must have for the pattern to be tried.
SECRET_NEEDS = ("AKIA|ASIA", "gh[pousr]_|github_pat_", "sk-", "k_(?:live|test)_", "xox", "AIza", "eyJ", "PRIVATE KEY", "(?i)pass|pwd", "(?i)api|secret|token|access", "://", "://", "://")
#: Values that stand for one: calls, lookups of the environment, templates, placeholders.
NO_SECRET = r"(?i)^(?:\$\{.*\}|\{\{.*\}\}|<.*>|\$[A-Za-z_]+|%\(.*|.*\(.*\)|(?:process\.env|os\.environ|env)\b.*|x{4,}|\*{4,}|changeme.*|your[_\-].*|example.*|placeholder.*)$"


def secrets(text: Column) -> Column:
    found = []
    for i, (entity_type, before, pattern) in enumerate(SECRETS):
        own = F.when(text.rlike(SECRET_NEEDS[i]), scan(text, pattern, entity_type, SECRET_SCORE, 20 + i, prefix=before)).otherwise(no_spans())
        if before and entity_type != "HOSTNAME":
            own = F.filter(own, lambda s: ~s["text"].rlike(NO_SECRET))
        if before and entity_type == "SECRET":  # a token looks random: digits and letters
            own = F.filter(own, lambda s: s["text"].rlike("[0-9]") & s["text"].rlike("[A-Za-z]"))
        found.append(own)
    return F.concat(*found)


#: What may stand before a path; as a look-behind.
BOUNDARY = r"""(?<=^|file://|[\s"'`=(\[{,:;>~])"""


def infrastructure(text: Column) -> Column:
    """Internal host names, and account names in home paths."""
    suffixed = text.rlike(r"(?i)\.(?:internal|intranet|intra|corp|local|lan|localdomain)")
    hosts = F.when(suffixed, scan(text, rules.INTERNAL_HOST, "HOSTNAME", rules.INTERNAL_HOST_SCORE, 60)).otherwise(no_spans())
    homes = F.contains(text, F.lit("/home/")) | F.contains(text, F.lit("Users"))
    users = F.when(homes, scan(text, rules.ACCOUNT, "USERNAME", rules.HOME_USER_SCORE, 61, prefix=BOUNDARY + rules.HOME_PATH)).otherwise(no_spans())
    return F.concat(hosts, F.filter(users, lambda s: ~F.lower(s["text"]).isin(*rules.SHARED_HOMES[:6])))


def with_code(found: Column, code: Column) -> Column:
    """Credentials displace what they overlap; host names give way to all else."""
    host = F.filter(code, lambda s: s["entity_type"] == "HOSTNAME")
    credential = F.filter(code, lambda s: s["entity_type"] != "HOSTNAME")
    kept = F.concat(F.filter(found, lambda s: ~F.exists(credential, lambda c: overlaps(c, s))), credential)
    return F.concat(kept, F.filter(host, lambda h: ~F.exists(kept, lambda s: overlaps(s, h))))


def with_links(found: Column, links: Column) -> Column:
    """A private link or path displaces everything within it."""
    return F.concat(F.filter(found, lambda s: ~F.exists(links, lambda x: overlaps(x, s))), links)


def candidates(df: DataFrame, config: Config = Config(), text: str = "text") -> DataFrame:
    """df with found (pattern spans) and paths (all path candidates)."""
    t = F.coalesce(F.col(text), F.lit(""))
    if not config.regex_enabled:
        return df.withColumns({"paths": no_spans(), "found": no_spans()})
    df = computed(computed(df, "paths", path_candidates(t)), "found", recognized(t))
    if config.code_mode != "off":
        df = computed(df, "code__", F.concat(secrets(t), infrastructure(t)))
        df = computed(df, "found", with_code(F.col("found"), F.col("code__"))).drop("code__")
    df = computed(df, "links__", F.concat(private_links(t, config.public_domains), private_paths(F.col("paths"))))
    return computed(df, "found", with_links(F.col("found"), F.col("links__"))).drop("links__")


def model_spans(given: Column, text: Column, public_domains: tuple[str, ...] = ()) -> Column:
    """A model's spans that are sound: within the text, on character bounds, scored
    from 0 to 1; links only if private. Their text is cut anew."""
    raw = F.encode(text, "UTF-8")
    inner = lambda at: ~F.hex(F.call_function("substring", raw, at + 1, F.lit(1))).rlike("^[89AB]")  # noqa: E731  not within a character
    sound = F.filter(
        given,
        lambda s: (s["source"] == "ner") & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.octet_length(text)) & inner(s["start"]) & inner(s["end"]) & ~F.isnan(s["score"]) & s["score"].between(0.0, 1.0),
    )
    cut = F.transform(sound, lambda s: s.withField("text", byte_slice(text, s["start"], s["end"])).withField("ord", (s["ord"] + 1000).cast("int")))
    return F.filter(cut, lambda s: (s["entity_type"] != "URL") | private_url(s["text"], public_domains))


# Fixed value: types that make a path private.
REVEALING = ("PERSON", "USERNAME", "ORGANIZATION", "EMAIL", "ADDRESS", "PHONE", "MISC")


def promoted(df: DataFrame, minimum: float, text: str = "text") -> DataFrame:
    """Paths that hold a revealing, confident model span are private: the path, widened
    over such spans on its line, becomes a FILE_PATH; pattern and model spans within go."""
    t = F.coalesce(F.col(text), F.lit(""))
    names = F.filter(confident(F.col("model"), minimum), lambda s: s["entity_type"].isin(*REVEALING))

    def widen(p: Column) -> Column:
        inside = F.filter(names, lambda s: overlaps(s, p) & ~F.contains(s["text"], F.lit("\n")))
        start = F.least(p["start"], F.coalesce(F.array_min(F.transform(inside, lambda s: s["start"])), p["start"]))
        end = F.greatest(p["end"], F.coalesce(F.array_max(F.transform(inside, lambda s: s["end"])), p["end"]))
        return F.when(F.size(inside) > 0, span(start, end, F.lit("FILE_PATH"), F.lit(rules.PATH_SCORE), byte_slice(t, start, end), F.lit("regex"), F.lit(500)))

    df = computed(df, "wide__", F.filter(F.transform("paths", widen), lambda p: p.isNotNull()))
    outside = lambda s: ~F.exists(F.col("wide__"), lambda p: overlaps(p, s))
    return df.withColumn("found", F.concat(F.filter("found", outside), F.col("wide__"))).withColumn("model", F.filter("model", outside)).drop("wide__")


def detect(df: DataFrame, config: Config = Config(), text: str = "text", model: str | None = None) -> DataFrame:
    """df with spans: ARRAY<STRUCT> of what was detected in its text column. model names
    a column of a model's spans. Null and empty texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    given = F.col(model).cast(SPANS) if model else no_spans()
    out = candidates(df, config, text)
    if model:
        out = computed(out, "model", model_spans(F.coalesce(given, no_spans()), t, config.public_domains))
        if config.regex_enabled:
            out = promoted(out, config.min_confidence, text)
    else:
        out = out.withColumn("model", no_spans())
    out = computed(out, "all__", F.concat(F.filter("found", valid), F.col("model"))).drop("found", "model", "paths")
    out = computed(out, "all__", boosted(F.col("all__"), t, config.context_window, config.context_boost))
    return computed(out, "spans", confident(merged(F.col("all__")), config.min_confidence)).drop("all__")


def with_external_spans(df: DataFrame, spans: DataFrame, key: str, config: Config = Config(), text: str = "text") -> DataFrame:
    """detect() with a model's spans from a long table (key, start, end, entity_type, score)."""
    own = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("entity_type"), F.col("score").cast("double").alias("score"), F.lit("").alias("text"), F.lit("ner").alias("source"), F.lit(0).alias("ord")))).cast(SPANS).alias("given__"))
    return detect(df.join(own, key, "left"), config, text, "given__").drop("given__")


def long(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """One row for each span."""
    return df.select(key, F.explode(spans).alias("s")).select(key, "s.start", "s.end", "s.entity_type", "s.score", "s.text", "s.source")
