"""Replacing spans: numbering, splicing, the vault."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.functions.spans import computed, let
from spanlake.functions.text import normalized_key
from spanlake.plans.order import placed
from spanlake.plans.scratch import stored


def placeholder(entity_type: Column, index: Column) -> Column:
    return F.format_string("[%s_%d]", entity_type, index)


def bare(token: Column) -> Column:
    """A placeholder without brackets, as it stands within identifiers."""
    return F.regexp_replace(token, r"^\[([A-Z_]+_[0-9]+)\]$", "$1")


def parsed(token: Column) -> Column:
    """STRUCT(type, index) of a placeholder; null for other texts."""
    m = r"^\[([A-Z]+(?:_[A-Z]+)*)_([0-9]+)\]$"
    return F.when(token.rlike(m), F.struct(F.regexp_extract(token, m, 1).alias("type"), F.regexp_extract(token, m, 2).try_cast("long").alias("index")))


PLACEHOLDER = r"\[([A-Z]+(?:_[A-Z]+)*)_([0-9]+)\]"


def observed_tokens(text: Column, types: tuple[str, ...]) -> Column:
    """Distinct placeholders of known types in a text, in order."""
    every = F.regexp_extract_all(text, F.lit(f"({PLACEHOLDER})"), 1)
    return F.array_distinct(F.filter(every, lambda t: parsed(t)["type"].isin(*types)))


def spliced(text: Column, spans: Column, replacement: Callable[[Column], Column]) -> Column:
    """text with each span replaced; spans sorted and disjoint. replacement: span -> Column. The text is
    encoded once, and its pieces are joined once."""

    def put(raw: Column, own: Column) -> Column:
        piece = lambda a, b: F.call_function("substring", raw, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")).cast("string")
        end = lambda i: F.coalesce(F.get(own, i)["end"], F.lit(0))
        parts = F.transform(own, lambda s, i: F.concat(piece(end(i - 1), s["start"]), F.coalesce(replacement(s), F.lit(""))))
        return F.concat(F.array_join(parts, ""), piece(end(F.size(own) - 1), F.octet_length(raw)))

    return F.when(F.size(spans) == 0, text).otherwise(let(F.encode(text, "UTF-8"), lambda raw: let(spans, lambda own: put(raw, own))))


def entity_map(spans: DataFrame, key: str, reserved: DataFrame | None = None) -> DataFrame:
    """key, original, entity_type, token: per key, each distinct text numbered within its
    type by first occurrence; the type is that of the first. spans: long (key, start,
    entity_type, text). reserved: (key, entity_type, index) of tokens already in the text."""
    first = spans.groupBy(key, "text").agg(F.min(F.struct("start", "entity_type")).alias("f"))
    first = first.select(key, F.col("text").alias("original"), "f.entity_type", "f.start")
    n = F.row_number().over(Window.partitionBy(key, "entity_type").orderBy("start", "original"))
    if reserved is not None:
        most = reserved.groupBy(key, "entity_type").agg(F.max("index").alias("most__"))
        first = first.join(most, [key, "entity_type"], "left")
        n = n + F.coalesce("most__", F.lit(0))
    return first.withColumn("token", placeholder(F.col("entity_type"), n)).select(key, "original", "entity_type", "token")


def anonymized(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df (with spans) plus redacted and entity_map (token -> original) of each row, without a
    shuffle: the numbers of a row depend on that row alone. Numbers that its text already
    has in brackets are passed over."""
    t = F.coalesce(F.col(text), F.lit(""))
    texts = F.array_distinct(F.transform("spans", lambda s: s["text"]))
    first = F.transform(texts, lambda x: F.element_at(F.filter("spans", lambda s: s["text"] == x), 1))
    df = computed(computed(df, "first__", first), "kept__", F.transform(F.regexp_extract_all(t, F.lit(f"({PLACEHOLDER})"), 1), parsed))

    def number(s: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(F.col("first__"), F.lit(1), i + 1), lambda o: o["entity_type"] == s["entity_type"]))
        most = F.coalesce(F.array_max(F.transform(F.filter("kept__", lambda k: k["type"] == s["entity_type"]), lambda k: k["index"])), F.lit(0))
        return placeholder(s["entity_type"], before + most)

    df = computed(df, "pairs__", F.transform("first__", lambda s, i: F.struct(s["text"].alias("original"), number(s, i).alias("token"))))
    token = lambda s: F.element_at(F.filter("pairs__", lambda p: p["original"] == s["text"]), 1)["token"]
    df = computed(df, "redacted", spliced(t, F.col("spans"), token))
    pairs = F.map_from_entries(F.transform("pairs__", lambda p: F.struct(p["token"], p["original"])))
    return computed(df, "entity_map", pairs).drop("first__", "kept__", "pairs__")


VAULT = "id string, original_text string, normalized_key string, entity_type string, placeholder string, index long, synthetic_value string, mode string, pinned boolean, first_key long, usage_count long"


def identities(spans: DataFrame, key: str) -> DataFrame:
    """entity_type, normalized_key, k, start, original_text of each identity's first span, and
    how often it is used. spans: long (key, start, entity_type, text)."""
    own = spans.select(F.col(key).alias("k"), "start", "entity_type", F.col("text").alias("original_text"), normalized_key(F.col("text")).alias("normalized_key")).where("normalized_key != ''")
    seen = own.groupBy("entity_type", "normalized_key").agg(F.min(F.struct("k", "start", "original_text")).alias("f"), F.count("*").alias("used"))
    return stored(seen.select("entity_type", "normalized_key", "f.k", "f.start", "f.original_text", "used"), "identities")


def numbered(seen: DataFrame, vault: DataFrame | None = None, counters: Mapping[str, int] | None = None) -> DataFrame:
    """Vault records of those of identities() that the vault lacks, numbered per type on from
    what it has (or from counters, by type), in the order (k, start). Keys are of any type with an order.

    Numbering is global, but no task sees a whole type: identities are sorted by type
    and key, take their places in that order, and each type begins at its least place.
    """
    spark = seen.sparkSession
    if vault is not None:
        seen = seen.join(vault.select("entity_type", "normalized_key"), ["entity_type", "normalized_key"], "left_anti")
    new = placed(seen, ["entity_type", "k", "start", "normalized_key"], "numbered")
    begins = new.groupBy("entity_type").agg(F.min("pos").alias("begins"))
    if counters is not None:
        most = spark.createDataFrame([*counters.items()], "entity_type string, most long")
        begins = begins.join(most, "entity_type", "left")
    elif vault is not None:
        begins = begins.join(vault.groupBy("entity_type").agg(F.max("index").alias("most")), "entity_type", "left")
    else:
        begins = begins.withColumn("most", F.lit(0).cast("long"))
    new = new.join(F.broadcast(begins), "entity_type")  # a row for each type
    index = (F.col("pos") - F.col("begins") + 1 + F.coalesce("most", F.lit(0))).cast("long")
    return new.withColumn("index", index).select(
        F.sha1(F.concat_ws("\x1f", "entity_type", "normalized_key")).alias("id"), "original_text", "normalized_key", "entity_type",
        placeholder(F.col("entity_type"), F.col("index")).alias("placeholder"), "index", stand_in(F.col("entity_type"), F.col("index"), F.col("original_text")).alias("synthetic_value"),
        F.lit("placeholder").alias("mode"), F.lit(False).alias("pinned"), F.col("k").alias("first_key"), F.col("used").alias("usage_count"),
    )


def vault_update(spans: DataFrame, key: str, vault: DataFrame | None = None) -> DataFrame:
    """The vault with the identities of long spans (key, start, entity_type, text). Identities are
    written once; the spans are read once."""
    seen = identities(spans, key)
    new = numbered(seen, vault)
    if vault is None:
        return new
    known = vault.join(seen.select("entity_type", "normalized_key", "used"), ["entity_type", "normalized_key"], "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("used", F.lit(0))).drop("used")
    return known.select(*new.columns).unionByName(new)


def active(mode: Column, placeholder_: Column, synthetic_: Column) -> Column:
    """The replacement a record gives: its synthetic value if it is set to that and has one."""
    return F.when((mode == "synthetic") & (synthetic_ != ""), synthetic_).otherwise(placeholder_)


def with_vault(df: DataFrame, vault: DataFrame, key: str, text: str = "text", spans: DataFrame | None = None) -> DataFrame:
    """df plus redacted, by the vault's replacements of its spans, or of those of the table
    spans (key, spans). Joined on type and key."""
    known = vault.select("entity_type", "normalized_key", active(F.col("mode"), F.col("placeholder"), F.col("synthetic_value")).alias("token"))
    rows = (df if spans is None else spans).select(key, F.explode("spans").alias("s")).select(key, "s", F.col("s.entity_type").alias("entity_type"), normalized_key(F.col("s.text")).alias("normalized_key"))
    tokens = rows.join(known, ["entity_type", "normalized_key"], "left").groupBy(key).agg(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.coalesce("token", F.col("s.text")).alias("token"))).alias("t__"))
    joined = df.join(tokens, key, "left")
    t = F.coalesce(F.col(text), F.lit(""))
    return joined.withColumn("redacted", spliced(t, F.array_sort(F.coalesce("t__", F.array().cast("array<struct<start:int,end:int,token:string>>"))), lambda s: s["token"])).drop("t__")


def vault_edit(vault: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: id, mode, synthetic_value, pinned (null: unchanged), deleted. Unknown ids do nothing."""
    e = edits.select("id", *(F.col(c).alias(f"new_{c}") for c in ("mode", "synthetic_value", "pinned")), "deleted")
    out = vault.join(e, "id", "left").where("deleted IS NULL OR NOT deleted")
    for c in ("mode", "synthetic_value", "pinned"):
        out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    return out.select(*vault.columns)


def recent(vault: DataFrame, order: str = "first_key") -> DataFrame:
    return vault.orderBy(F.desc(order), "id")


def synthetic(entity_type: Column, index: Column) -> Column:
    """The pool's value for an index from 1 on; types without a pool have none ('')."""
    name = F.lower(_pooled(rules.POOLS["PERSON"], index))
    local = F.regexp_replace(F.regexp_replace(name, "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    out = F.when(entity_type == "EMAIL", F.concat(local, F.lit("@"), _cycled(rules.EMAIL_DOMAINS, index)))
    for t, values in rules.POOLS.items():
        out = out.when(entity_type == t, _pooled(values, index))
    return out.otherwise(F.lit(""))


def stand_in(entity_type: Column, index: Column, original: Column) -> Column:
    """synthetic(), and for links and paths one that keeps the original's shape."""
    from spanlake.operators import synthetic as shapes

    only = lambda t: F.when(entity_type == t, original).otherwise(F.lit(""))
    return F.when(entity_type == "URL", shapes.links(only("URL"))).when(entity_type == "FILE_PATH", shapes.paths(only("FILE_PATH"))).otherwise(synthetic(entity_type, index))


def _cycled(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(index - 1, F.lit(len(values))) + 1).cast("int"))


def _pooled(values: list[str], index: Column) -> Column:
    """Later rounds get the round as a suffix, behind a dash if the value is a number."""
    value, round_ = _cycled(values, index), F.floor((index - 1) / len(values))
    return F.when(round_ > 0, F.concat(value, F.when(value.rlike(r"^[0-9\s+\-()]+$"), "-").otherwise(" "), (round_ + 1).cast("string"))).otherwise(value)
