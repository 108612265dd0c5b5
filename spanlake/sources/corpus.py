"""Corpora: validated JSON lines, raw records under several field names, sinks, stores."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.arrow import arrow
from spanlake import rules
from spanlake.functions.text import corpus_label, language, length_bucket

GOLD = "array<struct<start:int,end:int,entity_type:string,text:string>>"
EXAMPLE = (
    f"recordType string, id string, language string, lengthBucket string, text string, goldSpans {GOLD}, "
    "source struct<dataset:string,recordId:string,split:string,uid:string,region:string,script:string,sourceFile:string,sourceRow:bigint>"
)
METADATA = "recordType string, schemaVersion int, corpusId string, description string, createdAt string, spanOffsetUnit string"


def read_corpus(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """Examples of a JSON lines corpus, typed and checked: line, error and EXAMPLE's fields.

    Blank lines are skipped. error says what is wrong with a line; with fail, a
    wrong line stops the query. That there is one metadata row and at least one
    example is checked by check_corpus(). Lines are numbered per file, by their bytes'
    places: lines are counted per part of a file, and a part's numbers begin after
    the counts of the parts before it.
    """
    parts = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # Within a part, ids ascend in the order of lines.
    parts = parts.withColumn("id", F.monotonically_increasing_id())
    seen = parts.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = seen.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    lines = parts.join(seen, ["file", "block"]).select("value", (F.col("id") + F.col("shift")).alias("line")).where(F.length(F.trim("value")) > 0)
    row = F.from_json("value", EXAMPLE + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    got = lines.withColumn("r", row).where(F.coalesce(F.col("r.recordType"), F.lit("")) != "metadata")
    checked = got.select("line", "r.*").withColumn("error", example_error())
    if fail:
        checked = checked.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line"), F.lit(": "), F.col("error")))))
    return checked.drop("_corrupt_record")


def example_error() -> Column:
    """What is wrong with an example's columns; null if nothing is."""
    raw = F.encode("text", "UTF-8")
    piece = lambda s: F.call_function("substring", raw, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0))).cast("string")
    bad = F.exists("goldSpans", lambda s: F.coalesce((s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.octet_length("text")) | (piece(s) != s["text"]) | ~s["entity_type"].isin(*rules.ENTITY_TYPES), F.lit(True)))
    return (
        F.when(F.col("_corrupt_record").isNotNull(), "not a JSON object of the expected types")
        .when(F.coalesce("recordType", F.lit("")) != "example", "recordType must be example")
        .when(F.coalesce("id", F.lit("")) == "", "id is missing")
        .when(~F.coalesce(F.col("language"), F.lit("")).isin("en", "de"), "language must be en or de")
        .when(~F.coalesce(F.col("lengthBucket"), F.lit("")).isin("short", "medium", "long"), "lengthBucket is unknown")
        .when(F.col("text").isNull(), "text is missing")
        .when(F.col("goldSpans").isNull(), "goldSpans is missing")
        .when(bad, "a gold span isn't a slice of the text with a known type")
        .when(F.col("source.dataset").isNull() | F.col("source.recordId").isNull(), "source is incomplete")
    )


def check_corpus(spark: SparkSession, path: str) -> None:
    """Raise unless there is one metadata row, of the right unit, and an example."""
    is_meta = F.col("recordType") == "metadata"
    rows = spark.read.schema(METADATA).json(path).agg(F.count_if(is_meta).alias("metadata"), F.min(F.when(is_meta, F.col("spanOffsetUnit"))).alias("unit"), F.count_if(F.col("recordType") == "example").alias("examples")).first()
    if rows["metadata"] != 1:
        raise ValueError("a corpus has exactly one metadata row")
    if rows["unit"] != "utf8-bytes":
        raise ValueError("spanOffsetUnit must be utf8-bytes")
    if not rows["examples"]:
        raise ValueError("a corpus has at least one example")


def write_corpus(examples: DataFrame, path: str, corpus_id: str, description: str = "", created: str = "1970-01-01T00:00:00Z") -> None:
    """Metadata and examples as JSON lines. Spark's commit makes the write atomic; the
    result is read again and checked."""
    spark = examples.sparkSession
    meta = spark.createDataFrame([(json.dumps({"recordType": "metadata", "schemaVersion": 1, "corpusId": corpus_id, "description": description, "createdAt": created, "spanOffsetUnit": "utf8-bytes"}),)], "value string")
    rows = examples.select(F.to_json(F.struct(*[c for c in examples.columns if c not in ("line", "error")])).alias("value"))
    meta.unionByName(rows).write.text(path)
    check_corpus(spark, path)


def write_report(df: DataFrame, path: str) -> None:
    """Pretty JSON, one object a row."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.text(path)


JOINED_LINES = 50


def records_of(text: str) -> Iterator[dict]:
    """Records of a JSON array, of an object's data or records, or of JSON lines. A line
    that breaks off within a string is joined with the next ones, a line feed between."""
    try:
        whole = json.loads(text)
        if isinstance(whole, dict):
            whole = next((whole[k] for k in ("data", "records") if isinstance(whole.get(k), list)), [whole])
        yield from (r for r in whole if isinstance(r, dict))
        return
    except ValueError:
        pass
    held, count = "", 0
    for n, line in enumerate(text.split("\n"), 1):
        if not held and not line.strip():
            continue
        held, count = (f"{held}\\n{line}" if held else line), count + 1
        try:
            row = json.loads(held)
        except ValueError as e:
            cut = "Unterminated string" in str(e) or e.pos >= len(held.rstrip())
            if not cut or count >= JOINED_LINES:
                raise ValueError(f"line {n}: {e}") from e
            continue
        held, count = "", 0
        if isinstance(row, dict):
            yield row
    if held:
        raise ValueError("the last record breaks off")


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """file, row, json of each record in raw files; a file is one task's work."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path_, content in zip(batch["path"], batch["content"]):
                rows = [(path_, i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records_of(bytes(content).decode("utf-8-sig")))]
                yield pd.DataFrame(rows, columns=["file", "row", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, json string")


def first_of(record: Column, *names: str) -> Column:
    """The first field that is there and not empty."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(record, f"$.{n}")), F.lit("")) for n in names))


SOURCE_SPAN = "start int, end int, value string, label string"


def source_spans(record: Column) -> Column:
    """Either encoding: objects in privacy_mask, or [start, end, label, value] in span_labels
    (which may itself be JSON in a string)."""
    masks = F.from_json(F.get_json_object(record, "$.privacy_mask"), f"array<struct<{SOURCE_SPAN.replace(' int', ':int').replace(' string', ':string')}>>")
    labels = F.from_json(F.get_json_object(record, "$.span_labels"), "array<array<string>>")
    tuples = F.transform(labels, lambda t: F.struct(F.try_element_at(t, F.lit(1)).try_cast("int").alias("start"), F.try_element_at(t, F.lit(2)).try_cast("int").alias("end"), F.try_element_at(t, F.lit(4)).alias("value"), F.try_element_at(t, F.lit(3)).alias("label")))
    return F.coalesce(masks, tuples, F.array().cast("array<struct<start:int,end:int,value:string,label:string>>"))


def resolved_range(text: Column, s: Column) -> Column:
    """Code point range of a source span: its offsets if they cut its value (or it has
    none), else the value's first place in the text; null if neither."""
    size = (s["end"] - s["start"]).cast("int")
    inside = s["start"].isNotNull() & s["end"].isNotNull() & (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text))
    value = F.nullif(s["value"], F.lit(""))
    fits = inside & (value.isNull() | (F.call_function("substring", text, s["start"] + 1, size) == value))
    at = F.call_function("locate", value, text)
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(s["start"].alias("a"), s["end"].alias("b"))).when(F.coalesce(at > 0, F.lit(False)), F.struct((at - 1).alias("a"), (at - 1 + F.length(value)).alias("b")))


def examples_from_raw(raw: DataFrame, dataset: str = "raw") -> DataFrame:
    """EXAMPLE rows of raw records (file, row, json): those with a text and a known language.
    Offsets of the source are code points here, those of the result bytes."""
    r = F.col("json")
    text = first_of(r, "source_text", "unmasked_text", "original_text", "text")
    df = raw.withColumns({"text": text, "language": language(first_of(r, "language", "lang", "locale")), "spans__": source_spans(r)}).where("text IS NOT NULL AND language IS NOT NULL")
    t = F.col("text")
    ranged = F.transform("spans__", lambda s: F.struct(corpus_label(s["label"]).alias("entity_type"), resolved_range(t, s).alias("r")))
    ranged = F.filter(ranged, lambda s: s["entity_type"].isNotNull() & s["r"].isNotNull())
    piece = lambda s: F.call_function("substring", t, (s["r"]["a"] + 1).cast("int"), (s["r"]["b"] - s["r"]["a"]).cast("int"))
    start = lambda s: F.octet_length(F.left(t, s["r"]["a"]))
    gold = F.array_sort(F.transform(ranged, lambda s: F.struct(start(s).alias("start"), (start(s) + F.octet_length(piece(s))).alias("end"), s["entity_type"].alias("entity_type"), piece(s).alias("text"))))
    row = F.coalesce(first_of(r, "sourceRow", "source_row").try_cast("long"), F.col("row"))
    record_id = F.coalesce(first_of(r, "id", "uid", "record_id", "recordId"), row.cast("string"))
    return df.select(
        F.lit("example").alias("recordType"), F.concat_ws("-", F.lit(dataset), "language", record_id).alias("id"), "language", length_bucket(t).alias("lengthBucket"), "text", gold.alias("goldSpans"),
        F.struct(F.coalesce(first_of(r, "dataset"), F.lit(dataset)).alias("dataset"), record_id.alias("recordId"), F.coalesce(first_of(r, "split"), F.lit("validation")).alias("split"), first_of(r, "uid").alias("uid"), first_of(r, "region").alias("region"), first_of(r, "script").alias("script"), first_of(r, "sourceFile", "source_file").alias("sourceFile"), row.alias("sourceRow")).alias("source"),
    )


# ---- summaries and samples


def corpus_summary(examples: DataFrame, key: str = "id", types: str = "types") -> DataFrame:
    """dimension, value, examples: per language, bucket, and distinct type of an example.
    examples: language, length_bucket, and types (an array)."""
    lang = examples.groupBy(F.col("language").alias("value")).agg(F.count("*").alias("examples")).withColumn("dimension", F.lit("language"))
    size = examples.groupBy(F.col("length_bucket").alias("value")).agg(F.count("*").alias("examples")).withColumn("dimension", F.lit("length_bucket"))
    kind = examples.select(F.explode(F.array_distinct(types)).alias("value")).groupBy("value").agg(F.count("*").alias("examples")).withColumn("dimension", F.lit("entity_type"))
    return lang.unionByName(size).unionByName(kind).select("dimension", "value", "examples")


def quota(target: int, keys: list[str]) -> dict[str, int]:
    """target dealt out over keys, the remainder to the first ones; one each if there are more keys."""
    if target <= 0:
        return dict.fromkeys(keys, 0)
    if target < len(keys):
        return dict.fromkeys(keys, 1)
    return {k: target // len(keys) + (i < target % len(keys)) for i, k in enumerate(keys)}


def quota_sample(examples: DataFrame, bucket: str, target: int, keys: list[str], order: str) -> DataFrame:
    """The first examples of each bucket up to its quota, and at most target in all. A bucket
    keeps its least rows while they are read, so none is gathered whole."""
    q = quota(target, keys)
    known = examples.where(F.col(bucket).isin(*keys))
    ranked = known.withColumn("n__", F.row_number().over(Window.partitionBy(bucket).orderBy(order)))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in q.items() for x in kv)), F.col(bucket))
    return ranked.where(F.col("n__") <= limit).drop("n__").orderBy(order).limit(max(target, 0))


def coverage_sample(examples: DataFrame, limit: int, negative: int = 25, misc: int = 50, order: str = "id") -> DataFrame:
    """A sample of at most limit examples (id, language, length_bucket, types) that covers
    language x type x length: quotas for examples without gold, with MISC, and the rest,
    which go to the emptiest of their buckets in order; reserves fill what is left.

    Choosing is sequential, but few rows can be chosen, whatever the table: one that is taken for
    a bucket has before it, in that bucket, only rows that were taken too, so it is among
    the bucket's first limit rows; and reserves are among the first 2 x limit rows of all. These
    (limit x the number of buckets, and 2 x limit) are what one task reads.
    """
    langs, sizes = ["en", "de"], ["short", "medium", "long"]
    supported = [t for t in rules.ENTITY_TYPES if t not in ("MISC", "SECRET", "HOSTNAME", "FILE_PATH", "IDENTIFIER")]
    pairs = [f"{a}:{b}" for a in langs for b in sizes]
    triples = [f"{a}:{t}:{b}" for a in langs for t in supported for b in sizes]
    kind = F.when(F.size("types") == 0, "negative").when(F.array_contains("types", "MISC"), "misc").otherwise("supported")
    keyed = examples.withColumn("kind__", kind)
    of_types = F.transform(F.array_distinct("types"), lambda t: F.concat_ws(":", F.col("language"), t, F.col("length_bucket")))
    buckets = F.when(F.col("kind__") == "supported", of_types).otherwise(F.array(F.concat_ws(":", "language", "length_bucket")))
    each = keyed.select(order, F.explode(buckets).alias("bucket__"), "kind__").where(F.col("bucket__").isin(*pairs, *triples))
    first = each.withColumn("n__", F.row_number().over(Window.partitionBy("kind__", "bucket__").orderBy(order))).where(F.col("n__") <= limit).select(order)
    wanted = first.unionByName(keyed.orderBy(order).limit(2 * limit).select(order)).distinct()
    pool = keyed.join(wanted, order, "left_semi")
    goal = {"negative": min(negative, limit)}
    goal["misc"] = min(misc, limit - goal["negative"])
    goal["supported"] = max(0, limit - goal["negative"] - goal["misc"])
    quotas = {"negative": quota(goal["negative"], pairs), "misc": quota(goal["misc"], pairs), "supported": quota(goal["supported"], triples)}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, used, total, spare = [], {}, dict.fromkeys(goal, 0), []
        rows = pdf.sort_values(order)
        for key, lang, size, types, k in zip(rows[order], rows["language"], rows["length_bucket"], rows["types"], rows["kind"]):
            names = [f"{lang}:{size}"] if k != "supported" else [f"{lang}:{t}:{size}" for t in sorted(set(types)) if t in supported]
            free = sorted((used.get((k, x), 0), quotas[k].get(x, 0), x) for x in names if used.get((k, x), 0) < quotas[k].get(x, 0))
            if free and total[k] < goal[k]:
                used[k, free[0][2]] = free[0][0] + 1
                total[k] += 1
                taken.append(key)
            else:
                spare.append(key)
        taken += spare[: max(0, limit - len(taken))]
        return pdf[pdf[order].isin(taken)][[order]]

    slim = pool.select(order, "language", "length_bucket", "types", F.col("kind__").alias("kind"), F.lit(1).alias("all__"))
    ids = slim.groupBy("all__").applyInPandas(choose, f"{order} {dict(examples.dtypes)[order]}")
    return examples.join(F.broadcast(ids.limit(limit)), order, "left_semi")


# ---- pages and stores

_SKIPPED = {"script", "style", "noscript", "template", "textarea", "input", "select"}


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.stack = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"):
            return
        editable = any(k == "contenteditable" and v != "false" for k, v in attrs)
        self.stack.append((tag, editable or tag in _SKIPPED))

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if data.strip() and not any(skip for _, skip in self.stack):
            self.parts.append(data.strip())


def transcript(html: str | None) -> str | None:
    """The visible text nodes of a page, one to a line."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


@arrow("string")
def page_text(html: pd.Series) -> pd.Series:
    return html.map(transcript)


def newest(df: DataFrame, order: str, keep: int, by: str | None = None) -> DataFrame:
    """The newest rows, of each value of by if given: a top-k."""
    if by is None:
        return df.orderBy(F.desc(order)).limit(keep)
    return df.withColumn("n__", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("n__") <= keep).drop("n__")


HISTORY_KEPT, HISTORY_CLIP, FEEDBACK_KEPT = 50, 20_000, 1000


def history(entries: DataFrame) -> DataFrame:
    """One entry for each id (the newest), clipped texts, the newest HISTORY_KEPT."""
    one = entries.withColumn("n__", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("created")))).where("n__ = 1").drop("n__")
    clipped = one.withColumns({"truncated": (F.length("original") > HISTORY_CLIP) | (F.length("anonymized") > HISTORY_CLIP), "original": F.left("original", F.lit(HISTORY_CLIP)), "anonymized": F.left("anonymized", F.lit(HISTORY_CLIP))})
    return newest(clipped, "created", HISTORY_KEPT)


def feedback(log: DataFrame) -> DataFrame:
    return newest(log, "timestamp", FEEDBACK_KEPT)


def conversations(flat: DataFrame, mapped: DataFrame) -> DataFrame:
    """conversation, tokens, originals of two stored forms: flat (conversation, token) and
    mapped (conversation, token, original); an original that is known once is kept."""
    rows = flat.select("conversation", "token", F.lit(None).cast("string").alias("original")).unionByName(mapped.select("conversation", "token", "original"))
    one = rows.groupBy("conversation", "token").agg(F.max("original").alias("original"))
    return one.groupBy("conversation").agg(F.array_sort(F.collect_set("token")).alias("tokens"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("original").isNotNull(), F.struct("token", "original"))))).alias("originals"))


def valid_vault(stored: DataFrame) -> DataFrame:
    """Records that are whole; others are dropped."""
    token = F.concat(F.lit(r"^\["), F.col("entity_type"), F.lit(r"_[0-9]+\]$"))
    return stored.where(F.col("id").isNotNull() & F.col("original_text").isNotNull() & F.col("entity_type").isin(*rules.ENTITY_TYPES) & F.call_function("regexp_like", F.col("placeholder"), token))


