"""One query for each operator, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.code import columns as code
from spanlake.config import Config, parsed_config
from spanlake.functions import checksum, spans, text, urls
from spanlake.operators import aliases, detection, models, pseudonym, restore, review, scoring, symbols, synthetic
from spanlake.operators.vault_table import VaultTable
from spanlake.plans import fixtures, planted
from spanlake.plans.scratch import scratch, stored
from spanlake.sources import corpus
from spanlake.streaming import observe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def found(spark: SparkSession, sf_dir: str, config: Config = Config()) -> DataFrame:
    return detection.detect(documents(spark, sf_dir), config)


def found_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, spans of the documents with a span, written, for queries that use them several times."""
    return stored(found(spark, sf_dir).where(F.size("spans") > 0).select("doc_id", "spans"), "spans")


def found_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.long(found(spark, sf_dir), "doc_id")


# ---- recognizers


def _scan(kind: str) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = spans.computed(documents(spark, sf_dir), "c", spans.recognized(F.col("text"), (kind,))).select("doc_id", F.explode("c").alias("s"))
        return got.select("doc_id", "s.start", "s.end", "s.text", "s.score")

    return run


NAMES = {"scan_email": "EMAIL", "scan_phone": "PHONE", "scan_ssn": "SSN", "scan_card": "CREDIT_CARD", "scan_ip": "IP_ADDRESS", "scan_iban": "IBAN", "scan_date": "DATE"}
QUERIES.update({name: _scan(kind) for name, kind in NAMES.items()})


@query
def scan_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fixtures.texts(documents(spark, sf_dir)).select("id", F.explode(spans.recognized(F.col("text"))).alias("s"))
    return got.select("id", "s.start", "s.end", "s.entity_type", "s.text", "s.score")


@query
def luhn_valid_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans.computed(documents(spark, sf_dir), "c", spans.recognized(F.col("text"), ("CREDIT_CARD",))).select("doc_id", F.explode("c").alias("s"))
    return got.where(checksum.luhn(F.col("s.text"))).select("doc_id", "s.start", "s.text")


@query
def checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.each(documents(spark, sf_dir), fixtures.NUMBERS, "text, entity_type").select("id", "entity_type", checksum.valid(F.struct("entity_type", "text")).alias("valid"))


@query
def context_boosted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    df = spans.computed(documents(spark, sf_dir), "c", F.filter(spans.recognized(t), checksum.valid))
    got = spans.computed(df, "c", spans.boosted(F.col("c"), t)).select("doc_id", F.explode("c").alias("s"))
    return got.select("doc_id", "s.start", "s.end", "s.entity_type", "s.text", "s.score")


@query
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    df = spans.computed(documents(spark, sf_dir), "c", F.filter(spans.recognized(t), checksum.valid))
    df = spans.computed(spans.computed(df, "c", spans.boosted(F.col("c"), t)), "c", spans.merged(F.col("c")))
    return df.select("doc_id", F.explode("c").alias("s")).select("doc_id", "s.start", "s.end", "s.entity_type", "s.score")


@query
def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_long(spark, sf_dir)


@query
def detect_code_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection.long(found(spark, sf_dir, Config(code_mode="secrets")), "doc_id")


@query
def spans_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_long(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query
def spans_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("lang").agg(F.sum(F.size("spans")).cast("long").alias("n"))


@query
def spans_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.counts_by_source(found_long(spark, sf_dir))


@query
def external_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's spans (here: the first word of every third document, some unsound) joined in."""
    docs = documents(spark, sf_dir)
    first = F.octet_length(F.regexp_extract("text", r"^[^\s]+", 0))
    model = docs.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 2 == 0, 0).otherwise(-1).alias("start"), first.alias("end"), F.lit("PERSON").alias("entity_type"), F.when(F.col("doc_id") % 9 == 0, 0.5).otherwise(0.9).alias("score")).where("end > 0")
    got = detection.with_external_spans(docs, model, "doc_id")
    return detection.long(got, "doc_id").where("source = 'ner'").select("doc_id", "start", "end", "entity_type", "score", "text")


@query
def config_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(1, "{}"), (2, '{"min_confidence":0.7,"code_mode":"full"}'), (3, "not json"), (4, '{"code_mode":"odd","context_window":2,"ner_enabled":true}'), (5, None)]
    got = fixtures.each(documents(spark, sf_dir), cases, "case_id, j").select("id", parsed_config(F.col("j")).alias("c"))
    return got.select("id", "c.min_confidence", "c.context_boost", "c.context_window", "c.ner_enabled", "c.code_mode", "c.regex_enabled")


# ---- links and paths


@query
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = urls.url_parts(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", *(p[k].alias(k) for k in ("scheme", "host", "path", "query", "fragment")))


@query
def url_private_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.private_url(F.col("url")).alias("private"))


@query
def url_private_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.each(documents(spark, sf_dir), [(u,) for u in fixtures.URLS], "url").select("id", urls.private_url(F.col("url"), ("www.unknown.biz",)).alias("private"))


@query
def path_private_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.each(documents(spark, sf_dir), [(p,) for p in fixtures.PATHS], "path").select("id", urls.private_path(F.col("path")).alias("private"))


@query
def url_hosts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = urls.url_parts(F.col("url"))["host"]
    return table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "host").limit(10)


@query
def private_links_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fixtures.texts(documents(spark, sf_dir)).select("id", F.explode(urls.private_links(F.col("text"))).alias("s"))
    return got.select("id", "s.start", "s.end", "s.text")


@query
def domains_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalized_domain(F.col("url")).alias("domain"))


@query
def page_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", corpus.page_text("html").alias("text"))


# ---- filters

SLIDER = review.Settings(slider=0.1)
BY_GROUP = review.Settings(slider=0.5, individual=True, group_sliders={"Contact": 0.0, "Network": 1.0})
LISTED = tuple(review.Entry(p, s) for p, s in fixtures.LISTS)


@query
def thresholded_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans.computed(found(spark, sf_dir), "spans", review.above_thresholds(F.col("spans"), SLIDER))
    return detection.long(df, "doc_id").select("doc_id", "start", "entity_type", "score")


@query
def thresholded_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans.computed(found(spark, sf_dir), "spans", review.above_thresholds(F.col("spans"), BY_GROUP))
    return detection.long(df, "doc_id").select("doc_id", "start", "entity_type", "score")


@query
def group_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans.computed(found(spark, sf_dir), "spans", review.in_enabled_groups(F.col("spans"), review.Settings().groups_on))
    return detection.long(df, "doc_id").select("doc_id", "start", "entity_type")


@query
def allowlist_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = (review.Entry("*@*.example.com"), review.Entry("192.168.*.*"))
    df = spans.computed(found(spark, sf_dir), "spans", review.allowed_out_of_text(F.col("spans"), F.col("text"), entries))
    return detection.long(df, "doc_id").select("doc_id", "start", "entity_type", "text")


@query
def blocklist_injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans.computed(documents(spark, sf_dir), "spans", review.blocked_in(spans.no_spans(), F.col("text"), LISTED[2:3]))
    return detection.long(df, "doc_id").select("doc_id", "start", "end", "entity_type", "score", "text")


@query
def review_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = review.review(found(spark, sf_dir), review.Settings(slider=0.3, block=LISTED[2:3]))
    return detection.long(df, "doc_id").groupBy("entity_type", "source").agg(F.count("*").alias("n"))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as corrections: clicks dismiss, purchases add."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "EMAIL").otherwise("PHONE")
    hour = F.col("event_id") % 3
    return e.select(F.when(hour < 2, kind).alias("detected_type"), F.when(hour == 0, "NOT_PII").when(hour == 1, kind).otherwise(kind).alias("corrected_type"))


@query
def adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.adaptive_thresholds(_feedback(spark, sf_dir), 0.5).select("entity_type", F.round("threshold", 9).alias("threshold"))


@query
def adaptive_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = review.above_adaptive(found_long(spark, sf_dir), review.adaptive_thresholds(_feedback(spark, sf_dir), 0.75), 0.5)
    return got.groupBy("entity_type").agg(F.count("*").alias("n"))


@query
def known_replacement_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans whose text was emitted as a replacement (here: those of every second document)."""
    rows = found_long(spark, sf_dir)
    emitted = rows.where("doc_id % 2 = 0").select(F.trim("text").alias("emitted")).distinct()
    return rows.join(emitted, F.trim(rows["text"]) == F.col("emitted"), "left_anti").select("doc_id", "start", "text")


@query
def list_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("pattern"))
    b = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit(" "), F.col("n_name"), F.lit("  ")).alias("pattern"))
    return review.conflicts(a, b)


# ---- pseudonyms


@query
def redact_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.anonymized(found(spark, sf_dir).where(F.size("spans") > 0), "doc_id").select("doc_id", "redacted")


@query
def entity_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonym.entity_map(found_long(spark, sf_dir), "doc_id")


@query
def vault_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pseudonym.vault_update(found_long(spark, sf_dir), "doc_id")
    return v.select("entity_type", "normalized_key", "placeholder", "index", "usage_count")


@query
def stream_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault as a stream of documents fills it, in two batches: those of lower and of higher ids. The stream is
    started again, from its checkpoint, when the second half is there."""
    path, docs = scratch(spark, "vault-stream"), documents(spark, sf_dir)
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    for half in (docs.where(F.col("doc_id") <= middle), docs.where(F.col("doc_id") > middle)):
        half.write.mode("append").parquet(f"{path}/documents")
        stream = spark.readStream.schema(docs.schema).parquet(f"{path}/documents")
        observe.vault_stream(detection.long(detection.detect(stream), "doc_id"), "doc_id", f"{path}/vault", f"{path}/state").awaitTermination()
    return observe.stream_vault(spark, f"{path}/vault").select("entity_type", "normalized_key", "placeholder", "index", "usage_count")


@query
def vault_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vault of the first half of the documents, extended by the rest."""
    rows = detection.long(found_once(spark, sf_dir), "doc_id")
    first = pseudonym.vault_update(rows.where("doc_id % 2 = 0"), "doc_id")
    return pseudonym.vault_update(rows.where("doc_id % 2 = 1"), "doc_id", first).select("entity_type", "normalized_key", "index", "usage_count")


def _redacted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with spans, redacted by the vault of them all, and the vault."""
    own = found_once(spark, sf_dir)
    vault = stored(pseudonym.vault_update(detection.long(own, "doc_id"), "doc_id"), "vault")
    docs = documents(spark, sf_dir).join(own.select("doc_id"), "doc_id", "left_semi")
    return pseudonym.with_vault(docs, vault, "doc_id", spans=own), vault


@query
def redact_with_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir)[0].select("doc_id", "redacted")


@query
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = pseudonym.anonymized(found(spark, sf_dir).where(F.size("spans") > 0), "doc_id")
    return df.select("doc_id", restore.strict(F.col("redacted"), F.col("entity_map")).alias("restored"))


@query
def resolve_mangled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders that lost their brackets and underscore, resolved."""
    df = pseudonym.anonymized(found(spark, sf_dir).where(F.size("spans") > 0), "doc_id")
    mangled = F.regexp_replace("redacted", r"\[([A-Z]+)_([0-9]+)\]", "$1 $2")
    return df.select("doc_id", restore.resolved(mangled, F.col("entity_map"))["found"].alias("found"))


@query
def restore_with_vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted, vault = _redacted(spark, sf_dir)
    replies = redacted.select("doc_id", F.col("redacted").alias("reply"))
    return restore.restored_by_vault(replies, vault).select("doc_id", "restored")


@query
def synthetic_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = pseudonym.vault_update(found_long(spark, sf_dir), "doc_id")
    return v.select("placeholder", "synthetic_value")


def _vault_table(spark: SparkSession, sf_dir: str) -> tuple[VaultTable, DataFrame, DataFrame]:
    """A table with the documents' identities, and own names of planted code with the names that texts have."""
    t = VaultTable(spark, scratch(spark, "vault-table"))
    t.put(pseudonym.vault_update(found_long(spark, sf_dir), "doc_id"))
    found = stored(symbols.evidence(coded(spark, sf_dir).select("doc_id", F.col("code").alias("text")), "doc_id"), "names")
    own = stored(symbols.decided(found, "doc_id").where("own"), "own-names")
    names = aliases.first_roles(own, "doc_id").join(own.groupBy("name").agg(F.sum("uses").alias("uses")), "name")
    names = stored(names, "roles")
    # every third document's id is part of a function's name elsewhere
    taken = found.select(F.col("name").alias("alias")).union(documents(spark, sf_dir).where("doc_id % 3 = 0").select(F.concat(F.lit("func"), "doc_id")))
    return t, names, stored(taken.distinct(), "taken")


@query
def vault_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vault that is edited, deleted from, compacted, edited again and read back."""
    t = VaultTable(spark, scratch(spark, "vault-table"))
    t.put(pseudonym.vault_update(found_long(spark, sf_dir), "doc_id"))
    v = t.load()
    t.edit(v.where("index % 3 = 0").select("id", F.lit("synthetic").alias("mode"), F.lit(True).alias("pinned"), F.lit("seen").alias("notes")))
    t.edit(v.select("id", (F.col("index") % 5 == 0).alias("deleted")).where("deleted").union(v.limit(1).select(F.lit("no such id"), F.lit(True))))
    t.compact()
    t.edit(t.load().where("index % 6 = 0").select("id", F.lit("placeholder").alias("mode"), F.lit(None).cast("string").alias("notes")))
    return t.load().select("entity_type", "normalized_key", "index", "mode", "pinned", "notes", F.col("updated").cast("int").alias("updated"))


@query
def vault_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens stand for each original of the vault: its placeholder, and its synthetic value if it has one."""
    t = VaultTable(spark, scratch(spark, "vault-table"))
    t.put(pseudonym.vault_update(found_long(spark, sf_dir), "doc_id"))
    return t.reverse().where(F.col("token").startswith("[")).select("token", "original_text")


@query
def alias_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every own name in the documents' code, and whether its alias is one of its own: unique, and no name of any text."""
    t, names, taken = _vault_table(spark, sf_dir)
    t.upsert_aliases(names, taken)
    got = t.load().where(F.col("entity_type") == aliases.TYPE)
    shared = got.groupBy("synthetic_value").agg(F.count("*").alias("n"))
    met = got.join(shared, "synthetic_value").join(taken.select(F.col("alias").alias("synthetic_value"), F.lit(True).alias("clash")).distinct(), "synthetic_value", "left")
    return met.select(F.col("original_text").alias("name"), (F.col("n") == 1).alias("unique"), F.col("clash").isNull().alias("free"), F.col("usage_count").alias("uses"))


@query
def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each own name, whether what a preview shows is what the next write gives; the preview writes nothing."""
    t, names, taken = _vault_table(spark, sf_dir)
    shown = stored(t.preview(names, taken), "preview")
    assert t.version == 1
    t.upsert_aliases(names, taken)
    written = t.load().where(F.col("entity_type") == aliases.TYPE).select(F.col("original_text").alias("name"), F.col("synthetic_value").alias("written"))
    return shown.join(written, "name", "full").select("name", F.col("alias").eqNullSafe(F.col("written")).alias("same"))


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with planted placeholders."""
    t = F.concat_ws(" ", "text", F.format_string("[PERSON_%d]", F.col("conv_id") % 7 + 1), F.format_string("[EMAIL_%d]", F.col("turn") + 1), F.lit("[NOPE_1]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("text"))


@query
def observed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _chats(spark, sf_dir).select("conv_id", "turn", F.explode(pseudonym.observed_tokens(F.col("text"), rules.ENTITY_TYPES)).alias("token"))
    return got.groupBy("token").agg(F.count("*").alias("n"))


@query
def history_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = _chats(spark, sf_dir).where("turn = 0").select(F.col("conv_id").alias("reply_id"), F.col("text").alias("reply"))
    entries = spark.range(1, 8).select(F.col("id").alias("entry_id"), F.col("id").alias("created"), F.explode(F.array(F.format_string("[PERSON_%d]", "id"), F.format_string("[EMAIL_%d]", F.col("id") % 2 + 1))).alias("token"))
    return restore.best_history(replies, entries)


@query
def conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _chats(spark, sf_dir).select(F.col("conv_id").alias("scope"), F.explode(pseudonym.observed_tokens(F.col("text"), rules.ENTITY_TYPES)).alias("token")).withColumn("original", F.lower("token"))
    return restore.conversation_scope(chats.where("scope % 2 = 0"), chats.where("scope % 3 = 0"), chats)


@query
def exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir)
    entries = t.select(F.col("doc_id").alias("entry_id"), F.col("doc_id").alias("created"), F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("anonymized"))
    return restore.exact_copy(t.select(F.col("doc_id").alias("text_id"), "text"), entries)


# ---- corpora and scores


@query
def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).groupBy(text.length_bucket(F.col("text")).alias("bucket"), text.language(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.transform("spans", lambda s: s["entity_type"])
    return found(spark, sf_dir).where("lang IN ('en', 'de')").select(F.col("doc_id").alias("id"), F.col("lang").alias("language"), text.length_bucket(F.col("text")).alias("length_bucket"), types.alias("types"))


@query
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_summary(_examples(spark, sf_dir))


@query
def negative_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _examples(spark, sf_dir).where(F.size("types") == 0).withColumn("bucket", F.concat_ws(":", "language", "length_bucket"))
    keys = [f"{a}:{b}" for a in ("en", "de") for b in ("short", "medium", "long")]
    return corpus.quota_sample(e, "bucket", 25, keys, "id").select("id", "bucket")


@query
def coverage_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.coverage_sample(_examples(spark, sf_dir), 60, 20, 10).select("id", "language", "length_bucket")


@query
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(i, x) for i, x in enumerate(["first name", "GIVEN_NAME", "e-mail address", "PERSON", "zip-code", "nonsense", "", "driver license", "Tax ID"])]
    return fixtures.each(documents(spark, sf_dir), cases, "case_id, label").select("id", text.corpus_label(F.col("label")).alias("entity_type"))


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Examples, gold and detections: gold is what detection finds, but for every seventh
    span; of what is found, every fifth is shifted by a byte and every eleventh by ten."""
    f = documents(spark, sf_dir)
    rows = found_once(spark, sf_dir).select(F.col("doc_id").alias("example_id"), F.posexplode("spans").alias("idx", "s")).select("example_id", "idx", "s.start", "s.end", "s.entity_type")
    k = F.col("start") + F.col("example_id")
    gold = rows.where(k % 7 != 0)
    by = F.when(k % 11 == 0, 10).when(k % 5 == 0, 1).otherwise(0)
    detected = rows.select("example_id", "idx", (F.col("start") + by).alias("start"), (F.col("end") + by).alias("end"), F.when(k % 13 == 0, "MISC").otherwise(F.col("entity_type")).alias("entity_type"))
    examples = f.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("language"), text.length_bucket(F.col("text")).alias("length_bucket"))
    return examples, gold, detected


@query
def score_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.metrics(scoring.events(*_scored(spark, sf_dir)).where("kind = 'headline'"))


@query
def score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown(scoring.events(*_scored(spark, sf_dir)), "entity_type", list(rules.ENTITY_TYPES))


@query
def score_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown(scoring.events(*_scored(spark, sf_dir)), "language", ["en", "de", "fr", "es", "it"])


@query
def score_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdown(scoring.events(*_scored(spark, sf_dir)), "length_bucket", ["short", "medium", "long"])


@query
def type_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.type_accuracy(scoring.events(*_scored(spark, sf_dir)))


@query
def negative_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.negatives(*_scored(spark, sf_dir))


@query
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, detected = _scored(spark, sf_dir)
    return scoring.unmatched(gold, scoring.matches(gold, detected), "g_idx").select("example_id", "idx", "start", "entity_type")


@query
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gold, detected = _scored(spark, sf_dir)
    return scoring.unmatched(detected, scoring.matches(gold, detected), "d_idx").select("example_id", "idx", "start", "entity_type")


@query
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scoring.latency(table(spark, sf_dir, "events"), "value", "event_type")
    return got.select("event_type", "count", F.round("total", 4).alias("total"), F.round("average", 6).alias("average"), "p50", "p95", "max")


@query
def identifier_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("l_suppkey") % 10).alias("text_id"), F.col("l_linenumber").cast("double").alias("own"), F.floor("l_quantity").cast("double").alias("lib"))
    return scoring.identifier_evidence(li).select("name", F.round("share", 9).alias("share"), "library")


@query
def hash_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("source").distinct().select("source", scoring.hash_split(F.col("source")).alias("split"))


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).groupBy("text").agg(F.min("source").alias("source"))
    return scoring.deduplicated(d, "text", "source", 20).groupBy("source").agg(F.count("*").alias("n"))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in customers' comments and names, by nation: detection over a relational table."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.concat_ws(" ", F.col("c_name"), F.format_string("call 555-%03d-%04d", (F.col("c_custkey") % 900 + 100).cast("int"), (F.col("c_custkey") % 9000 + 1000).cast("int"))).alias("text"))
    hits = detection.detect(c).select("c_nationkey", F.size("spans").alias("n"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return hits.join(n, "c_nationkey").groupBy("n_name").agg(F.sum("n").cast("long").alias("n"))


@query
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", text.fingerprint("text").alias("fingerprint"))


# ---- models


@query
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = models.chunked(documents(spark, sf_dir), "doc_id")
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("end_char").alias("chars"), F.max("end_byte").alias("bytes"))


@query
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the token chunks of each text are within the budget, follow each other without a gap, and reach from its beginning to its end."""
    import public_tokenizers

    got = models.token_chunked(documents(spark, sf_dir).where("text <> ''").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    rows = got.groupBy("doc_id", F.length("text").cast("int").alias("size")).agg(F.max("tokens").alias("most"), F.array_sort(F.collect_list(F.struct("chunk", "start_char", "end_char"))).alias("c"))
    gap = F.exists(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.col("c")[i]["start_char"] > F.col("c")[i - 1]["end_char"])
    whole = (F.col("c")[0]["start_char"] == 0) & (F.element_at("c", -1)["end_char"] == F.col("size"))
    return rows.select("doc_id", (F.col("most") <= 480).alias("fits"), (whole & ((F.size("c") == 1) | ~gap)).alias("covers"))


@query
def chunk_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans found chunk by chunk, moved to their place and merged: those of whole texts."""
    c = models.chunked(documents(spark, sf_dir), "doc_id").withColumn("at", F.col("start_byte"))
    c = spans.computed(c, "s", models.shifted(spans.recognized(F.col("text"), ("EMAIL", "IP_ADDRESS")), F.col("at")))
    long = c.select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.start", "s.end", "s.entity_type", "s.score", "s.text")
    return models.merged_same_type(long, "doc_id").select("doc_id", "start", "end", "entity_type", "text")


@query
def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fixtures.texts(documents(spark, sf_dir)).select("id", F.concat_ws(" ", "text", F.lit("by Anna Müller, Berlin")).alias("text"))
    return t.select("id", F.explode(models.gazetteer(F.col("text"))).alias("s")).select("id", "s.start", "s.entity_type", "s.text")


@query
def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(i, x) for i, x in enumerate(["B-PER", "I-LOC", "givenName", "[ORG]", "TELEPHONENUM", "odd", "O"])]
    return fixtures.each(documents(spark, sf_dir), cases, "case_id, raw").select("id", models.model_label(F.col("raw")).alias("entity_type"))


@query
def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of word pieces: each capitalized word of a text is tagged."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    items = F.transform(words, lambda w: F.struct(F.concat(F.lit("▁"), w).alias("word"), F.when(w.rlike("^[A-Z]"), F.lit("PERSON")).alias("entity"), F.lit(0.9).alias("score")))
    df = spans.computed(docs, "s", models.spans_of_tokens(F.col("text"), items))
    return detection.long(df, "doc_id", "s").select("doc_id", "start", "end", "entity_type", "score", "text")


# ---- code


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kind, words, code and text: documents with a piece of code or error output set after each."""
    return planted.coded(documents(spark, sf_dir).select("doc_id", "text"))


@query
def code_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of what was planted, and their languages."""
    got = coded(spark, sf_dir).select("doc_id", F.explode(code.code_regions(F.col("code"))).alias("r"))
    return got.select("doc_id", "r.start", (F.col("r.end") - F.col("r.start")).alias("bytes"), "r.language")


@query
def marked_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("doc_id", F.explode(code.marked_regions(F.col("text"))).alias("r")).select("doc_id", "r.start", "r.end")


@query
def error_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("doc_id", F.explode(code.error_slots(F.col("text"))).alias("s")).select("doc_id", (F.col("s.end") - F.col("s.start")).alias("bytes"), "s.name", "s.kind", "s.library")


@query
def language_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the planted code without its fences' labels."""
    bare = coded(spark, sf_dir).where("kind < 4").withColumn("text", F.regexp_replace("code", "(?m)^```.*$", ""))
    return bare.select("doc_id", F.array_join(F.array_distinct(F.transform(code.code_regions(F.col("text")), lambda r: r["language"])), " ").alias("languages"))


@query
def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("doc_id", F.array_join(code.profiles(F.col("text")), " ").alias("profiles"))


@query
def code_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of the planted code, its role, and which step decided whose it is; a table of verdicts holds one name of each Java piece."""
    docs = coded(spark, sf_dir)
    verdicts = docs.where("kind = 2").select(F.concat(F.col("words")[3], F.lit("Order")).alias("name"), F.lit(False).alias("own"))
    found = symbols.evidence(docs.select("doc_id", F.col("code").alias("text")), "doc_id")
    return symbols.decided(found, "doc_id", verdicts=verdicts.distinct(), fallback=("helper",)).select("doc_id", "name", "role", "step", "own")


@query
def rename_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).select("doc_id", F.explode(code.renamed(F.col("code"))["aliases"]).alias("name", "alias"))


@query
def redact_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted code written with aliases."""
    return coded(spark, sf_dir).select("doc_id", F.sha2(code.renamed(F.col("code"))["renamed"], 256).alias("code"))


@query
def split_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark, sf_dir).where("kind < 4").select("doc_id", code.split_identifiers(F.col("code")).alias("view"))


@query
def code_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in conversations, tagged where they are in marked code."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("```\nip 10.1.2.3\n```\n"), "text", F.lit(" 10.9.8.7")).alias("text"))
    df = spans.computed(detection.detect(chats), "regions", code.marked_regions(F.col("text")))
    df = review.review(df, review.Settings(), regions="regions")
    return df.select("conv_id", "turn", F.explode(F.arrays_zip("spans", "in_code")).alias("z")).groupBy(F.col("z.in_code").alias("in_code"), F.col("z.spans.text").alias("text")).agg(F.count("*").alias("n")).where("text LIKE '10.%'")


@query
def synthetic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", synthetic.links("url").alias("link"))


# ---- streams


@query
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet periods of users' events, ten minutes long."""
    e = table(spark, sf_dir, "events")
    return observe.quiet_periods(e, "user_id", "ts", "event_type", "10 minutes").select("user_id", "started", "fires", "n_updates")


@query
def stream_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    return observe.changed(e, "user_id", "ts", "event_type").groupBy("user_id").agg(F.count("*").alias("n"))


def _run_events(spark: SparkSession, sf_dir: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream made of events gives when all are read: one event for each user and time, in two batches, the
    earlier half first. The stream is started again, from its checkpoint, when the second half is there."""
    path = scratch(spark, "event-stream")
    e = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("timestamp").alias("ts")).agg(F.max("event_type").alias("event_type"))
    middle = e.agg(F.percentile_approx(F.col("ts").cast("long"), 0.5)).first()[0] or 0
    for half in (F.col("ts").cast("long") <= middle, F.col("ts").cast("long") > middle):
        e.where(half).write.mode("append").parquet(f"{path}/events")
        df = made(spark.readStream.schema(e.schema).parquet(f"{path}/events"))
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


@query
def stream_debounce_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_debounce on a stream: quiet periods that the watermark, an hour after the latest event, has passed."""
    got = _run_events(spark, sf_dir, lambda events: observe.quiet_periods(events, "user_id", "ts", "event_type", "10 minutes", late="1 hour"))
    return got.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("fires").cast("timestamp_ntz").alias("fires"), "n_updates")


@query
def stream_suppressed_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_suppressed on a stream: keyed state with timers, over all checks that the watermark has passed."""
    got = _run_events(spark, sf_dir, lambda events: observe.changed_stream(events, "user_id", "ts", "event_type", late="1 hour"))
    return got.groupBy("user_id").agg(F.count("*").alias("n"))


@query
def token_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chats(spark, sf_dir).select(F.explode(pseudonym.observed_tokens(F.col("text"), rules.ENTITY_TYPES)).alias("token"), F.col("conv_id").alias("conversation"), (F.col("conv_id") * 100 + F.col("turn")).alias("seen"))
    return observe.filed(c)


# ---- more of code, stores and scores


def _names_in_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted code with a model's span on its second word, at its first place."""
    t = coded(spark, sf_dir).where("kind < 4").select("doc_id", F.col("words")[1].alias("word"), F.col("code").alias("text"))
    a = F.instr(F.col("text"), F.col("word")) - 1
    return spans.computed(t, "spans", F.array(spans.span(a, a + F.length("word"), F.lit("PERSON"), F.lit(0.9), F.col("word"), F.lit("ner"), F.lit(0))))


@query
def identifiers_propagated(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _names_in_code(spark, sf_dir).select("doc_id", F.explode(code.propagated(F.col("text"), F.col("spans"))).alias("p"))
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("p.start").alias("first"))


@query
def identifiers_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _names_in_code(spark, sf_dir).select("doc_id", F.explode(code.widened(F.col("text"), F.col("spans"))).alias("p"))
    return got.groupBy("doc_id", F.col("p.text").alias("text")).agg(F.count("*").alias("n"))


@query
def generic_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of a model and of a pattern on the word total in planted code: the model's goes."""
    t = coded(spark, sf_dir).where("kind = 0").select("doc_id", F.col("code").alias("text"))
    a = F.instr("text", "_total") + 0
    both = F.array(*(spans.span(a, a + 5, F.lit("PERSON"), F.lit(0.9), F.lit("total"), F.lit(source), F.lit(0)) for source in ("ner", "regex")))
    return spans.computed(t, "spans", both).select("doc_id", F.explode(code.without_generic(F.col("text"), F.col("spans"))).alias("s")).select("doc_id", "s.text", "s.source")


@query
def bare_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names_in_code(spark, sf_dir).select("doc_id", code.takes_bare(F.col("text"), F.col("spans"))[0].alias("bare"))


def _planted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = planted.words(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("/home/"), w[0], F.lit("/"), w[1], F.lit("."), w[2]).alias("path"))


@query
def path_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_paths(spark, sf_dir).select("doc_id", code.path_view("path").alias("view"))


@query
def synthetic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planted_paths(spark, sf_dir).select("doc_id", synthetic.paths("path").alias("path"))


@query
def score_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.breakdowns(scoring.events(*_scored(spark, sf_dir)))


@query
def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.usage(found_long(spark, sf_dir), "doc_id")


@query
def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(scoring.hash_split(F.col("source")).alias("split"), "source", (F.col("lang") == "en").alias("label"))
    return scoring.dataset_stats(rows, "split", "source", "label")


@query
def history_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("created"), F.col("text").alias("original"), F.upper("text").alias("anonymized"))
    return corpus.history(e).select("id", "created", "truncated")


@query
def feedback_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.feedback(table(spark, sf_dir, "events").select(F.col("event_id"), F.col("event_id").alias("timestamp"))).select("event_id")


@query
def conversation_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _chats(spark, sf_dir).select(F.col("conv_id").alias("conversation"), F.explode(pseudonym.observed_tokens(F.col("text"), rules.ENTITY_TYPES)).alias("token"))
    got = corpus.conversations(t.where("conversation % 2 = 0"), t.withColumn("original", F.lower("token")).where("conversation % 3 = 0"))
    return got.select("conversation", F.array_join("tokens", " ").alias("tokens"), F.size("originals").alias("originals"))


@query
def examples_from_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw records, with the first word as a labelled span without offsets."""
    word = F.regexp_extract("text", r"^[^\s]+", 0)
    record = F.to_json(F.struct(F.col("doc_id").alias("uid"), F.col("lang").alias("locale"), "text", F.array(F.struct(word.alias("value"), F.lit("given name").alias("label"))).alias("privacy_mask")))
    raw = documents(spark, sf_dir).select(F.lit("f").alias("file"), F.col("doc_id").alias("row"), record.alias("json"))
    got = corpus.examples_from_raw(raw, "docs")
    return got.select("id", "language", F.col("lengthBucket").alias("bucket"), F.explode("goldSpans").alias("g")).select("id", "language", "bucket", "g.start", "g.end", "g.entity_type", "g.text")


@query
def auto_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = found(spark, sf_dir)
    own = review.auto_approved(F.col("spans"), F.transform("spans", lambda s: F.lit(False)), 0.8)
    return detection.long(spans.computed(df, "spans", own), "doc_id").select("doc_id", "start", "score")


@query
def used_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.map_from_arrays(F.array(*(F.lit(f"[PERSON_{i}]") for i in range(1, 10))), F.array(*(F.lit(f"p{i}") for i in range(1, 10))))
    got = _chats(spark, sf_dir).select("conv_id", "turn", F.explode(restore.used_mappings(F.col("text"), tokens)).alias("token", "original"))
    return got.groupBy("token", "original").agg(F.count("*").alias("n"))


@query
def code_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [(1, "alma", "variable"), (2, "_etags", "property"), (3, "ClientName", "property"), (4, "MAX_SIZE", "constant"), (5, "load_user", "function"), (6, "acme", "class"), (7, "x1", "parameter")]
    return fixtures.each(documents(spark, sf_dir), cases, "case_id, name, role").select("id", code.alias(F.col("role"), F.col("name"), F.col("case_id")).alias("alias"))
