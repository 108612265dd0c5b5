"""One query for each operator, over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.common import scratch, table
from spanlake.llm.oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spanlake.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import warc

    pages = table(spark, sf_dir, "pages")
    path = scratch(spark, "warc")
    warc.write(warc.with_revisits(pages, "page_id", "url", "html"), path)
    page = lambda c: warc.id_of(F.col(c), dict(pages.dtypes)["page_id"])
    return warc.read(spark, path).select(
        page("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_length")).alias("payload_bytes"),
        F.coalesce(warc.base32(F.sha1("payload")), F.col("digest")).alias("payload_digest"),
        F.col("type").alias("record_type"), page("refers_to").alias("refers_to"), "intact",
    )


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.line_dedup import dedup_lines

    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.hyperminhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import quality

    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.graded(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", "expected_grade", "p_clean", (F.col("p_clean") >= model.keep).alias("kept"))


@query
def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spanlake.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.digest import digests

    return digests(table(spark, sf_dir, "documents"))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.pii import find

    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "secrets", "n_added", "n_spans", "n_secrets")


@query
def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.passages import shared_passages

    return shared_passages(table(spark, sf_dir, "documents"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm import codes

    found, books = codes.encode(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


@query
def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.neighbours import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanlake.llm.whitening import whiten

    found, w = whiten(table(spark, sf_dir, "embeddings"))
    explained = F.array(*(F.lit(e) for e in w.explained)) if w else F.array()
    return found.select(F.col("id").alias("vec_id"), F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n if w else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.cast("array<double>")[F.col("k")].alias("explained"), F.lit(w.identity_error if w else None).cast("double").alias("identity_error"),
    )
