"""Documents to training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontamination, hyperminhash, line_dedup, quality
from spanlake.llm.common import dropped, mark, scratch, table, tune
from spanlake.llm.packing import pack

SHINGLE = 5


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier finds clean."""
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated windows of lines; a document that loses all its lines goes."""
    tune(spark)
    left = line_dedup.dedup_lines(docs).where("n_removed < n_lines OR n_removed = 0")
    chars = {"n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"])} if "n_chars" in docs.columns else {}
    return left.withColumns(chars).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tune(spark)
    return hyperminhash.dedup(docs, shingle=SHINGLE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passage."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    tune(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", graded), ("line_dedup", unrepeated), ("near_dedup", distinct), ("decontamination", decontaminated), ("packing", packed)]

#: Token ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage and its operator wrote is deleted when the next stage is written."""
    docs, begun = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        dropped(spark, begun, docs)
    return docs
