"""Whose names are in code: evidence of each text, decided by joins.

A text's evidence (code.symbols) is one row for each name. What a language or a
library has is a table, and so are a model's verdicts, so both may be of any
size; a name of thousands of texts is one key of theirs, and what is
joined on (text, name) has no hot key. The order of decisions:

1. declared in the text: own; 2. imported: external; 3. in the lexicon of the
language, or a profile: library; 4. a member of a library's receiver, or of a
value made by one; 5. an option key of a library's call; 6. the verdict of a
model; 7. in the fallback list; else own, declared elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.code import lexicon, regions, rename
from spanlake.code.columns import MAY_BE_CODE, Bytes
from spanlake.functions.arrow import arrow
from spanlake.plans.scratch import stored

EVIDENCE = "array<struct<name:string,language:string,first:int,role:string,declared:boolean,imported:boolean,receivers:array<string>,options:array<string>,uses:int>>"


@arrow(EVIDENCE)
def _evidence(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        b = Bytes(text)
        found = rename.names_of(text, regions.languages(text)).values()
        out.append([{"name": e.name, "language": e.language, "first": b(e.first), "role": e.role, "declared": e.declared, "imported": e.imported, "receivers": sorted(e.receivers), "options": sorted(e.options), "uses": e.uses} for e in found])
    return pd.Series(out)


def evidence(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and a row for each name in the code of a text; first is its byte offset."""
    has = F.coalesce(F.col(text), F.lit("")).rlike(MAY_BE_CODE)
    return df.where(has).select(key, F.explode(_evidence(F.col(text))).alias("e")).select(key, "e.*")


def decided(found: DataFrame, key: str, known: DataFrame | None = None, verdicts: DataFrame | None = None, fallback: Iterable[str] = (), reserved: Iterable[str] = lexicon.RESERVED) -> DataFrame:
    """key, name, language, role, step, own, first, uses of evidence().

    known: (language, name) rows; verdicts: (name, own) rows of a classifier.
    """
    spark = found.sparkSession
    known = (lexicon.table(spark) if known is None else known).select("language", "name").distinct()
    e = found.join(known.withColumn("listed", F.lit(True)), ["language", "name"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    e = stored(e.withColumn("library", F.col("imported") | (~F.col("declared") & F.col("listed"))), "evidence")

    # receivers and callees: names of the text, or else of its language
    refs = e.select(key, "name", "language", F.explode(F.concat(_tagged("receivers", "receiver"), _tagged("options", "option"))).alias("r")).select(key, "name", "language", "r.*")
    own = e.select(key, F.col("name").alias("of"), F.col("library").alias("here"))
    listed = known.select("language", F.col("name").alias("of"), F.lit(True).alias("there"))
    refs = refs.join(own, [key, "of"], "left").join(listed, ["language", "of"], "left")
    foreign = F.coalesce("here", "there", F.lit(False))
    of = refs.groupBy(key, "name").agg(F.bool_or(foreign & (F.col("how") == "receiver")).alias("receiver"), F.bool_or(foreign & (F.col("how") == "option")).alias("option"))
    e = e.join(of, [key, "name"], "left")
    if verdicts is not None:
        e = e.join(verdicts.groupBy("name").agg(F.bool_and("own").alias("verdict")), "name", "left")
    else:
        e = e.withColumn("verdict", F.lit(None).cast("boolean"))
    last = F.col("name").isin(*fallback) if fallback else F.lit(False)
    step = (
        F.when(F.col("name").isin(*reserved) | F.col("name").startswith("__"), "reserved")
        .when(F.col("declared"), "declared").when(F.col("imported"), "imported").when(F.col("listed"), "lexicon").when(F.col("receiver"), "receiver").when(F.col("option"), "option")
        .when(F.col("verdict").isNotNull(), "verdict").when(last, "fallback").otherwise("undeclared")
    )
    owned = F.col("step").isin("declared", "undeclared") | (F.col("step") == "verdict") & F.col("verdict")
    return e.withColumn("step", step).select(key, "name", "language", "role", "step", owned.alias("own"), "first", "uses")


def _tagged(names: str, how: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("of"), F.lit(how).alias("how")))
