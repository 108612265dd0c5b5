"""Aliases that are unique over all texts, given out in parallel.

Names take numbers by their place in a global order, and propose the aliases of
these. A join tells which are taken: by an identifier of any text, or by a
value or a name in the vault. Only their losers propose again, with the numbers
that follow, until none is left. Numbers are never given twice, so aliases of one
call can't meet each other, and the result doesn't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.code import columns as code
from spanlake.operators.pseudonym import placeholder
from spanlake.plans.order import placed
from spanlake.plans.scratch import stored

TYPE = "IDENTIFIER"


def first_roles(symbols: DataFrame, key: str) -> DataFrame:
    """name, role, k, first: own names of operators.symbols.decided(), each with its first declaration's role."""
    own = symbols.where("own").withColumn("declared", F.col("step") == "declared")
    least = own.groupBy("name").agg(F.min(F.struct(F.col(key).alias("k"), "first")).alias("f"), F.min_by("role", F.struct(~F.col("declared"), F.col(key), F.col("first"))).alias("role"))
    return least.select("name", "role", "f.k", "f.first")


def allocated(names: DataFrame, taken: DataFrame, counter: int = 0) -> DataFrame:
    """name, role, index, alias for each row of names (name, role, k, first); taken: (alias)."""
    taken = taken.select("alias").where("alias IS NOT NULL").distinct()
    waiting, out, n = placed(names.select("name", "role", "k", "first"), ["k", "first", "name"], "names"), None, None
    while n != 0:
        tried = waiting.withColumn("index", F.col("pos") + 1 + counter).drop("pos")
        tried = tried.withColumn("alias", code.alias(F.col("role"), F.col("name"), F.col("index")))
        tried = stored(tried.join(taken.withColumn("clash", F.lit(True)), "alias", "left"), "proposed")
        won = tried.where("clash IS NULL").select("name", "role", "index", "alias")
        out = won if out is None else out.unionByName(won)
        counter = max(counter, tried.agg(F.max("index")).first()[0] or 0)
        lost = tried.where("clash").select("name", "role", "k", "first")
        n = lost.count()
        if n:
            waiting = placed(lost, ["k", "first", "name"], "names")
    return out


def upserted(names: DataFrame, taken: DataFrame, vault: DataFrame, counter: int) -> tuple[DataFrame, DataFrame]:
    """(new records, uses of known ones): what names (name, role, k, first, uses) do to a vault.

    A known name keeps its alias. usable is false where a text has that alias as a name
    of its own: the name is then left as it is. taken: (alias).
    """
    known = vault.where(F.col("entity_type") == TYPE).select("id", F.col("original_text").alias("name"), F.col("synthetic_value").alias("alias"))
    met = names.join(known, "name").join(taken.select("alias", F.lit(True).alias("clash")).distinct(), "alias", "left")
    touched = met.select("id", "name", "alias", F.col("uses").alias("used"), (F.col("clash").isNull() & (F.col("alias") != "")).alias("usable"))
    fresh = names.join(known.select("name"), "name", "left_anti")
    inside = vault.select(F.explode(F.array("synthetic_value", "original_text")).alias("alias")).where("alias <> ''")
    new = allocated(fresh, taken.select("alias").union(inside), counter).join(fresh.select("name", "k", "uses"), "name")
    return new.select(
        _id(F.col("name")).alias("id"), F.col("name").alias("original_text"), F.col("name").alias("normalized_key"), F.lit(TYPE).alias("entity_type"), placeholder(F.lit(TYPE), F.col("index")).alias("placeholder"), "index",
        F.col("alias").alias("synthetic_value"), F.lit("synthetic").alias("mode"), F.lit(False).alias("pinned"), F.col("k").alias("first_key"), F.col("uses").cast("long").alias("usage_count"),
    ), touched


def _id(name: Column) -> Column:
    return F.sha1(F.concat_ws("\x1f", F.lit(TYPE), name))
