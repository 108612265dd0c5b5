"""Scoring detections against gold spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.plans.scratch import stored


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


#: Bytes of a bin. Spans meet in the bins that both reach into, and are told once, where the later one begins.
BIN = 256


def _binned(spans: DataFrame) -> DataFrame:
    bins = F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))
    return spans.where("start < end").withColumn("bin", F.explode(bins))


def match_candidates(gold: DataFrame, found: DataFrame, drift: int = 2, gold_cover: float = 0.8, found_cover: float = 0.5) -> DataFrame:
    """Overlapping pairs within the tolerances. gold and found: example_id, start, end,
    entity_type, and idx, the place within the example. An interval join by bins, so a long
    example's spans don't all meet each other; empty spans overlap with none."""
    g = _binned(gold).select("example_id", "bin", *(F.col(c).alias(f"g_{c}") for c in ("idx", "start", "end", "entity_type")))
    d = _binned(found).select("example_id", "bin", *(F.col(c).alias(f"d_{c}") for c in ("idx", "start", "end", "entity_type")))
    once = F.floor(F.greatest("g_start", "d_start") / BIN) == F.col("bin")
    pairs = g.join(d, ["example_id", "bin"]).where("g_start < d_end AND d_start < g_end").where(once).drop("bin")
    both = F.least("g_end", "d_end") - F.greatest("g_start", "d_start")
    pairs = pairs.withColumns({"overlap": both, "g_size": F.col("g_end") - F.col("g_start"), "d_size": F.col("d_end") - F.col("d_start")})
    pairs = pairs.withColumns({
        "g_cover": F.col("overlap") / F.col("g_size"), "d_cover": F.col("overlap") / F.col("d_size"), "delta": F.abs(F.col("d_size") - F.col("g_size")),
        "drift": F.greatest(F.col("d_start") - F.col("g_start"), F.col("g_end") - F.col("d_end"), F.lit(0)),
    })
    return pairs.where((F.col("drift") <= drift) & (F.col("g_cover") >= gold_cover) & (F.col("d_cover") >= found_cover))


def matches(gold: DataFrame, found: DataFrame, **options: float) -> DataFrame:
    """One-to-one matches per example, best pair first (coverage of gold, coverage of the
    detection, drift, difference in length, places); a fold over the few pairs of one example."""
    pairs = match_candidates(gold, found, **options)
    row = F.struct((-F.col("g_cover")).alias("k1"), (-F.col("d_cover")).alias("k2"), F.col("drift").alias("k3"), F.col("delta").alias("k4"), F.col("g_idx").alias("g"), F.col("d_idx").alias("d"), "g_entity_type", "d_entity_type", "overlap")
    grouped = pairs.groupBy("example_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    take = F.aggregate("c", F.slice("c", F.lit(1), F.lit(0)), lambda acc, x: F.when(F.exists(acc, lambda y: (y["g"] == x["g"]) | (y["d"] == x["d"])), acc).otherwise(F.concat(acc, F.array(x))))
    return grouped.select("example_id", F.explode(take).alias("m")).select("example_id", F.col("m.g").alias("g_idx"), F.col("m.d").alias("d_idx"), F.col("m.g_entity_type").alias("gold_type"), F.col("m.d_entity_type").alias("found_type"), F.col("m.overlap").alias("overlap"), (F.col("m.g_entity_type") == F.col("m.d_entity_type")).alias("type_correct"))


def unmatched(spans: DataFrame, matched: DataFrame, idx: str) -> DataFrame:
    """Gold (idx g_idx: false negatives) or detections (d_idx: false positives) without a match."""
    return spans.join(matched.select("example_id", F.col(idx).alias("idx")), ["example_id", "idx"], "left_anti")


def bucket(gold: DataFrame, examples: DataFrame) -> DataFrame:
    """examples plus kind: negative (no gold), misc (some MISC gold), headline."""
    kinds = gold.groupBy("example_id").agg(F.max((F.col("entity_type") == "MISC").cast("int")).alias("misc__"))
    return examples.join(kinds, "example_id", "left").withColumn("kind", F.when(F.col("misc__").isNull(), "negative").when(F.col("misc__") == 1, "misc").otherwise("headline")).drop("misc__")


def events(examples: DataFrame, gold: DataFrame, found: DataFrame, **options: float) -> DataFrame:
    """One row for each true positive, false negative and false positive: example_id, kind,
    language, length_bucket, entity_type (gold's, for false positives the detection's), event."""
    m = stored(matches(gold, found, **options), "matches")
    rows = (
        m.select("example_id", F.col("gold_type").alias("entity_type"), F.lit("tp").alias("event"), "type_correct")
        .unionByName(unmatched(gold, m, "g_idx").select("example_id", "entity_type", F.lit("fn").alias("event"), F.lit(None).cast("boolean").alias("type_correct")))
        .unionByName(unmatched(found, m, "d_idx").select("example_id", "entity_type", F.lit("fp").alias("event"), F.lit(None).cast("boolean").alias("type_correct")))
    )
    return rows.join(bucket(gold, examples), "example_id")


def metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Counts, precision, recall and F1 of events, overall or by columns; 0 for 0 / 0."""
    n = {e: F.sum(F.when(F.col("event") == e, 1).otherwise(0)) for e in ("tp", "fp", "fn")}
    agg = rows.groupBy(*by).agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(e) for e, c in n.items()))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = agg.withColumn("precision", p).withColumn("recall", r)
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def breakdown(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """metrics() with a row for each value, zeros where there are no events."""
    spark = rows.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{by} string")
    got = every.join(metrics(rows.where(F.col("kind") == "headline"), by), by, "left")
    return got.fillna(0).select(by, *(F.col(c).cast(t) for c, t in (("tp", "long"), ("fp", "long"), ("fn", "long"), ("precision", "double"), ("recall", "double"), ("f1", "double"))))


def breakdowns(rows: DataFrame) -> DataFrame:
    """By type, language and length bucket in one pass of grouping sets."""
    sets = [["entity_type"], ["language"], ["length_bucket"], []]
    counts = (F.count_if(F.col("event") == e).alias(e) for e in ("tp", "fp", "fn"))
    return rows.where("kind = 'headline'").groupingSets(sets, "entity_type", "language", "length_bucket").agg(*counts)


def negatives(examples: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """examples, passed, failed, pass_rate, fp_rate, false_positives of examples without gold."""
    per = bucket(gold, examples).where("kind = 'negative'").join(found.groupBy("example_id").agg(F.count("*").alias("n")), "example_id", "left")
    a = per.agg(F.count("*").alias("examples"), F.coalesce(F.sum(F.when(F.col("n").isNull(), 1).otherwise(0)), F.lit(0)).alias("passed"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_positives"))
    return a.select("examples", "passed", (F.col("examples") - F.col("passed")).alias("failed"), ratio(F.col("passed"), F.col("examples")).alias("pass_rate"), ratio(F.col("false_positives"), F.col("examples")).alias("fp_rate"), "false_positives")


def type_accuracy(rows: DataFrame) -> DataFrame:
    m = rows.where("event = 'tp' AND kind = 'headline'")
    return m.agg(F.count("*").alias("matched"), F.coalesce(F.avg(F.col("type_correct").cast("double")), F.lit(0.0)).alias("accuracy"))


def latency(df: DataFrame, value: str, *by: str) -> DataFrame:
    """count, total, average, p50, p95 (nearest rank) and max of a column."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("count"), F.sum(value).alias("total"), F.avg(value).alias("average"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), F.max(value).alias("max"))


def counts_by_source(spans: DataFrame) -> DataFrame:
    return spans.groupBy("source").agg(F.count("*").alias("n"))


#: Share of evidence for the library from which on a name counts as its; fixed value.
LIBRARY_SHARE = 0.8212717771530151


def identifier_evidence(scores: DataFrame, threshold: float = LIBRARY_SHARE) -> DataFrame:
    """name, share, library: per text the share of library evidence, over texts the least.
    scores: name, text_id, own, lib."""
    per = scores.groupBy("name", "text_id").agg(ratio(F.sum("lib"), F.sum("own") + F.sum("lib")).alias("share"))
    return per.groupBy("name").agg(F.min("share").alias("share")).withColumn("library", F.col("share") >= threshold)


def hash_split(repository: Column) -> Column:
    """train, validation or test by the SHA-1 of a name modulo 10."""
    bucket_ = F.aggregate(F.filter(F.split(F.sha1(repository), ""), lambda c: c != ""), F.lit(0), lambda r, c: (r * 16 + F.conv(c, 16, 10).cast("int")) % 10)
    return F.when(bucket_ < 8, "train").when(bucket_ == 8, "validation").otherwise("test")


def deduplicated(df: DataFrame, content: str, group: str, cap: int) -> DataFrame:
    """One row for each content, that of the least group, at most cap of each group, by hash: a top-k by group."""
    from pyspark.sql import Window

    least = Window.partitionBy("sha__").orderBy(*(F.col(c) for c in [group, *sorted(df.columns)]))
    one = df.withColumn("sha__", F.sha1(F.col(content))).withColumn("n__", F.row_number().over(least)).where("n__ = 1")
    return one.withColumn("n__", F.row_number().over(Window.partitionBy(group).orderBy("sha__"))).where(F.col("n__") <= cap).drop("n__", "sha__")


def usage(spans: DataFrame, time: str) -> DataFrame:
    """entity_type, normalized_key, uses, first_seen, last_seen of each identity."""
    from spanlake.functions.text import normalized_key

    keyed = spans.withColumn("normalized_key", normalized_key(F.col("text")))
    return keyed.groupBy("entity_type", "normalized_key").agg(F.count("*").alias("uses"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def dataset_stats(rows: DataFrame, split: str, group: str, label: str) -> DataFrame:
    """split, rows, groups, positives and their share."""
    return rows.groupBy(split).agg(F.count("*").alias("rows"), F.countDistinct(group).alias("groups"), F.sum(F.col(label).cast("long")).alias("positives"), F.round(F.avg(F.col(label).cast("double")), 9).alias("share"))
