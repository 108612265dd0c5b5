"""The vault as a table that is edited: a base, what changed since, and the versions of both.

Each change is a folder of changed records and marks of deleted ones, each compaction
a folder of all records; a version is there once its folder has been written whole
(_SUCCESS), and writing it again gives the same. A load reads the last base up
to the version it wants and the changes after it, and keeps each record's last
state: one aggregation by id, whatever the number of changes. Readers of
a version aren't disturbed by later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake import rules
from spanlake.operators import aliases, pseudonym

COLUMNS = [*(f.split()[0] for f in pseudonym.VAULT.split(", ")), "notes", "updated"]
TYPES = (*rules.ENTITY_TYPES, aliases.TYPE)


def whole(record: DataFrame) -> DataFrame:
    """Records with all their fields, a known type and mode, and a placeholder of their index (its type is
    the one that the record began with)."""
    have = F.lit(True)
    for c in ("id", "original_text", "normalized_key", "entity_type", "placeholder", "synthetic_value", "pinned", "usage_count"):
        have = have & F.col(c).isNotNull()
    return record.where(have & F.col("entity_type").isin(*TYPES) & F.col("mode").isin("placeholder", "synthetic") & (pseudonym.parsed(F.col("placeholder"))["index"] == F.col("index")))


def coerced(mode: Column, synthetic: Column) -> Column:
    """Synthetic mode needs a synthetic value."""
    return F.when((mode == "synthetic") & (synthetic == ""), "placeholder").otherwise(mode)


class VaultTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ---- versions

    def _versions(self, kind: str) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [s.getPath() for s in fs.listStatus(folder)]
        done = [p.getName() for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done if n.startswith("version="))

    @property
    def version(self) -> int:
        """The last version; 0 before the first."""
        return max([0, *self._versions("changes"), *self._versions("base")])

    def _read(self, kind: str, versions: list[int]) -> DataFrame:
        paths = [f"{self.path}/{kind}/version={v}" for v in versions]
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*paths)

    # ---- reading

    def load(self, version: int | None = None) -> DataFrame:
        """Whole records as of a version (the last by default)."""
        return whole(self._state(version).where("NOT deleted").select(*COLUMNS))

    def _state(self, version: int | None = None) -> DataFrame:
        version = self.version if version is None else version
        base = [v for v in self._versions("base") if v <= version][-1:]
        after = [v for v in self._versions("changes") if (base[0] if base else 0) < v <= version]
        parts = [self._read(kind, vs) for kind, vs in (("base", base), ("changes", after)) if vs]
        if not parts:
            raise ValueError(f"no version {version} in {self.path}")
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        last = rows.groupBy("id").agg(F.max_by(F.struct(*COLUMNS, "deleted"), "version").alias("r"))
        return last.select("r.*")

    def counters(self, version: int | None = None) -> dict[str, int]:
        """The last number given in each type: no number is given again, also when its record was deleted."""
        given = self._state(version).select(pseudonym.parsed(F.col("placeholder")).alias("p")).where("p IS NOT NULL")
        return {r["type"]: r["n"] for r in given.groupBy("p.type").agg(F.max("p.index").alias("n")).collect() if r["type"] in TYPES}

    def reverse(self, version: int | None = None) -> DataFrame:
        """token, id, original_text: what each placeholder and synthetic value stands for. Of records
        that share a synthetic value the last updated holds it; clashes says of how many."""
        records = self.load(version)
        both = records.select("placeholder", "synthetic_value", F.struct("updated", "index", "id", "original_text").alias("r"))
        tokens = both.select(F.col("placeholder").alias("token"), "r").union(both.where("synthetic_value <> ''").select("synthetic_value", "r"))
        return tokens.groupBy("token").agg(F.max("r").alias("r"), (F.count("*") - 1).alias("clashes")).select("token", "r.id", "r.original_text", "clashes")

    # ---- writing

    def _commit(self, rows: DataFrame, version: int, kind: str = "changes") -> int:
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/version={version}")
        return version

    def put(self, records: DataFrame, version: int | None = None) -> int:
        """Records that are new or replaced. Gives the version; one that is written again is overwritten."""
        version = self.version + 1 if version is None else version
        missing = [F.lit(None).cast("string").alias("notes")] if "notes" not in records.columns else ["notes"]
        own = [c for c in COLUMNS if c not in ("notes", "updated")]
        return self._commit(records.select(*own, *missing, F.lit(version).cast("long").alias("updated"), F.lit(False).alias("deleted")).select(*COLUMNS, "deleted"), version)

    def edit(self, edits: DataFrame) -> int:
        """Updates and deletions. edits: id and any of mode, synthetic_value, pinned, notes, entity_type (null:
        unchanged), and deleted. Ids that the table lacks do nothing; of several edits of a record the last column
        values that aren't null hold (by the column `at`, if there is one)."""
        version = self.version + 1
        fields = [c for c in ("mode", "synthetic_value", "pinned", "notes", "entity_type") if c in edits.columns]
        order = F.col("at") if "at" in edits.columns else F.lit(0)
        gone = F.bool_or(F.coalesce("deleted", F.lit(False))) if "deleted" in edits.columns else F.lit(False)
        one = edits.groupBy("id").agg(gone.alias("gone__"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(order, F.col(c)))).alias(f"new_{c}") for c in fields))
        joined = self.load().join(one, "id")
        for c in fields:
            joined = joined.withColumn(c, F.coalesce(f"new_{c}", c))
        joined = joined.withColumn("mode", coerced(F.col("mode"), F.col("synthetic_value"))).withColumn("updated", F.lit(version).cast("long"))
        return self._commit(joined.select(*COLUMNS, F.col("gone__").alias("deleted")), version)

    def upsert_aliases(self, names: DataFrame, taken: DataFrame) -> int:
        """Aliases for own names of code (name, role, k, first, uses), unique in the table and against
        taken (alias); uses of known names are added up."""
        version = self.version + 1
        state, counter = self.load(), self.counters().get(aliases.TYPE, 0)
        new, touched = aliases.upserted(names, taken, state, counter)
        used = state.join(touched.where("usable").groupBy("id").agg(F.sum("used").alias("used")), "id").withColumn("usage_count", F.col("usage_count") + F.col("used")).withColumn("updated", F.lit(version).cast("long"))
        rows = new.withColumn("notes", F.lit(None).cast("string")).withColumn("updated", F.lit(version).cast("long")).select(*COLUMNS).unionByName(used.select(*COLUMNS))
        return self._commit(rows.withColumn("deleted", F.lit(False)), version)

    def preview(self, names: DataFrame, taken: DataFrame, version: int | None = None) -> DataFrame:
        """name, alias: what upsert_aliases() on that version would give each name; nothing is written to the table."""
        version = self.version if version is None else version
        new, touched = aliases.upserted(names, taken, self.load(version), self.counters(version).get(aliases.TYPE, 0))
        return new.select(F.col("original_text").alias("name"), F.col("synthetic_value").alias("alias")).union(touched.where("usable").select("name", "alias"))

    def compact(self) -> int:
        """A base of the last version. Deleted records stay as marks, for their numbers."""
        version = self.version
        return self._commit(self._state(version).select(*COLUMNS, "deleted"), version, "base")
