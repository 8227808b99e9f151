"""Provenance: an append-only log of what was recorded, by whom and when, and what it says.

An entry's key is a hash of the entity, the provider, its record and the payload's
hash.  The same record seen again is a new entry of the same key: entries are
never changed; first and last sight are folded when the log is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.operators.ingest import payload_hash
from furlong.sources.shared import Files

# Fixed value: the label of races that were there before provenance was recorded.
LEGACY = "legacy-seed-or-generator"
ENTRY = ["entity_type", "entity_id", "data_domain", "provider", "provider_record_id", "payload_hash"]


def entries(rows: DataFrame, entity_type: str, entity_id: str, provider: Column, retrieved_at: Column, payload: list[str], domain: str = "RACE_DATA", record_id: Column | None = None, effective_at: Column | None = None) -> DataFrame:
    """An entry for each row: what it is about, who gave it, when, and the hash of its payload."""
    none = F.lit(None)
    values = {
        "entity_type": F.lit(entity_type), "entity_id": F.col(entity_id).cast("string"), "data_domain": F.lit(domain), "provider": provider, "provider_record_id": (none if record_id is None else record_id).cast("string"),
        "payload_hash": payload_hash(payload), "retrieved_at": retrieved_at.cast("timestamp"), "effective_at": (none if effective_at is None else effective_at).cast("timestamp"),
    }
    return with_key(rows.select(*[c.alias(k) for k, c in values.items()]))


def with_key(log: DataFrame) -> DataFrame:
    """Nulls differ from empty texts in the key."""
    return log.withColumn("entry_key", F.sha2(F.to_json(F.struct(*ENTRY), {"ignoreNullFields": "false"}), 256))


def record(path: str, found: DataFrame, batch: str) -> int:
    """Appends a batch's entries, one of each key and time, and returns how many there are; a batch that is there is left as it is."""
    files = Files(found.sparkSession, path)
    if not files.exists(f"batch={batch}/_SUCCESS"):
        found.dropDuplicates(["entry_key", "retrieved_at"]).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return found.sparkSession.read.parquet(f"{path}/batch={batch}").count()


def folded(log: DataFrame) -> DataFrame:
    """A row for each key: first_seen, last_seen, times, the number of batches, and whether it is what its provider said last of the entity.

    Of entries of one time the greater hash counts as the last.
    """
    seen = log.groupBy("entry_key").agg(*[F.first(c).alias(c) for c in ENTRY], F.min("retrieved_at").alias("first_seen"), F.max("retrieved_at").alias("last_seen"), F.count(F.lit(1)).alias("times"), F.countDistinct("batch").alias("batches"))
    of = ["entity_type", "entity_id", "data_domain", "provider"]
    last = seen.groupBy(*of).agg(F.max(F.struct("last_seen", "payload_hash", "entry_key")).alias("last"), F.count(F.lit(1)).alias("versions"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in of]
    both = seen.alias("s").join(last.alias("l"), same)
    return both.select("s.*", "l.versions", (F.col("s.entry_key") == F.col("l.last.entry_key")).alias("current"))


def providers(ids: DataFrame, log: DataFrame, id_col: str = "race_id", entity_type: str = "Race", fallback: str = LEGACY) -> DataFrame:
    """(id, providers): who gave an entity's records, in order; the fallback label alone for one without provenance."""
    known = log.filter((F.col("entity_type") == entity_type) & F.col("provider").isNotNull()).groupBy(F.col("entity_id").alias("__id")).agg(F.array_sort(F.collect_set("provider")).alias("providers"))
    wanted = ids.select(id_col).distinct()
    return wanted.join(known, F.col(id_col).cast("string") == F.col("__id"), "left").select(id_col, F.coalesce("providers", F.array(F.lit(fallback))).alias("providers"))


def providers_of_set(ids: DataFrame, log: DataFrame, id_col: str = "race_id", entity_type: str = "Race", fallback: str = LEGACY) -> DataFrame:
    """One row: the distinct providers of all the entities together, the fallback if none has provenance; without ids there are none."""
    wanted = ids.select(F.col(id_col).cast("string").alias("entity_id")).distinct()
    found = log.filter((F.col("entity_type") == entity_type) & F.col("provider").isNotNull()).join(wanted, "entity_id", "left_semi").agg(F.array_sort(F.collect_set("provider")).alias("found"))
    n = wanted.agg(F.count(F.lit(1)).alias("n"))
    return found.join(n, F.lit(True)).select(F.when(F.size("found") > 0, F.col("found")).when(F.col("n") > 0, F.array(F.lit(fallback))).otherwise(F.array().cast("array<string>")).alias("providers"))  # a row each


def changed(log: DataFrame) -> DataFrame:
    """Entities whose payload a provider has changed: how often, when first and last."""
    of = ["entity_type", "entity_id", "data_domain", "provider"]
    return folded(log).groupBy(*of).agg(F.countDistinct("payload_hash").alias("payloads"), F.min("first_seen").alias("since"), F.max("first_seen").alias("latest")).filter("payloads > 1")
