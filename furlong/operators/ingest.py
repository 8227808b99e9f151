"""Import: keys, grouping into races, append once, histories of values, provenance and dataset versions.

Tables are Parquet folders that only grow; what must be unique is kept so by an anti-join before the append.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def race_key(provider_id: Column, *parts: Column) -> Column:
    """The provider's id, else SHA-256 of the parts."""
    return F.coalesce(F.nullif(F.trim(provider_id), F.lit("")), F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256))


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys; nulls are written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def grouped_races(rows: DataFrame, key: list[str], race: list[str], runner: list[str], order: str) -> DataFrame:
    """One row per race: its columns from the first row in ``order``, its runners in that order.

    Rows of a key count as one race wherever they stand, so that a race that a file splits is whole again.
    """
    first = F.min_by(F.struct(*race), F.col(order)).alias("race")
    return rows.groupBy(*key).agg(first, F.array_sort(F.collect_list(F.struct(F.col(order), *runner))).alias("runners")).select(*key, "race.*", "runners", F.size("runners").alias("n_runners"))


def split_valid(rows: DataFrame, errors: str = "errors") -> tuple[DataFrame, DataFrame]:
    """Rows without errors, and the others with their messages joined."""
    return rows.filter(F.size(errors) == 0).drop(errors), rows.filter(F.size(errors) > 0).withColumn(errors, F.array_join(errors, "; "))


def not_yet(new: DataFrame, held: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose key isn't there, once each."""
    return new.dropDuplicates(key).join(held.select(*key).distinct(), key, "left_anti")


def append_once(new: DataFrame, path: str, key: list[str], batch: str) -> dict[str, int]:
    """Appends the rows of a batch that the table at ``path`` doesn't hold. A batch that was written before isn't written again.

    Returns the numbers of rows created and skipped. Each batch has a folder of its own, replaced whole if the job is repeated.
    """
    spark = new.sparkSession
    folder = f"{path}/batch={batch}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    exists = lambda p: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    if exists(f"{folder}/_SUCCESS"):
        return {"created": 0, "skipped": new.count()}
    fresh = not_yet(new, spark.read.parquet(path), key) if exists(path) else new.dropDuplicates(key)
    fresh.write.mode("overwrite").parquet(folder)
    created = spark.read.parquet(folder).count()
    return {"created": created, "skipped": new.count() - created}


def batch_status(created: Column, failed: Column) -> Column:
    return F.when(failed == 0, "SUCCESS").when(created > 0, "PARTIAL").otherwise("FAILED")


def changes(rows: DataFrame, keys: list[str], fields: list[str], at: str) -> DataFrame:
    """(keys, field, value, effective_at): a row for each value that isn't null, as text."""
    wide = rows.select(*keys, F.col(at).alias("effective_at"), *[F.col(f).cast("string").alias(f) for f in fields])
    return wide.unpivot([*keys, "effective_at"], fields, "field", "value").filter("value is not null")


def superseded(terms: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Adds superseded_at, when the next row of the same key begins (null: still current)."""
    return terms.withColumn("superseded_at", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def current_at(terms: DataFrame, keys: list[str], at: str, moment: Column) -> DataFrame:
    """Each key's latest row that holds at a moment."""
    values = [c for c in terms.columns if c not in keys]
    return terms.filter(F.col(at) <= moment).groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("r")).select(*keys, "r.*")


def ids_of(names: DataFrame, held: DataFrame, name: str, id_col: str) -> DataFrame:
    """(name, id) of all names: those that are held keep theirs, new ones get one from their text."""
    distinct = names.select(name).filter(F.col(name).isNotNull()).distinct()
    return distinct.join(held.select(name, id_col), name, "left").select(name, F.coalesce(F.col(id_col), F.sha2(F.col(name), 256)).alias(id_col), F.col(id_col).isNull().alias("created"))


def one_match(rows: DataFrame, known: DataFrame, key: list[str], row_id: str, target: str) -> DataFrame:
    """(row_id, target, reason): the one match of a row; with none or several the target is null and the reason says so."""
    counted = known.groupBy(*key).agg(F.count(F.lit(1)).alias("matches"), F.min(target).alias(target))
    out = rows.select(row_id, *key).join(counted, key, "left")
    n = F.coalesce("matches", F.lit(0))
    return out.select(row_id, F.when(n == 1, F.col(target)).alias(target), F.when(n == 0, "no match").when(n > 1, F.concat(n.cast("string"), F.lit(" matches"))).alias("reason"))


def merged_source(types: Column) -> Column:
    """All alike: that type; else MIXED; null of none."""
    kinds = F.collect_set(types)
    return F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).when(F.size(kinds) > 1, "MIXED")


# What a dataset needs to be fit for training, and its levels.
READY_RACES, READY_RUNNERS = 10_000, 100_000


def readiness(races: Column, runners: Column, source: Column) -> dict[str, Column]:
    """Whether a dataset is fit for training (only a real one can be), and its level by races."""
    ready = (races >= READY_RACES) & (runners >= READY_RUNNERS) & F.coalesce(source == "REAL", F.lit(False))
    return {"ready": ready, "level": F.when(races >= 100_000, "PRODUCTION").when(races >= 25_000, "ADVANCED").when(races >= READY_RACES, "BASELINE").otherwise("DEMO")}


def dataset_version(races: DataFrame, runners: DataFrame, ids: DataFrame) -> DataFrame:
    """One row that describes the races named by ``ids`` (race_id): how many, over what days, of what source, ready or not; ``missing`` counts ids without a race."""
    wanted = ids.select("race_id").distinct()
    kept = races.join(wanted, "race_id", "left_semi")
    about = kept.agg(F.count(F.lit(1)).alias("races"), F.min("race_ts").alias("first_race"), F.max("race_ts").alias("last_race"), merged_source(F.col("source_type")).alias("source_type"))
    lines = runners.join(wanted, "race_id", "left_semi").agg(F.count(F.lit(1)).alias("runners"), F.count_if(F.col("official_rating").isNull()).alias("unrated"))
    absent = wanted.join(races, "race_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    one = about.join(lines, F.lit(True)).join(absent, F.lit(True))  # a row each
    return one.withColumns(readiness(F.col("races"), F.col("runners"), F.col("source_type")))


def without_restricted(races: DataFrame, provenance: DataFrame, status: str = "RESTRICTED") -> DataFrame:
    """Races of which no provenance row has the status; races without provenance stay."""
    return races.join(provenance.filter(F.col("status") == status).select("race_id").distinct(), "race_id", "left_anti")


def upserted(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The held rows with the new ones' values put in where the key is the same, and the new keys added; a null value keeps the held one."""
    other = [c for c in held.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"new_{c}") for c in other])
    return held.join(fresh, key, "full_outer").select(*key, *[F.coalesce(f"new_{c}", c).alias(c) for c in other])
