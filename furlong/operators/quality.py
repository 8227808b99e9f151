"""Import, identity, bias and quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accented letters of Latin-1 and their base letters.
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_BASE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def normalize_name(name: Column) -> Column:
    """Accents off, other letters outside ASCII dropped, lower case, without apostrophes, backticks, dots and commas, single blanks."""
    plain = F.regexp_replace(F.translate(name, _ACCENTED, _BASE), "[^\\x00-\\x7F]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), "['`.,]", ""), "\\s+", " "))


def import_once(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each natural key, with the number of rows that it stands for; a second import of the same rows changes nothing."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("k", F.row_number().over(w)).withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter("k = 1").drop("k")


def islands(rows: DataFrame, within: str, order: list[str], key: str) -> DataFrame:
    """Numbers the runs of equal consecutive keys in each group, from 1."""
    w = Window.partitionBy(within).orderBy(*order)
    changed = F.coalesce((F.col(key) != F.lag(key).over(w)).cast("int"), F.lit(1))
    return rows.withColumn("__changed", changed).withColumn("island", F.sum("__changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__changed")


def resolve(names: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Each record's canonical id, the smallest of its normalized name; a name of several records is queued for review."""
    rows = names.withColumn("normalized", normalize_name(F.col(name_col)))
    found = rows.groupBy("normalized").agg(F.min(id_col).alias("canonical_id"), F.count(F.lit(1)).alias("candidates"))
    status = F.when(F.col("candidates") > 1, "QUEUED").otherwise("NEW")
    return rows.join(found, "normalized").select(id_col, "normalized", "canonical_id", "candidates", status.alias("status"))


def aliases(names: DataFrame, held: DataFrame) -> DataFrame:
    """(entity_type, raw_name, canonical_id, created) once for each spelling: names without a table of their own go by their normalized text; ``created`` tells spellings that aren't held."""
    known = held.select("entity_type", "raw_name").distinct().withColumn("created", F.lit(False))
    out = names.filter("raw_name is not null").select("entity_type", "raw_name").distinct().join(known, ["entity_type", "raw_name"], "left")
    return out.select("entity_type", "raw_name", normalize_name(F.col("raw_name")).alias("canonical_id"), F.coalesce("created", F.lit(True)).alias("created"))


def missing_days(races: DataFrame) -> DataFrame:
    """Days between the first and the last race without a race."""
    days = races.select(F.to_date("race_ts").alias("day")).distinct()
    every = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return every.join(days, "day", "left_anti")


def availability(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: rows, rows with a value, and their share in percent."""
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["n"], columns, "feature", "present").select("feature", F.col("n").alias("rows"), "present", (100.0 * F.col("present") / F.col("n")).alias("available_pct"))


def year_bias(runners: DataFrame) -> DataFrame:
    """By year: races, runners, mean field, share of flat racing, favourites' strike rate (the favourite is the shortest price of its race)."""
    race = Window.partitionBy("race_id")
    favourite = F.col("sp_decimal") == F.min("sp_decimal").over(race)
    rows = runners.withColumn("fav", F.coalesce(favourite.cast("int"), F.lit(0))).withColumn("won", F.coalesce((F.col("finishing_position") == 1).cast("int"), F.lit(0)))
    out = rows.groupBy(F.year("race_ts").alias("year")).agg(F.countDistinct("race_id").alias("races"), F.count(F.lit(1)).alias("runners"), F.sum((F.col("flat_jumps") == "FLAT").cast("long")).alias("flat"), F.sum("fav").alias("favourites"), F.sum(F.col("fav") * F.col("won")).alias("fav_wins"))
    return out.select("year", "races", "runners", (F.col("runners") / F.col("races")).alias("mean_field"), (100.0 * F.col("flat") / F.col("runners")).alias("flat_pct"), F.try_divide(100.0 * F.col("fav_wins"), F.col("favourites")).alias("favourite_win_pct"))
