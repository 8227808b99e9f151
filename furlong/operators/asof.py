"""Point-in-time reconstruction: what was known at a time, never what came later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Named snapshots by minutes before the off.
OFFSETS = {"h24": 1440, "h6": 360, "h1": 60, "m30": 30, "m10": 10, "m5": 5, "off_time": 0}


def fields_as_of(changes: DataFrame, at: str, fields: list[str]) -> DataFrame:
    """A row per entity with each field's latest value of ``effective_ts <= at``; null where none is known.  Ties go to the later event."""
    known = changes.filter(F.col("effective_ts") <= F.lit(at).cast("timestamp"))
    latest = lambda f: F.max_by(F.when(F.col("field_name") == f, F.col("field_value")), F.when(F.col("field_name") == f, F.struct("effective_ts", "event_id")))
    return known.groupBy("entity_id").agg(*[latest(f).alias(f) for f in fields])


def as_of_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str) -> DataFrame:
    """Adds to each left row the value of the latest right row of its key with ``right_ts <= left_ts``, null where there is none.

    Both sides go through one window over their union, so nothing is paired and the cost is one shuffle by key.
    """
    probes = left.select(F.col(key), F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__value"))
    facts = right.select(F.col(key), F.col(right_ts).alias("__ts"), F.lit(0).alias("__side"), F.lit(None).cast(probes.schema["__row"].dataType).alias("__row"), F.col(value).alias("__value"))
    w = Window.partitionBy(key).orderBy("__ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    wrapped = F.last(F.when(F.col("__side") == 0, F.struct("__value")), ignorenulls=True).over(w)
    return probes.unionByName(facts).withColumn("__as_of", wrapped).filter("__side = 1").select("__row.*", F.col("__as_of.__value").alias(f"{value}_as_of"))


def named_snapshots(odds: DataFrame) -> DataFrame:
    """Per runner and bookmaker and day's off: opening, the latest price at each offset before the off, and the last starting price; ticks after the off are ignored."""
    before = odds.filter("tick_ts <= off_ts")
    order = F.struct("tick_ts", "event_id")
    price = lambda test: F.max_by(F.when(test, F.col("price")), F.when(test, order))
    at = {name: F.col("tick_ts") <= F.col("off_ts") - F.expr(f"interval {minutes} minutes") for name, minutes in OFFSETS.items()}
    return before.groupBy("runner_id", "bookmaker", "off_ts").agg(F.min_by("price", order).alias("opening"), *[price(test).alias(name) for name, test in at.items()], price(F.col("is_sp")).alias("sp"), F.count(F.lit(1)).alias("ticks"))
