"""Sectional points: a runner's times by segment, checked, one of each, and filled where some are missing.

A point says how long a segment took, how far it was, and perhaps what the race's
clock showed at its end.  All work is within a runner, whose segments are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A point's columns: whose and which, distance in furlongs, seconds, metres a second, position, the clock at the segment's end, who said it and when.
POINT = ["runner_id", "segment_index", "distance_f", "seconds", "speed_mps", "position_in_race", "clock", "source", "recorded_at"]
METRES = 201.168  # a furlong's (fixed value)
#: How far the clock may be off the sum of its segments' times.
TOLERANCE = 0.5


def problems() -> Column:
    """What is wrong with a point by itself."""
    return F.array_compact(F.array(
        F.when(F.col("runner_id").isNull(), "runner is missing"), F.when(F.col("segment_index").isNull(), "segment is missing"), F.when(F.col("segment_index") < 0, "segment is negative"),
        F.when(F.col("seconds") <= 0, "time is not positive"), F.when(F.col("distance_f") <= 0, "distance is not positive"), F.when(F.col("position_in_race") < 1, "position is below 1"),
    ))


def one_each(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, rejected): the point of each runner and segment that was recorded last, and the others with a ``reason``.

    Points with problems of their own are rejected first. Of points of one time the first by source, then by its figures, stays.
    """
    judged = points.withColumn("reason", F.array_join(problems(), "; "))
    sound = judged.filter("reason = ''")
    order = [F.col("recorded_at").desc_nulls_last(), F.col("source").asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("seconds", "clock", "distance_f", "speed_mps", "position_in_race")]]
    numbered = sound.withColumn("__n", F.row_number().over(Window.partitionBy("runner_id", "segment_index").orderBy(*order)))
    late = numbered.filter("__n > 1").withColumn("reason", F.lit("superseded")).drop("__n")
    return numbered.filter("__n = 1").drop("__n", "reason"), judged.filter("reason <> ''").unionByName(late)


def ordered(points: DataFrame) -> DataFrame:
    """Adds ``status``: whether the clock runs forward from segment to segment and agrees with the segments' times.

    ``backwards``: at or before the clock of the runner's last segment that has one. ``off``: it differs by more than ``TOLERANCE`` from that
    clock and the time between, where no segment's time is missing in between. Else ``ok``.
    """
    runner = Window.partitionBy("runner_id").orderBy("segment_index")
    before = runner.rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.sum(F.coalesce("seconds", F.lit(0.0))).over(runner)
    rows = points.withColumns({"__so_far": so_far, "__untimed": F.sum(F.col("seconds").isNull().cast("int")).over(runner)})
    last = F.last(F.when(F.col("clock").isNotNull(), F.struct("clock", "segment_index", "__so_far", "__untimed")), ignorenulls=True).over(before)
    rows = rows.withColumns({"__last": last, "__place": F.row_number().over(runner)})
    rows = rows.withColumn("__last_place", F.last(F.when(F.col("clock").isNotNull(), F.col("__place")), ignorenulls=True).over(before))
    whole = (F.col("__untimed") == F.col("__last.__untimed")) & (F.col("segment_index") - F.col("__last.segment_index") == F.col("__place") - F.col("__last_place"))
    drift = F.abs(F.col("clock") - F.col("__last.clock") - (F.col("__so_far") - F.col("__last.__so_far")))
    status = F.when(F.col("clock") <= F.col("__last.clock"), "backwards").when(whole & (drift > TOLERANCE), "off").otherwise("ok")
    return rows.withColumn("status", status).drop("__so_far", "__untimed", "__last", "__place", "__last_place")


def filled(points: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """(runner_id, segment_index, distance_f, seconds, filled): every segment of each runner, once, in whole sequences.

    Missing segments between two known ones get the time that the race's clock leaves for them (the clock before the later one less the clock
    of the earlier one), in equal shares of their distance; without both clocks the pace runs straight from the earlier segment's to the later one's.
    A missing distance is that of the runner's earlier neighbour. ``segments`` (runner_id, n_segments) says how many there are; what lies before
    the first and after the last known one has neighbours on one side only and stays null, marked as filled is false.
    """
    runner = Window.partitionBy("runner_id").orderBy("segment_index")
    here = F.struct("segment_index", "distance_f", "seconds", "clock")
    gaps = points.withColumn("__next", F.lead(here).over(runner))
    start_of_next = F.col("__next.clock") - F.col("__next.seconds")
    missing = (F.col("__next.segment_index") - F.col("segment_index") - 1).cast("double")
    pace = lambda s, d: F.try_divide(s, d)
    own, other = pace(F.col("seconds"), F.col("distance_f")), pace(F.col("__next.seconds"), F.col("__next.distance_f"))
    share = (F.col("i") - F.col("segment_index")) / (missing + 1)
    left = start_of_next - F.col("clock")
    straight = (own + share * (other - own)) * F.col("distance_f")
    # a point and the missing ones after it come out of one pass
    gap = F.coalesce(F.col("__next.segment_index") > F.col("segment_index") + 1, F.lit(False))
    rows = gaps.select("*", F.posexplode(F.when(gap, F.sequence(F.col("segment_index"), F.col("__next.segment_index") - 1)).otherwise(F.array("segment_index"))).alias("__k", "i"))
    made = F.col("__k") > 0
    out = rows.select("runner_id", F.col("i").alias("segment_index"), "distance_f", F.when(~made, F.col("seconds")).when(left > 0, left / missing).otherwise(straight).alias("seconds"), made.alias("filled"))
    if segments is not None:
        every = segments.filter("n_segments > 0").select("runner_id", F.explode(F.sequence(F.lit(0), F.col("n_segments").cast("int") - 1)).alias("segment_index"))
        out = every.withColumn("segment_index", F.col("segment_index").cast(points.schema["segment_index"].dataType)).join(out, ["runner_id", "segment_index"], "full_outer").withColumn("filled", F.coalesce("filled", F.lit(False)))
    return out


def summaries(whole: DataFrame) -> DataFrame:
    """For each runner: segments, filled ones, total seconds (null unless all are known), mean speed, and the last segment's speed against the mean in percent."""
    last = F.max_by(F.struct("seconds", "distance_f"), "segment_index")
    out = whole.groupBy("runner_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if("filled").alias("filled"), F.when(F.count_if(F.col("seconds").isNull()) == 0, F.sum("seconds")).alias("seconds"), F.sum("distance_f").alias("distance_f"), last.alias("last"))
    speed = F.try_divide(F.col("distance_f") * METRES, F.col("seconds"))
    final = F.try_divide(F.col("last.distance_f") * METRES, F.col("last.seconds"))
    return out.select("runner_id", "segments", "filled", "seconds", speed.alias("mean_mps"), (100 * F.try_divide(final, speed)).alias("finishing_speed_pct"))



def whole_sequences(points: DataFrame, parts: int | None = None) -> DataFrame:
    """Points one each, filled: what most readers want. They are dealt out by runner once, into ``parts`` if it is given, and put in order once."""
    return filled(one_each(points.repartition(*([parts] if parts else []), "runner_id"))[0])
