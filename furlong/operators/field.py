"""Operators within a race's field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def race() -> WindowSpec:
    return Window.partitionBy("race_id")


def percentile_in_field(value: str) -> Column:
    """(below + half of the equal, itself included) / those with a value; null without one."""
    v = F.col(value)
    below = F.rank().over(race().orderBy(v.asc_nulls_last())) - 1
    equal = F.count(v).over(Window.partitionBy("race_id", value))
    return F.when(v.isNotNull(), (below + 0.5 * equal) / F.count(v).over(race()))


def versus_field(runners: DataFrame, value: str) -> DataFrame:
    """A value's percentile, and its differences to the field's mean and maximum."""
    v = F.col(value)
    return runners.select("runner_id", v.cast("double").alias(value), percentile_in_field(value).alias("percentile_in_field"), (v - F.avg(v).over(race())).alias("diff_to_field_mean"), (v - F.max(v).over(race())).cast("double").alias("diff_to_field_top"))


def draw_position(runners: DataFrame) -> DataFrame:
    pct = F.when(F.count("draw").over(race()) > 1, percentile_in_field("draw"))
    out = runners.select("runner_id", "field_size", F.col("draw").alias("draw_number"), pct.alias("draw_percentile"))
    third = F.lit(1.0) / 3
    p = F.col("draw_percentile")
    return out.withColumn("draw_bucket_low", (p <= third).cast("int")).withColumn("draw_bucket_mid", ((p > third) & (p <= 2 * third)).cast("int")).withColumn("draw_bucket_high", (p > 2 * third).cast("int"))


def win_normalised(runners: DataFrame, score: str = "model_score") -> DataFrame:
    """Scores floored at 1e-6 and divided by their sum in the race, to nine digits so that equal fractions are equal."""
    p = F.greatest(F.col(score), F.lit(1e-6))
    return runners.withColumn("p_win", F.round(p / F.sum(p).over(race()), 9))


def market_normalised(runners: DataFrame, price: str = "sp_decimal") -> DataFrame:
    """Inverse prices without the overround; one missing or non-positive price voids the race."""
    bad = F.sum(F.when(F.col(price).isNull() | (F.col(price) <= 0), 1).otherwise(0)).over(race())
    inverse = F.try_divide(F.lit(1.0), F.col(price))
    book = F.sum(inverse).over(race())
    return runners.withColumn("p_market", F.when(bad == 0, inverse / book)).withColumn("overround_pct", F.when(bad == 0, (book - 1) * 100))


def place_probabilities(runners: DataFrame, depths: range = range(2, 7)) -> DataFrame:
    """Place bands from win probabilities: p**(1/depth) scaled to min(depth, field) places, at most 0.999, then never falling with depth."""
    out, before = win_normalised(runners), None
    n = F.count(F.lit(1)).over(race())
    for k in depths:
        raw = F.greatest(F.pow("p_win", F.lit(1.0 / k)), F.lit(1e-6))
        scaled = F.least(raw * F.least(F.lit(k), n) / F.sum(raw).over(race()), F.lit(0.999))
        before = f"p_top{k - 1}" if k > depths.start else None
        out = out.withColumn(f"p_top{k}", F.greatest(scaled, F.col(before)) if before else scaled)
    return out


def collapse_risk() -> Column:
    return F.least(F.lit(1.0), F.col("pressure") / 2)


def with_pressure(runners: DataFrame) -> DataFrame:
    """Adds role (the draw's quarter of the field), leaders, prominent, holdup and pressure."""
    pct = percentile_in_field("draw")
    role = F.when(pct <= 0.25, "LEADER").when(pct <= 0.5, "PROMINENT").when(pct <= 0.75, "MIDFIELD").otherwise("HOLD_UP")
    rows = runners.withColumn("role", role)
    n = lambda r: F.sum((F.col("role") == r).cast("long")).over(race())
    rows = rows.withColumn("leaders", n("LEADER")).withColumn("prominent", n("PROMINENT")).withColumn("holdup", n("HOLD_UP"))
    pressure = F.least(F.lit(2.0), (1.5 * F.col("leaders") + 0.6 * F.col("prominent")) / F.count(F.lit(1)).over(race()))
    return rows.withColumn("pressure", pressure)


def race_shape(runners: DataFrame) -> DataFrame:
    """Expected pace from the field's roles."""
    rows, hold = with_pressure(runners), F.col("role") == "HOLD_UP"
    return rows.select(
        "runner_id",
        "role",
        "leaders",
        "prominent",
        "holdup",
        "pressure",
        collapse_risk().alias("collapse_risk"),
        F.when(F.col("role").isin("LEADER", "PROMINENT"), F.col("pressure")).otherwise(0.0).alias("prominent_in_burnout_risk"),
        F.when(hold, F.greatest(F.lit(0.0), F.least(F.lit(0.5), 0.5 - F.col("pressure")))).otherwise(0.0).alias("holdup_in_weak_pace_penalty"),
        F.when(hold, F.col("pressure")).otherwise(0.0).alias("closer_in_strong_pace_boost"),
    )
