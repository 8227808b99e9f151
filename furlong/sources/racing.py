"""Racing views over the star-schema tables.

``races`` are orders with their customer's nation and region; ``runners`` are
order lines, one for each order and part, with the race's columns; ``odds`` and
``field_changes`` are the event stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Going by customer number modulo 10; the last is unknown.
GOINGS = ["Firm", "Good to Firm", "Standard", "Good", "Standard to Slow", "Good to Soft", "Slow", "Soft", "Heavy", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of one task where the tables are dealt out by a key.
TASK_LINES = 200_000


def parts(spark: SparkSession, sf_dir: str, name: str = "lineitem", each: int = TASK_LINES) -> int:
    """Into how many parts to deal a table: more for more rows, as narrow rows that compress well fill a task's memory long before its share of bytes is reached. The rows are counted from the files' footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // each))


def races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per race: its time, course, conditions. ``field_size`` is a column of the runners."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    custom = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    going = F.element_at(F.array(*[F.lit(g) for g in GOINGS]), (F.col("o_custkey") % 10 + 1).cast("int"))
    return (
        table(spark, sf_dir, "orders")
        .join(custom, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("race_id"),
            F.col("o_orderdate").cast("timestamp").alias("race_ts"),
            F.col("n_name").alias("course"),
            F.col("r_name").alias("country"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("race_class"),
            F.when(F.col("o_orderstatus") == "F", "FLAT").otherwise("JUMPS").alias("flat_jumps"),
            (F.lit(5.0) + (F.col("o_orderkey") % 40).cast("double") / 2).alias("distance_f"),
            going.alias("going"),
            F.when(F.col("o_orderkey") % 2 == 0, "HANDICAP").otherwise("NON_HANDICAP").alias("handicap_type"),
        )
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per runner, without the race's columns.

    All windows are within a race, so the lines are dealt out by race once.
    """
    lines = table(spark, sf_dir, "lineitem").repartition(parts(spark, sf_dir), "l_orderkey")
    first = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_extendedprice", "l_suppkey", "l_linenumber"))
    kept = lines.withColumn("k", first).filter("k = 1")
    race = Window.partitionBy("l_orderkey")
    dnf = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), 1).otherwise(0)
    kept = kept.withColumn("draw", F.row_number().over(race.orderBy("l_partkey"))).withColumn("dnf", dnf)
    place = F.row_number().over(race.orderBy("dnf", F.desc("l_extendedprice"), "l_partkey"))
    return kept.select(
        (F.col("l_orderkey") * 100 + F.col("draw")).alias("runner_id"),
        F.col("l_orderkey").alias("race_id"),
        F.col("l_partkey").alias("horse_id"),
        F.col("l_suppkey").alias("trainer_id"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 60).alias("jockey_id"),
        "draw",
        (F.lit(112) + F.col("l_quantity").cast("int") % 42).alias("weight_lbs"),
        F.when(F.col("l_discount") != 0, (F.lit(40) + F.col("l_partkey") % 60 + F.round(F.col("l_discount") * 100).cast("int")).cast("int")).alias("official_rating"),
        F.when(F.col("l_tax") != 0, F.lit(1.0) + F.col("l_quantity") / 4).alias("sp_decimal"),
        "dnf",
        F.when(F.col("dnf") == 0, place).alias("finishing_position"),
        ((F.col("l_returnflag") == "N") & (F.col("l_linenumber") == 6)).alias("non_runner"),
        (F.lit(2) + F.col("l_partkey") % 9).cast("int").alias("age"),
        F.when(F.col("l_linenumber") % 4 != 0, F.concat(F.lit("h"), (F.col("l_linenumber") % 4).cast("string"))).alias("headgear"),
        F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("c"), (F.col("l_linenumber") % 3).cast("string"))).alias("pace_comment"),
        ((F.lit(51.0) - F.col("l_quantity")) / 51.0).alias("model_score"),
        F.count(F.lit(1)).over(race).cast("int").alias("field_size"),
    )


def runners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per runner with its race's columns."""
    return entries(spark, sf_dir).join(races(spark, sf_dir), "race_id")


def with_positions(runners: DataFrame) -> DataFrame:
    """In-running positions at three, two and one furlongs out: permutations of the draw."""
    return runners.withColumns({f"position_{k}f": (F.lit(1) + (F.col("draw") * 3 + k) % F.col("field_size")).cast("int") for k in (3, 2, 1)})


def with_form(runners: DataFrame) -> DataFrame:
    """With in-running positions, lengths beaten, finishing speed, the jockey's claim and the projected role (by the draw's quarter of the field)."""
    from furlong.operators.field import percentile_in_field

    pct, claim = percentile_in_field("draw"), F.col("jockey_id") % 4
    role = F.when(pct <= 0.25, "LEADER").when(pct <= 0.5, "PRONOUNCED_PACE").when(pct <= 0.75, "MIDDIVISION").otherwise("HOLD_UP")
    return with_positions(runners).withColumns({
        "beaten": (F.col("finishing_position") - 1) * F.lit(1.25),
        "speed": (F.lit(90) + (F.col("draw") * 7 + F.col("horse_id")) % 20).cast("double"),
        "claim": F.when(claim == 0, 5).when(claim == 1, 3),
        "role": role,
    })


def odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price ticks: the event's user is the runner, its type the bookmaker; a day's off is at 18:00, purchases are starting prices."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("runner_id"),
        F.col("event_type").alias("bookmaker"),
        F.col("ts").cast("timestamp").alias("tick_ts"),
        (F.lit(1.0) + F.col("value")).alias("price"),
        F.expr("date_trunc('DAY', cast(ts as timestamp)) + interval 18 hours").alias("off_ts"),
        (F.col("event_type") == "purchase").alias("is_sp"),
        "event_id",
    )


def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only value log: entity, field, value, time from which it holds."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("field_name"), F.get_json_object("props", "$.k").cast("long").alias("field_value"), F.col("ts").cast("timestamp").alias("effective_ts"), "event_id")
