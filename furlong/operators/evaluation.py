"""Scores of predicted probabilities, value and profit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6
COHORTS = [-0.5, -0.2, -0.1, -0.05, 0.0, 0.05, 0.1]


def brier(p: Column, y: Column) -> Column:
    return F.avg(F.pow(p - y, 2))


def log_loss(p: Column, y: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


SCORE_BUCKETS = 4096


def roc_auc(rows: DataFrame, p: str, y: str) -> DataFrame:
    """Rank statistic from counts by distinct score: rows of a score combine before they meet in one order.

    Scores are probabilities: they are put in order within each of ``SCORE_BUCKETS`` equal ranges, and the ranges'
    totals, a table of fixed size, are put in order among themselves.
    """
    counts = rows.groupBy(p).agg(F.sum(y).alias("ones"), F.sum(1 - F.col(y)).alias("zeros")).withColumn("bucket", F.floor(F.col(p) * SCORE_BUCKETS))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    ranges = counts.groupBy("bucket").agg(F.sum("zeros").alias("z")).select("bucket", F.coalesce(F.sum("z").over(up_to(Window.orderBy("bucket"))), none).alias("earlier"))
    inside = counts.withColumn("inside", F.coalesce(F.sum("zeros").over(up_to(Window.partitionBy("bucket").orderBy(p))), none))
    ranked = inside.join(ranges, "bucket").select("ones", "zeros", (F.col("inside") + F.col("earlier")).alias("below"))
    return ranked.agg(F.try_divide(F.sum(F.col("ones") * (F.col("below") + F.col("zeros") / 2)), (F.sum("ones") * F.sum("zeros")).cast("double")).alias("auc"))


def calibration(rows: DataFrame, p: str, y: str, buckets: int = 10) -> DataFrame:
    """Equal-width buckets, the last one closed; empty buckets stay."""
    number = F.least(F.floor(F.round(F.col(p) * buckets, 8)), F.lit(buckets - 1)).cast("int")
    found = rows.groupBy(number.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("observed"))
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def flat_stake(rows: DataFrame, by: list[Column], price: str, won: str) -> DataFrame:
    """Bets, returns and return on investment of one unit a row that has a price, by group."""
    bets = rows.filter(F.col(price).isNotNull())
    out = bets.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(won) * F.col(price)).alias("returned"))
    return out.withColumn("profit", F.col("returned") - F.col("n")).withColumn("roi_pct", 100 * F.col("profit") / F.col("n"))


def edges(rows: DataFrame, p: str, price: str) -> DataFrame:
    q = F.when(F.col(price) > 1, 1 / F.col(price))
    return rows.withColumn("implied", q).withColumn("fair_odds", F.when((F.col(p) > 0) & (F.col(p) <= 1), 1 / F.col(p))).withColumn("edge", F.col(p) - q).withColumn("relative_edge", F.try_divide(F.col(p) - q, q))


def top_pick(rows: DataFrame, p: str, won: str) -> DataFrame:
    """How often each race's most probable runner wins; ties go to the smaller runner."""
    best = rows.groupBy("race_id").agg(F.max_by(won, F.struct(p, -F.col("runner_id"))).alias("won"))
    return best.agg(F.count(F.lit(1)).alias("races"), F.sum("won").alias("wins"), F.avg("won").alias("strike_rate"))


def against_market(rows: DataFrame, model: str, market: str, won: str) -> DataFrame:
    """Both probabilities' scores on the rows that have both, and whether the model's are lower."""
    y = F.col(won)
    common = rows.filter(F.col(model).isNotNull() & F.col(market).isNotNull())
    out = common.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(c), y).alias(f"{name}_{side}") for name, f in (("brier", brier), ("log_loss", log_loss)) for side, c in (("model", model), ("market", market))])
    return out.withColumn("beats_brier", F.col("brier_model") < F.col("brier_market")).withColumn("beats_log_loss", F.col("log_loss_model") < F.col("log_loss_market"))


def cohort(edge: Column) -> Column:
    """Right-closed bins of the edge; their number from 0."""
    out = F.when(edge <= COHORTS[0], 0)
    for i, cut in enumerate(COHORTS[1:], 1):
        out = out.when(edge <= cut, i)
    return F.when(edge.isNotNull(), out.otherwise(len(COHORTS)))


def chronological_split(races: DataFrame, train: float = 0.6, validate: float = 0.2) -> DataFrame:
    """Races in order of time, cut into 60, 20 and 20 percent.

    Places in the order come from day totals, so a window runs over days and within a day, never over all races in one task.
    """
    days = races.groupBy(F.to_date("race_ts").alias("day")).agg(F.count(F.lit(1)).alias("k"))
    before = days.select("day", F.coalesce(F.sum("k").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("earlier"), F.sum("k").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    placed = races.withColumn("day", F.to_date("race_ts")).join(before, "day")
    place = F.col("earlier") + F.row_number().over(Window.partitionBy("day").orderBy("race_ts", "race_id"))
    cut = lambda share: F.floor(F.col("total") * F.lit(share))
    split = F.when(place <= cut(train), "train").when(place <= cut(train + validate), "validation").otherwise("test")
    return placed.select("race_id", split.alias("split"))
