"""Read models: what a page or report shows, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions import betting as b
from furlong.functions.scalars import place_odds
from furlong.operators.evaluation import brier



def dimensions() -> dict[str, Column]:
    """The ten labels by which results are broken down; a null label drops the row from its dimension."""
    c = F.col
    return {
        "code": c("flat_jumps"), "class": F.concat(F.lit("Class "), c("race_class").cast("string")), "field_size": b.field_band(c("field_size")), "odds": b.odds_band(c("sp_decimal")), "evidence": b.evidence_band(c("evidence")),
        "confidence": b.confidence_band(c("confidence")), "course": c("course"), "going": c("going"), "distance": b.distance_label(c("distance_f")), "age": b.age_band(c("age")),
    }


def breakdowns(rows: DataFrame, p: str = "p_win", won: str = "won", price: str = "sp_decimal") -> DataFrame:
    """(dimension, label) with number, wins, strike rate, expected wins, Brier score and flat-stake return, all dimensions in one grouping."""
    d = dimensions()
    labelled = rows.select(F.col(p).alias("p"), F.col(won).alias("won"), F.col(price).alias("price"), *[c.alias(k) for k, c in d.items()])
    sets = labelled.groupingSets([[k] for k in d], *d)
    bet = F.col("price").isNotNull()
    staked = F.count_if(bet)
    profit = F.sum(F.when(bet, F.col("won") * F.col("price"))) - staked
    out = sets.agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.avg("won").alias("strike_rate"), F.sum("p").alias("expected"), brier(F.col("p"), F.col("won")).alias("brier"), (100 * profit / staked).alias("roi_pct"))
    full = (1 << len(d)) - 1
    name, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(d):
        mine = F.col("g") == full - (1 << (len(d) - 1 - i))
        name, label = F.when(mine, k).otherwise(name), F.when(mine, F.col(k)).otherwise(label)
    return out.select(name.alias("dimension"), label.alias("label"), "n", "wins", "strike_rate", "expected", "brier", "roi_pct").filter("label is not null")


def chosen_band(depth: Column, depths: range = range(2, 7)) -> tuple[Column, Column]:
    """(probability, depth) of the band for a number of places: the exact one, else the nearest, the smaller of two."""
    every = F.array(*[F.struct(F.abs(F.lit(k) - depth).alias("away"), F.lit(k).alias("k"), F.col(f"p_top{k}").alias("p")) for k in depths])
    best = F.array_min(every)
    return best["p"], best["k"]


def scanner(rows: DataFrame) -> DataFrame:
    """Win and place value of runners with a price and a probability: edges of both, and each way their mean.

    Needs sp_decimal, p_win, the place bands, ``places`` and ``fraction`` of the terms.
    """
    odds = place_odds(F.col("sp_decimal"), F.col("fraction"))
    p, k = chosen_band(F.col("places"))
    ready = rows.filter(F.col("sp_decimal").isNotNull() & F.col("p_win").isNotNull())
    out = ready.withColumns({"win_edge": F.col("p_win") - 1 / F.col("sp_decimal"), "place_probability": p, "band": k, "place_odds": odds, "place_edge": p - 1 / odds})
    return out.withColumn("each_way", (F.col("win_edge") + F.col("place_edge")) / 2)


def scanned(rows: DataFrame, *, least_odds: float | None = None, most_odds: float | None = None, win_edge: float | None = None, place_edge: float | None = None, confidence: float | None = None, evidence: float | None = None, code: str | None = None, country: str | None = None) -> DataFrame:
    """The scanner's filters, each left out where it is None; a null edge is below any, a null confidence or evidence counts 0."""
    low = float("-inf")
    tests = [
        (least_odds, lambda v: F.col("sp_decimal") >= v), (most_odds, lambda v: F.col("sp_decimal") <= v), (win_edge, lambda v: F.coalesce("win_edge", F.lit(low)) >= v), (place_edge, lambda v: F.coalesce("place_edge", F.lit(low)) >= v),
        (confidence, lambda v: F.coalesce("confidence", F.lit(0.0)) >= v), (evidence, lambda v: F.coalesce("evidence", F.lit(0.0)) >= v), (code, lambda v: F.col("flat_jumps") == v), (country, lambda v: F.col("country") == v),
    ]
    for value, test in tests:
        if value is not None:
            rows = rows.filter(test(value))
    return rows


def slip_candidates(rows: DataFrame, least_odds: float = 0, most_odds: float = float("inf"), least_runners: int = 0) -> DataFrame:
    """Runners that take part; a missing price is below any limit from below and above none from above."""
    price = F.col("sp_decimal")
    return rows.filter(~F.col("non_runner") & (F.coalesce(price, F.lit(0.0)) >= least_odds) & (F.coalesce(price, F.lit(float("inf"))) <= most_odds) & (F.col("field_size") >= least_runners))


def best_of_race(rows: DataFrame, value: str) -> DataFrame:
    """Each race's runner of the highest value, the first drawn of equals; races without a value are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy("race_id").agg(F.max_by("runner_id", F.struct(value, -F.col("draw"))).alias("runner_id"), F.max(value).alias(value))


def siblings(runners: DataFrame, value: str) -> DataFrame:
    """Each runner's value with the others of its race, in order."""
    race = Window.partitionBy("race_id")
    every = F.array_sort(F.collect_list(F.struct("runner_id", F.col(value).alias("v"))).over(race))
    others = F.filter(every, lambda x: x["runner_id"] != F.col("runner_id"))
    return runners.select("runner_id", F.col(value), F.transform(others, lambda x: x["v"]).alias("others"))


def races_of_day(races: DataFrame, runners: DataFrame) -> DataFrame:
    """Races with the number of runners that take part, in the order of the day's list."""
    active = runners.groupBy("race_id").agg(F.count_if(~F.col("non_runner")).alias("active"), F.count(F.lit(1)).alias("declared"))
    return races.join(active, "race_id", "left").withColumns({"active": F.coalesce("active", F.lit(0)), "declared": F.coalesce("declared", F.lit(0))})


def odds_distribution(rows: DataFrame, cuts: tuple[float, ...] = (2, 4, 6, 8, 10)) -> DataFrame:
    """Runners by price in (low, high], and those without one; shares of all rows."""
    label = F.when(F.col("sp_decimal").isNull(), "missing").when(F.col("sp_decimal") <= cuts[0], f"<={cuts[0]}")
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        label = label.when(F.col("sp_decimal") <= high, f"{low}-{high}")
    counts = rows.groupBy(label.otherwise(f">{cuts[-1]}").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def bias_warnings(c: dict[str, Column]) -> Column:
    """Messages for what is thin or lopsided in a data set: races, courses with few races, share of one code, prices and ratings missing, runners that didn't take part or finish."""
    rules = [
        (c["races"] < 10_000, "fewer than 10000 races"), (c["thin_courses"] > 0, "courses with fewer than 10 races"), (F.greatest(c["flat_pct"], 100 - c["flat_pct"]) > 90, "nearly all races of one code"), (c["price_missing_pct"] > 20, "many runners without a starting price"),
        (c["rating_missing_pct"] > 20, "many runners without a rating"), (c["non_runner_pct"] > 15, "many non-runners"), (c["dnf_pct"] > 10, "many runners that did not finish"),
    ]
    return F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))


def completeness(missing: list[Column]) -> Column:
    """100 less the mean of the missing shares that are known."""
    known = F.filter(F.array(*missing), lambda x: x.isNotNull())
    return 100 - F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known))


def horse_pages(runners: DataFrame, latest: int = 5) -> DataFrame:
    """A row per horse: runs, wins, places, courses, first and last day, and its latest runs as race:position, newest first."""
    newest = Window.partitionBy("horse_id").orderBy(F.desc("race_ts"), F.desc("race_id"), F.desc("runner_id"))
    last = runners.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= latest).groupBy("horse_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat_ws(":", "race_id", F.coalesce(F.col("finishing_position").cast("string"), F.lit("-"))).alias("run")))).alias("last"))
    record = runners.groupBy("horse_id").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("finishing_position") == 1).alias("wins"), F.count_if(F.col("finishing_position") <= 3).alias("places"), F.countDistinct("course").alias("courses"), F.min("race_ts").alias("first_day"), F.max("race_ts").alias("last_day"))
    return record.join(last, record["horse_id"].eqNullSafe(last["horse_id"])).select(record["*"], F.array_join(F.transform("last", lambda x: x["run"]), " ").alias("latest"))
