"""What a horse's earlier runs tell, as running totals and offsets along its career.

A runner sees the runs of its horse that are strictly earlier, as in ``history``, but nothing carries whole pasts: equal
courses, goings and the like are totals of windows by that column, the latest runs are offsets, and only what depends on a
comparison with today's own value (distances, classes, goings by weight) collects a few numbers of each run, in the last
window of all, so that no array is sorted, spilled or shuffled. Runs of one time don't see each other; ties go by race.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from furlong.functions.scalars import finishing_percentile, hits, rate, softness

HORSE = ["horse_id", "__apart"]
DAY = 86_400_000_000
#: Weight of a run against the one after it: half three runs later.
FADE = 2 ** (-1 / 3)
HITS = ("starts", "wins", "places")


def dealt(runners: DataFrame, *columns: str | Column, parts: int | None = None) -> DataFrame:
    """The columns (all, unless named), dealt out by horse (into ``parts``, if given), with the run's time and its percentile; a run without a horse is alone."""
    chosen = list(columns or ["*"])
    pct = finishing_percentile(F.col("finishing_position"), F.col("field_size"))
    made = [F.when(F.col("horse_id").isNull(), F.col("runner_id")).alias("__apart"), F.unix_micros("race_ts").alias("__at"), pct.alias("pct")]
    return runners.select(*chosen, *made).repartition(*([parts] if parts else []), *HORSE)


def before(*keys: str, days: int = 0) -> WindowSpec:
    """The horse's strictly earlier runs, of an equal key if any; with ``days`` those before that many days ago."""
    return Window.partitionBy(*HORSE, *keys).orderBy("__at").rangeBetween(Window.unboundedPreceding, -days * DAY - 1)


def line() -> WindowSpec:
    """The horse's runs in order."""
    return Window.partitionBy(*HORSE).orderBy("__at", "race_id", "runner_id")


def latest(k: int) -> WindowSpec:
    return line().rowsBetween(-k, -1)


def along(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds values over ``line()``; what the first run of a time sees holds for all runs of that time."""
    same = Window.partitionBy(*HORSE, "__at").orderBy("race_id", "runner_id")
    return rows.withColumns(values).withColumns({c: F.first(c).over(same) for c in values})


def totals(value: Column, *keys: str) -> Column:
    return F.coalesce(F.sum(value).over(before(*keys)), F.lit(0).cast("long"))


def runs_before() -> Column:
    return F.count(F.lit(1)).over(before())


def _hit() -> dict[str, Column]:
    return {"starts": F.lit(1).cast("long"), "wins": hits(F.col("finishing_position") == 1), "places": hits(F.col("finishing_position") <= 3)}


def counted(rows: DataFrame, prefix: str, key: str) -> DataFrame:
    """Adds starts, wins and places of the earlier runs of an equal key as ``<prefix>_starts`` and so on; nothing equals an unknown key."""
    return rows.withColumns({f"{prefix}_{k}": F.when(F.col(key).isNotNull(), totals(v, key)).otherwise(F.lit(0).cast("long")) for k, v in _hit().items()})


def packed() -> Column:
    """A run's start, win and place as one number, whose sums over up to two million runs are three counts."""
    n = _hit()
    return n["starts"] + F.shiftleft(n["wins"], 21) + F.shiftleft(n["places"], 42)


def unpacked(total: Column, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{k}": F.shiftright(total, 21 * i).bitwiseAND(F.lit((1 << 21) - 1).cast("long")) for i, k in enumerate(HITS)}


def near(runs: Column, within: float) -> Column:
    """The packed hits of the collected runs whose distance is near today's."""
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.when(F.abs(r["distance_f"] - F.col("distance_f")) <= within, r["hit"]).otherwise(F.lit(0).cast("long")))


def rates(prefix: str) -> list[Column]:
    return [rate(F.col(f"{prefix}_wins"), F.col(f"{prefix}_starts")).alias(f"{prefix}_win_rate"), rate(F.col(f"{prefix}_places"), F.col(f"{prefix}_starts")).alias(f"{prefix}_place_rate")]


def by_course_and_distance(rows: DataFrame, within: float = 1.5) -> DataFrame:
    """Adds course_distance_starts, _wins and _places: the earlier runs on the course over about the distance."""
    runs = F.collect_list(F.struct("distance_f", F.col("__hit").alias("hit"))).over(before("course"))
    rows = rows.withColumn("__hit", packed()).withColumn("__near", near(runs, within))
    known = F.col("course").isNotNull()
    return rows.withColumns({k: F.when(known, c).otherwise(F.lit(0).cast("long")) for k, c in unpacked(F.col("__near"), "course_distance").items()}).drop("__near", "__hit")


def records(rows: DataFrame) -> DataFrame:
    """Adds the records by course, going, code and course with distance to dealt rows. Those by distance come from ``over_distance``."""
    for prefix, key in (("going", "going"), ("race_type", "flat_jumps"), ("course", "course")):  # the course last: the next step has its order
        rows = counted(rows, prefix, key)
    return by_course_and_distance(rows)


def over_distance(rows: DataFrame, within: float = 1.5) -> DataFrame:
    """Adds distance_starts, _wins and _places; it collects pasts, so it comes after all that sorts rows."""
    runs = F.collect_list(F.struct("distance_f", F.col("__hit").alias("hit"))).over(before())
    rows = rows.withColumn("__hit", packed()).withColumn("__near", near(runs, within))
    return rows.withColumns(unpacked(F.col("__near"), "distance")).drop("__near", "__hit")


def course_distance_going(runners: DataFrame) -> DataFrame:
    """Records by course, distance, both, going and code; those by going are null where today's is unknown and there are earlier runs."""
    rows = over_distance(records(dealt(runners, "runner_id", "horse_id", "course", "distance_f", "going", "flat_jumps", "finishing_position")).withColumn("n", runs_before()))
    there = (F.col("n") == 0) | F.col("going").isNotNull()
    rows = rows.withColumns({f"going_{k}": F.when(there, F.col(f"going_{k}")) for k in HITS})
    of = lambda p: [F.col(f"{p}_{k}") for k in HITS]
    return rows.select("runner_id", *of("course"), *rates("course"), *of("distance"), *rates("distance"), *of("course_distance"), *of("going"), *rates("going"), *of("race_type"), *rates("race_type"))


def slope(xs: list[Column]) -> Column:
    """Least-squares slope of the known ones among values given latest first, over their places from the oldest; null below two."""
    there = [x.isNotNull().cast("double") for x in xs]
    n = reduce(Column.__add__, there)
    above, place = F.lit(0.0), F.lit(0.0)
    for x, t in zip(xs, there, strict=True):
        above, place = above + F.coalesce(((n - 1) / 2 - place) * x.cast("double"), F.lit(0.0)), place + t
    return F.when(n >= 2, F.try_divide(above, n * (n * n - 1) / 12))


def offsets(column: str, k: int) -> dict[str, Column]:
    """Values of the latest k runs, latest first, to be taken ``along`` as ``__<column>_1`` and so on."""
    return {f"__{column}_{i}": F.lag(column, i).over(line()) for i in range(1, k + 1)}


def at(column: str, k: int) -> list[Column]:
    return [F.col(f"__{column}_{i}") for i in range(1, k + 1)]


def with_gaps(rows: DataFrame) -> DataFrame:
    """Adds the whole days from a run to the one before it."""
    return rows.withColumn("gap", F.floor((F.col("__at") - F.lag("__at").over(line())) / F.lit(DAY)))


def form_slopes(runners: DataFrame) -> DataFrame:
    rows = with_gaps(dealt(runners, "runner_id", "race_id", "horse_id", "official_rating"))
    rows = rows.withColumns(offsets("pct", 5) | offsets("official_rating", 5) | offsets("gap", 9))
    made = {"form_improvement_slope": slope(at("pct", 5)), "rating_slope": slope(at("official_rating", 5)), "avg_days_between_runs": mean(at("gap", 9))}
    return along(rows, made).select("runner_id", *made)


def mean(xs: list[Column]) -> Column:
    """Of the known ones."""
    return F.try_divide(reduce(Column.__add__, [F.coalesce(x.cast("double"), F.lit(0.0)) for x in xs]), reduce(Column.__add__, [x.isNotNull().cast("double") for x in xs]))


def known(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Adds ``__known_<column>_1`` and so on: the values of the latest k runs that have one, each from the run before it that has one."""
    there, name = F.col(column).isNotNull(), f"__known_{column}"
    back = line().rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{name}_1", F.last(column, ignorenulls=True).over(back))
    for i in range(2, k + 1):
        rows = rows.withColumn(f"{name}_{i}", F.last(F.when(there, F.col(f"{name}_{i - 1}")), ignorenulls=True).over(back))
    same = Window.partitionBy(*HORSE, "__at").orderBy("race_id", "runner_id")
    return rows.withColumns({f"{name}_{i}": F.first(f"{name}_{i}").over(same) for i in range(1, k + 1)})


def easier(rows: DataFrame) -> DataFrame:
    """Adds the mean percentile over the earlier runs in no better class than today's; it collects pasts, so it comes after all that sorts rows."""
    run = F.when(F.col("race_class").isNotNull() & F.col("pct").isNotNull(), F.struct("race_class", "pct"))
    rows = rows.withColumn("__runs", F.collect_list(run).over(before()))
    fits = lambda r: r["race_class"] <= F.col("race_class")
    total = F.aggregate("__runs", F.lit(0.0), lambda s, r: s + F.when(fits(r), r["pct"]).otherwise(F.lit(0.0)))
    n = F.aggregate("__runs", F.lit(0.0), lambda s, r: s + F.when(fits(r), F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.withColumn("class_adjusted_recent_form", F.try_divide(total, n)).drop("__runs")


def class_columns() -> list[Column]:
    """Of rows with ``counted`` and ``known`` classes."""
    c = at("known_race_class", 3)
    return [F.col("race_class").alias("current_class"), (c[0] - F.col("race_class")).alias("class_change_from_prev"), F.when(c[2].isNotNull(), mean(c)).alias("avg_class_last3"), F.when(F.col("race_class").isNotNull(), rate(F.col("class_wins"), F.col("class_starts"))).alias("class_success_rate"), F.when(F.col("race_class").isNotNull(), rate(F.col("class_places"), F.col("class_starts"))).alias("class_place_rate"), F.col("class_adjusted_recent_form")]


def class_record(runners: DataFrame) -> DataFrame:
    rows = counted(dealt(runners, "runner_id", "race_id", "horse_id", "race_class", "finishing_position"), "class", "race_class")
    return easier(known(rows, "race_class", 3)).select("runner_id", *class_columns())


def goings(rows: DataFrame) -> DataFrame:
    """Adds going_similarity_score and going_change_flag; weights go by place among the runs of known going. It collects pasts, so it comes after all that sorts rows."""
    rows = rows.withColumn("__soft", softness(F.col("going")))
    rows = along(rows, {"__softs": F.collect_list(F.when(F.col("going").isNotNull(), F.col("__soft"))).over(line().rowsBetween(Window.unboundedPreceding, -1))})
    n, last, own = F.size("__softs"), F.try_element_at("__softs", F.lit(-1)), F.col("__soft")
    alike = F.aggregate("__softs", F.lit(0.0), lambda total, s: total * F.lit(FADE) + (F.lit(1.0) - F.abs(s - own)))
    weights = (F.lit(1.0) - F.pow(F.lit(FADE), n)) / F.lit(1 - FADE)
    made = {"going_similarity_score": F.when(n > 0, alike / weights), "going_change_flag": F.when(last.isNotNull(), (F.abs(own - last) > 0.25).cast("int"))}
    return rows.withColumns(made).drop("__softs", "__soft")


def going_similarity(runners: DataFrame) -> DataFrame:
    return goings(dealt(runners, "runner_id", "race_id", "horse_id", "going")).select("runner_id", "going_similarity_score", "going_change_flag")


def faded(rows: DataFrame) -> DataFrame:
    """Adds ``__weighted``: the mean percentile of earlier runs, each weighing half of that three runs later. It collects pasts, so it comes after all that sorts rows."""
    rows = along(rows, {"__pcts": F.collect_list(F.struct("pct")).over(line().rowsBetween(Window.unboundedPreceding, -1))})
    fold = lambda of: F.aggregate("__pcts", F.lit(0.0), lambda total, r: total * F.lit(FADE) + of(r["pct"]))
    return rows.withColumn("__weighted", F.try_divide(fold(lambda x: F.coalesce(x, F.lit(0.0))), fold(lambda x: x.isNotNull().cast("double")))).drop("__pcts")


def gear_columns() -> list[Column]:
    """Of rows with n, ``counted`` headgears and trainers, and the trainer of the latest run: runs in today's headgear, and for today's trainer; null without a headgear, or without a trainer."""
    here, own = F.col("headgear").isNotNull() & (F.col("n") > 0), F.col("for_trainer_starts")
    trained = lambda c: F.when(F.col("trainer_id").isNotNull(), c)
    return [
        F.when(here, F.col("geared_starts")).alias("prior_headgear_runs"), F.when(here, rate(F.col("geared_wins"), F.col("geared_starts"))).alias("prior_headgear_win_rate"),
        trained(own).alias("runs_for_current_trainer"), trained((own == 0).cast("int")).alias("first_run_for_trainer_flag"), trained((own == 1).cast("int")).alias("second_run_for_trainer_flag"),
        trained(F.coalesce((F.col("__trainer_id_1") != F.col("trainer_id")).cast("int"), F.lit(0))).alias("trainer_change_flag"),
    ]


def headgear_trainer(runners: DataFrame) -> DataFrame:
    rows = counted(counted(dealt(runners, "runner_id", "race_id", "horse_id", "headgear", "trainer_id", "finishing_position"), "geared", "headgear"), "for_trainer", "trainer_id")
    return along(rows, offsets("trainer_id", 1)).withColumn("n", runs_before()).select("runner_id", *gear_columns())


def pace_columns(p3: Column, p2: Column, p1: Column, pf: Column) -> dict[str, Column]:
    """Changes of place within earlier runs, of percentiles at three, two and one furlongs out and at the finish; shares go over the runs where they are known."""
    b, turn, late = before(), p1 - p3, pf - p1
    part = lambda x, test: rate(F.sum(hits(test)).over(b), F.count(x).over(b))
    return {
        "avg_early_position_percentile": F.avg(p3).over(b), "early_position_consistency": F.when(F.count(p3).over(b) >= 2, F.stddev_pop(p3).over(b)),
        "prob_competing_for_lead": part(p3, p3 >= 0.85), "slow_start_frequency": part(p3, p3 <= 0.3), "fast_start_frequency": part(p3, p3 >= 0.7),
        "transition_change_3f_to_2f": F.avg(p2 - p3).over(b), "transition_change_2f_to_1f": F.avg(p1 - p2).over(b), "avg_transition_gain": F.avg(turn).over(b),
        "pct_gaining_in_transition": part(turn, turn > 0.02), "pct_losing_in_transition": part(turn, turn < -0.02),
        "late_position_change_1f_to_finish": F.avg(late).over(b), "late_fade_frequency": part(late, late < -0.02), "late_gain_frequency": part(late, late > 0.02),
    }


def pace(runners: DataFrame) -> DataFrame:
    """``pace_columns`` of runners whose in-running positions are ``position_3f``, ``position_2f`` and ``position_1f``."""
    share = lambda c: finishing_percentile(F.col(c), F.col("field_size"))
    rows = dealt(runners, "runner_id", "horse_id", *[share(f"position_{k}f").alias(f"p{k}") for k in (3, 2, 1)])
    made = pace_columns(F.col("p3"), F.col("p2"), F.col("p1"), F.col("pct"))
    return rows.select("runner_id", (runs_before() >= 2).cast("int").alias("pace_features_available"), *[c.alias(k) for k, c in made.items()])


def with_evidence_counts(rows: DataFrame, sectional: Column | None = None) -> DataFrame:
    """Adds to dealt rows what ``history.evidence_score`` needs: n, year, near and, of the latest five runs, how many have in-running places, a comment, a rating."""
    rows = by_course_and_distance(rows).withColumnRenamed("course_distance_starts", "near").drop("course_distance_wins", "course_distance_places")
    return evidence_counts(rows, sectional)


def evidence_counts(rows: DataFrame, sectional: Column | None = None) -> DataFrame:
    """The same without ``near``, in windows of one order."""
    five = latest(5)
    known_places = F.lit(1) if sectional is None else F.when(sectional, 1)
    rows = along(rows, {"with_places": F.count(known_places).over(five), "with_comment": F.count("pace_comment").over(five), "with_rating": F.count("official_rating").over(five)})
    return rows.withColumns({"n": runs_before(), "year": runs_before() - F.count(F.lit(1)).over(before(days=365))})
