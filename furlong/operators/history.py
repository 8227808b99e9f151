"""Features from a horse's own earlier runs.

A runner sees the runs of its horse that are strictly earlier; races of the same time
don't see each other.  One window per horse, ordered by time and cut one microsecond before
the runner's own, carries the runs along as an array (a career is short), so no runner is
joined with its history and every feature is an expression over the array, latest run first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.functions.scalars import finishing_percentile, rate, softness

Run = Callable[[Column], Column]
_RUN = ["race_ts", "race_id", "course", "distance_f", "going", "race_class", "flat_jumps", "finishing_position", "field_size", "official_rating", "headgear", "trainer_id", "sp_decimal", "pct", "pace_comment"]


def with_history(runners: DataFrame, more: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """Adds ``past``, the earlier runs of the horse as structs, latest first (ties by race), and ``n``, how many there are.

    ``more`` names further columns of a run; ``only`` names all that are needed, and nothing else is carried along. Runs come in no order if
    their time isn't among them.
    """
    when = F.unix_micros("race_ts")
    nameless = F.when(F.col("horse_id").isNull(), F.col("runner_id"))  # such runs have no history, and aren't one group
    before = Window.partitionBy("horse_id", nameless).orderBy(when).rangeBetween(Window.unboundedPreceding, -1)
    rows = runners.withColumn("pct", finishing_percentile(F.col("finishing_position"), F.col("field_size")))
    if "pace_comment" not in rows.columns:
        rows = rows.withColumn("pace_comment", F.lit(None).cast("string"))
    in_order = only is None or "race_ts" in only
    fields = list(dict.fromkeys((_RUN if only is None else ["race_ts", "race_id"] * in_order + only) + list(more)))
    past = F.collect_list(F.struct(*fields)).over(before)
    return rows.withColumn("past", F.sort_array(past, asc=False) if in_order else past).withColumn("n", F.size("past").cast("long"))


def latest(k: int) -> Column:
    return F.slice("past", 1, k)


def count_of(runs: Column, test: Run) -> Column:
    return F.size(F.filter(runs, lambda r: F.coalesce(test(r), F.lit(False)))).cast("long")


def won(r: Column) -> Column:
    return r["finishing_position"] == 1


def placed(r: Column) -> Column:
    return r["finishing_position"] <= 3


def values(runs: Column, of: Run) -> Column:
    """The values that aren't null, in the order of the runs."""
    return F.filter(F.transform(runs, of), lambda x: x.isNotNull())


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs).cast("double"))


def deviation(xs: Column) -> Column:
    """Population standard deviation of two values or more."""
    m = mean(xs)
    return F.when(F.size(xs) >= 2, F.sqrt(mean(F.transform(xs, lambda x: (x - m) * (x - m)))))


def slope(xs: Column) -> Column:
    """Least-squares slope of values given latest first, over their places from the oldest; null below two."""
    n = F.size(xs).cast("double")
    middle = (n - 1) / 2
    above = total(F.transform(xs, lambda x, i: (n - 1 - i - middle) * x.cast("double")))
    return F.when(F.size(xs) >= 2, F.try_divide(above, n * (n * n - 1) / 12))


def record(prefix: str, test: Run) -> list[Column]:
    """Starts, wins, places and their raw rates over the runs that pass a test; rates are null without a start."""
    runs = F.filter("past", lambda r: F.coalesce(test(r), F.lit(False)))
    starts, wins, places = F.size(runs).cast("long"), count_of(runs, won), count_of(runs, placed)
    return [starts.alias(f"{prefix}_starts"), wins.alias(f"{prefix}_wins"), places.alias(f"{prefix}_places"), rate(wins, starts).alias(f"{prefix}_win_rate"), rate(places, starts).alias(f"{prefix}_place_rate")]


def named(columns: list[Column], prefix: str) -> list[tuple[str, Column]]:
    """A record's columns with their names."""
    return list(zip([f"{prefix}_{x}" for x in ("starts", "wins", "places", "win_rate", "place_rate")], columns, strict=True))


def course_distance_going(history: DataFrame) -> DataFrame:
    """Records by course, distance, both, going and code; those by going are null where today's is unknown and there are earlier runs."""
    course = lambda r: r["course"] == F.col("course")
    near = lambda r: F.abs(r["distance_f"] - F.col("distance_f")) <= 1.5
    return history.select(
        "runner_id",
        *record("course", course),
        *record("distance", near),
        *record("course_distance", lambda r: course(r) & near(r))[:3],
        *[F.when((F.col("n") == 0) | F.col("going").isNotNull(), c).alias(name) for name, c in named(record("going", lambda r: r["going"] == F.col("going")), "going")],
        *record("race_type", lambda r: r["flat_jumps"] == F.col("flat_jumps")),
    )


LATEST_RUNS = 10
#: Runs whose weights are added up on one scale; a double holds 2**(CHUNK / 3) with room to spare.
CHUNK = 1500
THIRD = 1 / 3


def latest_runs(runners: DataFrame, k: int = LATEST_RUNS, parts: int | None = None) -> DataFrame:
    """runner_id, n (how many earlier runs the horse has), position_1 to position_k and pct_1 to pct_k (of its latest runs, latest first), weighted (the mean of
    its pct, each weighing half of that three runs later).

    All are running totals and offsets, so nothing grows with the length of a career. Weights are powers of two by a run's place in the
    career, counted from the start of its stretch of ``CHUNK`` runs, and of another that begins half a stretch earlier: of the two the one that
    reaches further back counts, and what it leaves out weighs less than a double can tell, unless half a stretch has no pct at all; then the
    mean stays what it was. Runs of one time don't see each other: what the first of them sees holds for all.
    """
    nameless = F.when(F.col("horse_id").isNull(), F.col("runner_id")).alias("__apart")
    pct = finishing_percentile(F.col("finishing_position"), F.col("field_size")).alias("pct")
    rows = runners.select("runner_id", "horse_id", nameless, F.unix_micros("race_ts").alias("__at"), "race_id", "finishing_position", pct)
    if parts:
        rows = rows.repartition(parts, "horse_id", "__apart")
    order = ["__at", "race_id", "runner_id"]
    horse = Window.partitionBy("horse_id", "__apart").orderBy(*order)
    rows = rows.withColumn("__n", (F.row_number().over(horse) - 1).cast("long"))
    ratios = []
    for shift in (0, CHUNK // 2):
        at = F.col("__n") + shift
        weight = F.when(F.col("pct").isNotNull(), F.pow(F.lit(2.0), (at % CHUNK) * F.lit(THIRD)))
        stretch = Window.partitionBy("horse_id", "__apart", F.floor(at / CHUNK)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumns({f"__up{shift}": F.sum(weight * F.col("pct")).over(stretch), f"__down{shift}": F.sum(weight).over(stretch)})
        ratios.append((at % CHUNK, F.try_divide(F.col(f"__up{shift}"), F.col(f"__down{shift}"))))
    (into, first), (into_other, other) = ratios
    rows = rows.withColumn("__own", F.when((F.col("__n") < CHUNK) | (into >= into_other), first).otherwise(other))
    rows = rows.withColumn("__weighted", F.coalesce("__own", F.last("__own", ignorenulls=True).over(horse.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumns({f"__{c}_{i}": F.lag(v, i).over(horse) for c, v in (("position", "finishing_position"), ("pct", "pct")) for i in range(1, k + 1)})
    names = [f"__{c}_{i}" for c in ("position", "pct") for i in range(1, k + 1)]
    same = Window.partitionBy("horse_id", "__apart", "__at").orderBy("race_id", "runner_id")
    return rows.select("runner_id", *[F.first(c).over(same).alias(c[2:]) for c in ("__n", *names, "__weighted")])


def recent_form(runners: DataFrame, parts: int | None = None) -> DataFrame:
    """``current_form`` of runners, from offsets and running totals in place of a whole past; dealt out by horse into ``parts`` if it is given."""
    n, none = F.col("n"), F.lit(0).cast("long")
    of = lambda c, k: [F.col(f"{c}_{i}").cast("double") for i in range(1, k + 1)]

    def some(c: str, k: int) -> tuple[Column, Column]:
        """The sum and the number of the latest values."""
        return sum((F.coalesce(x, F.lit(0.0)) for x in of(c, k)), F.lit(0.0)), sum((x.isNotNull().cast("double") for x in of(c, k)), F.lit(0.0))

    average = lambda c, k: F.try_divide(*some(c, k))
    middle = average("pct", 5)
    spread = sum((F.coalesce((x - middle) * (x - middle), F.lit(0.0)) for x in of("pct", 5)), F.lit(0.0))
    hit = lambda k, most: F.when(n > 0, sum((F.coalesce((x <= most).cast("long"), none) for x in of("position", k)), none))
    return latest_runs(runners, parts=parts).select(
        "runner_id",
        n.alias("career_runs_to_date"),
        (n == 0).cast("int").alias("first_time_out_flag"),
        F.col("position_1").alias("form_last_run_position"),
        average("position", 3).alias("form_avg_position_last3"),
        average("position", 5).alias("form_avg_position_last5"),
        F.col("weighted").alias("form_recency_weighted_percentile"),
        average("pct", 3).alias("form_or_relative_recent"),
        F.when(some("pct", 5)[1] >= 2, F.sqrt(F.try_divide(spread, some("pct", 5)[1]))).alias("form_consistency"),
        *[hit(k, 1).alias(f"form_wins_last{k}") for k in (3, 5, 10)],
        *[hit(k, 3).alias(f"form_places_last{k}") for k in (3, 5, 10)],
    )


def records(runners: DataFrame) -> DataFrame:
    """``course_distance_going`` of runners: by course, going and code from running totals, by distance from the distances and places of earlier runs alone."""
    nameless = F.when(F.col("horse_id").isNull(), F.col("runner_id"))
    when, none = F.unix_micros("race_ts"), F.lit(0).cast("long")
    rows = runners.select("runner_id", "horse_id", nameless.alias("__apart"), "race_ts", "course", "distance_f", "going", "flat_jumps", "finishing_position").repartition("horse_id", "__apart")
    before = lambda *more: Window.partitionBy("horse_id", "__apart", *more).orderBy(when).rangeBetween(Window.unboundedPreceding, -1)
    hit = {"starts": F.lit(1).cast("long"), "wins": F.coalesce((F.col("finishing_position") == 1).cast("long"), none), "places": F.coalesce((F.col("finishing_position") <= 3).cast("long"), none)}
    rows = rows.withColumn("past", F.collect_list(F.struct("distance_f", "course", "finishing_position")).over(before())).withColumn("n", F.size("past"))
    for prefix, column in (("course", "course"), ("going", "going"), ("race_type", "flat_jumps")):  # nothing equals an unknown one
        rows = rows.withColumns({f"{prefix}_{k}": F.when(F.col(column).isNotNull(), F.coalesce(F.sum(v).over(before(column)), none)).otherwise(none) for k, v in hit.items()})
    near = lambda r: F.abs(r["distance_f"] - F.col("distance_f")) <= 1.5
    there = (F.col("n") == 0) | F.col("going").isNotNull()
    rates = lambda p: [rate(F.col(f"{p}_wins"), F.col(f"{p}_starts")).alias(f"{p}_win_rate"), rate(F.col(f"{p}_places"), F.col(f"{p}_starts")).alias(f"{p}_place_rate")]
    counted = lambda p: [F.col(f"{p}_{k}") for k in hit]
    out = rows.withColumns({f"going_{k}": F.when(there, F.col(f"going_{k}")) for k in hit})
    return out.select("runner_id", *counted("course"), *rates("course"), *record("distance", near), *record("course_distance", lambda r: (r["course"] == F.col("course")) & near(r))[:3], *counted("going"), *rates("going"), *counted("race_type"), *rates("race_type"))


def current_form(history: DataFrame) -> DataFrame:
    position = lambda r: r["finishing_position"]
    weights = F.transform("past", lambda r, i: F.when(r["pct"].isNotNull(), F.exp(-i * F.lit(0.6931471805599453) / 3)))
    weighted = F.zip_with("past", weights, lambda r, w: r["pct"] * w)
    present = lambda xs: F.filter(xs, lambda x: x.isNotNull())
    return history.select(
        "runner_id",
        F.col("n").alias("career_runs_to_date"),
        (F.col("n") == 0).cast("int").alias("first_time_out_flag"),
        F.try_element_at("past", F.lit(1))["finishing_position"].alias("form_last_run_position"),
        mean(values(latest(3), position)).alias("form_avg_position_last3"),
        mean(values(latest(5), position)).alias("form_avg_position_last5"),
        F.try_divide(total(present(weighted)), total(present(weights))).alias("form_recency_weighted_percentile"),
        mean(values(latest(3), lambda r: r["pct"])).alias("form_or_relative_recent"),
        deviation(values(latest(5), lambda r: r["pct"])).alias("form_consistency"),
        *[F.when(F.col("n") > 0, count_of(latest(k), won)).alias(f"form_wins_last{k}") for k in (3, 5, 10)],
        *[F.when(F.col("n") > 0, count_of(latest(k), placed)).alias(f"form_places_last{k}") for k in (3, 5, 10)],
    )


def form_slopes(history: DataFrame) -> DataFrame:
    days = F.transform(latest(10), lambda r: F.unix_micros(r["race_ts"]))
    gaps = F.transform(F.sequence(F.lit(1), F.size(days) - 1), lambda i: F.floor((F.element_at(days, i) - F.element_at(days, i + 1)) / F.lit(86_400_000_000)))
    return history.select(
        "runner_id",
        slope(values(latest(5), lambda r: r["pct"])).alias("form_improvement_slope"),
        slope(values(latest(5), lambda r: r["official_rating"])).alias("rating_slope"),
        F.when(F.col("n") >= 2, mean(gaps)).alias("avg_days_between_runs"),
    )


def class_record(history: DataFrame) -> DataFrame:
    classes = values(F.col("past"), lambda r: r["race_class"])
    same = F.filter("past", lambda r: r["race_class"] == F.col("race_class"))
    easier = F.filter("past", lambda r: r["race_class"] <= F.col("race_class"))
    return history.select(
        "runner_id",
        F.col("race_class").alias("current_class"),
        (F.try_element_at(classes, F.lit(1)) - F.col("race_class")).alias("class_change_from_prev"),
        F.when(F.size(classes) >= 3, mean(F.slice(classes, 1, 3))).alias("avg_class_last3"),
        rate(count_of(same, won), F.size(same)).alias("class_success_rate"),
        rate(count_of(same, placed), F.size(same)).alias("class_place_rate"),
        mean(values(easier, lambda r: r["pct"])).alias("class_adjusted_recent_form"),
    )


def going_similarity(history: DataFrame) -> DataFrame:
    """Weights go by place among the runs of known going."""
    own = softness(F.col("going"))
    goings = values(F.col("past"), lambda r: r["going"])
    weights = F.transform(goings, lambda g, i: F.exp(-i * F.lit(0.6931471805599453) / 3))
    alike = F.zip_with(goings, weights, lambda g, w: (1 - F.abs(softness(g) - own)) * w)
    last = F.try_element_at(goings, F.lit(1))
    return history.select("runner_id", F.try_divide(total(alike), total(weights)).alias("going_similarity_score"), F.when(last.isNotNull(), (F.abs(own - softness(last)) > 0.25).cast("int")).alias("going_change_flag"))


def rating_history(history: DataFrame) -> DataFrame:
    marks = values(F.col("past"), lambda r: r["official_rating"])
    own = F.col("official_rating")
    best = F.array_max(F.slice(marks, 1, 5))
    last_win = F.try_element_at(F.filter("past", won), F.lit(1))["official_rating"]
    return history.select(
        "runner_id",
        (own - F.try_element_at(marks, F.lit(1))).alias("mark_change_since_last_run"),
        (own - F.try_element_at(marks, F.lit(3))).alias("mark_change_last3"),
        (own - last_win).alias("or_vs_last_winning_or"),
        (own - best).alias("or_vs_best_recent_mark"),
        (own - best <= -3).cast("int").alias("well_in_flag"),
    )


def headgear_trainer(history: DataFrame) -> DataFrame:
    """Runs in today's headgear, and runs for today's trainer; null without a headgear, or without a trainer."""
    geared = F.filter("past", lambda r: r["headgear"] == F.col("headgear"))
    own = F.filter("past", lambda r: r["trainer_id"] == F.col("trainer_id"))
    here = F.col("headgear").isNotNull() & (F.col("n") > 0)
    trained = lambda c: F.when(F.col("trainer_id").isNotNull(), c)
    return history.select(
        "runner_id",
        F.when(here, F.size(geared).cast("long")).alias("prior_headgear_runs"),
        F.when(here, rate(count_of(geared, won), F.size(geared))).alias("prior_headgear_win_rate"),
        trained(F.size(own).cast("long")).alias("runs_for_current_trainer"),
        trained((F.size(own) == 0).cast("int")).alias("first_run_for_trainer_flag"),
        trained((F.size(own) == 1).cast("int")).alias("second_run_for_trainer_flag"),
        trained(F.coalesce((F.try_element_at("past", F.lit(1))["trainer_id"] != F.col("trainer_id")).cast("int"), F.lit(0))).alias("trainer_change_flag"),
    )


def age_experience(history: DataFrame) -> DataFrame:
    n = F.col("n")
    year = count_of(F.col("past"), lambda r: r["race_ts"] >= F.col("race_ts") - F.expr("interval 365 days"))
    flag = lambda c: c.cast("int")
    return history.select(
        "runner_id",
        n.alias("career_starts_to_date"),
        year.alias("starts_last_12_months"),
        flag(n == 0).alias("experience_band_unraced"),
        flag(n.between(1, 3)).alias("experience_band_lightly_raced"),
        flag(n.between(4, 9)).alias("experience_band_moderate"),
        flag(n >= 10).alias("experience_band_exposed"),
        flag(n <= 3).alias("lightly_raced_flag"),
        F.col("age").alias("horse_age"),
        F.when(F.col("flat_jumps") == "JUMPS", F.col("age")).otherwise(0).alias("age_x_jumps"),
        (F.col("age") * F.col("distance_f")).alias("age_x_distance"),
    )


def pace(runners: DataFrame) -> DataFrame:
    """Changes of place within earlier runs; ``position_3f``, ``position_2f`` and ``position_1f`` are in-running positions, shares go over the runs where they are known."""
    share = lambda c: finishing_percentile(F.col(c), F.col("field_size"))
    rows = runners.select("runner_id", "horse_id", "race_ts", "race_id", share("position_3f").alias("p3"), share("position_2f").alias("p2"), share("position_1f").alias("p1"), share("finishing_position").alias("pf"))
    before = Window.partitionBy("horse_id").orderBy(F.unix_micros("race_ts")).rangeBetween(Window.unboundedPreceding, -1)
    h = rows.withColumn("past", F.collect_list(F.struct("p3", "p2", "p1", "pf")).over(before))
    p3, turn, late = values(F.col("past"), lambda r: r["p3"]), values(F.col("past"), lambda r: r["p1"] - r["p3"]), values(F.col("past"), lambda r: r["pf"] - r["p1"])
    part = lambda xs, test: F.try_divide(F.size(F.filter(xs, test)).cast("double"), F.size(xs).cast("double"))
    return h.select(
        "runner_id",
        (F.size("past") >= 2).cast("int").alias("pace_features_available"),
        mean(p3).alias("avg_early_position_percentile"),
        deviation(p3).alias("early_position_consistency"),
        part(p3, lambda x: x >= 0.85).alias("prob_competing_for_lead"),
        part(p3, lambda x: x <= 0.3).alias("slow_start_frequency"),
        part(p3, lambda x: x >= 0.7).alias("fast_start_frequency"),
        mean(values(F.col("past"), lambda r: r["p2"] - r["p3"])).alias("transition_change_3f_to_2f"),
        mean(values(F.col("past"), lambda r: r["p1"] - r["p2"])).alias("transition_change_2f_to_1f"),
        mean(turn).alias("avg_transition_gain"),
        part(turn, lambda x: x > 0.02).alias("pct_gaining_in_transition"),
        part(turn, lambda x: x < -0.02).alias("pct_losing_in_transition"),
        mean(late).alias("late_position_change_1f_to_finish"),
        part(late, lambda x: x < -0.02).alias("late_fade_frequency"),
        part(late, lambda x: x > 0.02).alias("late_gain_frequency"),
    )


#: Weights of the evidence sub-scores (fixed values).
EVIDENCE = {"career_starts": 0.30, "recent_starts": 0.15, "course_distance_evidence": 0.15, "sectional_availability": 0.10, "race_comment_availability": 0.05, "rating_history": 0.15, "trainer_jockey_data": 0.10}


def evidence_columns(trainer_runs: str = "trainer_runs_30d", jockey_runs: str = "jockey_runs_30d") -> dict[str, Column]:
    """How much is known of a runner: seven sub-scores and their weighted score, with a label cut at 20, 40, 65 and 85 of the unrounded score.

    The rows have the counts of ``careers.with_evidence_counts``.
    """
    n, year, cd = F.col("n"), F.col("year"), F.col("near")
    share = lambda known: F.coalesce(rate(F.col(known), F.least(n, F.lit(5))), F.lit(0.0))
    enough = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)) / 5, F.lit(1.0))
    sub = {
        "career_starts": F.least(n, F.lit(15)) / 15,
        "recent_starts": F.least(year, F.lit(6)) / 6,
        "course_distance_evidence": F.least(cd, F.lit(3)) / 3,
        "sectional_availability": share("with_places"),
        "race_comment_availability": share("with_comment"),
        "rating_history": share("with_rating"),
        "trainer_jockey_data": F.least(enough(trainer_runs), enough(jockey_runs)),
    }
    score = sum((F.lit(w) * sub[k] for k, w in EVIDENCE.items()), F.lit(0.0)) * 100
    cut = F.round(score, 9)  # sums of fractions that should be whole are
    label = F.when(cut < 20, "VERY_LOW").when(cut < 40, "LOW").when(cut < 65, "MODERATE").when(cut < 85, "HIGH").otherwise("VERY_HIGH")
    return {"evidence_density_score_100": F.round(cut, 2), "evidence_density_score": F.round(cut / 100, 4), "evidence_density_label": label} | {f"evidence_subscore_{k}": F.round(v, 4) for k, v in sub.items()}


def evidence(counted: DataFrame) -> DataFrame:
    return counted.select("runner_id", *[c.alias(k) for k, c in evidence_columns().items()])


def leakage(history: DataFrame) -> DataFrame:
    """Per course: runners, runs that they see, and those of them that aren't strictly earlier (none, or the audit fails)."""
    late = count_of(F.col("past"), lambda r: (r["race_ts"] >= F.col("race_ts")) | (r["race_id"] == F.col("race_id")))
    out = history.groupBy("course").agg(F.count(F.lit(1)).alias("runners"), F.sum("n").alias("visible_runs"), F.sum(late).alias("violations"))
    return out.withColumn("status", F.when(F.col("violations") > 0, "FAILED").otherwise("PASSED"))
