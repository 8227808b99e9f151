"""Queries of pages, reports and streams' windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.functions import betting as b
from furlong.operators import evaluation, field, views
from furlong.plans.betting import _cases
from furlong.plans.registry import _EDGES, _PLACE_CTES, _WIN, RACES_SQL, RUNNERS_SQL, _valued, query, tidy
from furlong.sources import racing
from furlong.streaming.odds import session_windows, sliding_windows

_DIM_SQL = {
    "code": "flat_jumps", "class": "'Class ' || race_class", "field_size": _cases("field_size", b.FIELD_BANDS, "<="), "odds": _cases("sp_decimal", b.ODDS_BANDS), "evidence": _cases("model_score", b.EVIDENCE_BANDS),
    "confidence": _cases("model_score", b.CONFIDENCE_BANDS), "course": "course", "going": "going", "distance": _cases("distance_f", b.DISTANCE_BANDS), "age": _cases("age", b.AGE_BANDS, "<="),
}


@query(f"with {RUNNERS_SQL}, {_EDGES}, d as (" + " union all ".join(f"select '{k}' as dimension, {v} as label, won, p_win, sp_decimal from edged" for k, v in _DIM_SQL.items()) + """)
select dimension, label, count(*) as n, sum(won)::bigint as wins, round(avg(won), 9) as strike_rate, round(sum(p_win), 4) as expected, round(avg((p_win - won) ** 2), 9) as brier,
  round(100 * (sum(won * sp_decimal) filter (sp_decimal is not null) - count(sp_decimal)) / count(sp_decimal), 6) as roi_pct from d where label is not null group by 1, 2""")
def dashboard_breakdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten dimensions in one grouping; the model's score stands for evidence and confidence."""
    rows = _valued(spark, sf_dir).withColumn("evidence", F.col("model_score")).withColumn("confidence", F.col("model_score"))
    out = views.breakdowns(rows)
    return tidy(out.withColumn("expected", F.round("expected", 4)).withColumn("roi_pct", F.round("roi_pct", 6)))


_BEST = ("with {runners}, {win}, {places}, t as (select *, case when field_size >= 12 then 7 when field_size >= 8 then 3 else 2 end as places from s6 where sp_decimal is not null),"
         " q as (select *, case places when 2 then q2 when 3 then greatest(q2, q3) else greatest(q2, q3, q4, q5, q6) end as place_p, case places when 7 then 6 else places end as band, 1 + (sp_decimal - 1) * 0.2::double as place_odds from t),"
         " v as (select *, p_win - 1 / sp_decimal as win_edge, place_p - 1 / place_odds as place_edge from q) ").format(runners=RUNNERS_SQL, win=_WIN, places=_PLACE_CTES)  # fmt: skip


def _scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("field_size")
    rows = field.place_probabilities(racing.runners(spark, sf_dir)).withColumn("places", F.when(n >= 12, 7).when(n >= 8, 3).otherwise(2)).withColumn("fraction", F.lit(0.2))
    return views.scanner(rows)


@query(_BEST + "select runner_id, band, round(place_p, 9) as place_probability, round(win_edge, 9) as win_edge, round(place_edge, 9) as place_edge, round((win_edge + place_edge) / 2, 9) as each_way from v")
def value_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win, place and each-way value of every priced runner."""
    return tidy(_scanner(spark, sf_dir).select("runner_id", "band", "place_probability", "win_edge", "place_edge", "each_way"))


@query(_BEST + "select runner_id, round(win_edge, 9) as win_edge, round(place_edge, 9) as place_edge from v where sp_decimal >= 3 and sp_decimal <= 9 and win_edge >= -0.05::double and model_score >= 0.4::double and flat_jumps = 'FLAT'")
def scanner_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scanner's rows within limits of odds, edge, confidence and code."""
    rows = _scanner(spark, sf_dir).withColumn("confidence", F.col("model_score"))
    return tidy(views.scanned(rows, least_odds=3, most_odds=9, win_edge=-0.05, confidence=0.4, code="FLAT").select("runner_id", "win_edge", "place_edge"))


@query(f"with {RUNNERS_SQL} select runner_id, race_id, sp_decimal from runners where not non_runner and coalesce(sp_decimal, 0) >= 2 and coalesce(sp_decimal, 1e9::double) <= 8 and field_size >= 4")
def slip_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.slip_candidates(racing.runners(spark, sf_dir), 2, 8, 4).select("runner_id", "race_id", "sp_decimal"))


@query(f"with {RUNNERS_SQL}, {_EDGES} select race_id, arg_max(runner_id, (edge, -draw)) as runner_id, max(edge) as edge from edged where edge is not null group by 1")
def best_value_of_race(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.best_of_race(_valued(spark, sf_dir), "edge"))


@query(f"with {RUNNERS_SQL} select a.runner_id as runner_id, any_value(a.weight_lbs) as weight_lbs, coalesce(string_agg(b.weight_lbs::varchar, ',' order by b.runner_id), '') as others from runners a left join runners b on a.race_id = b.race_id and a.runner_id <> b.runner_id group by 1")
def sibling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runner's weight and those of the rest of its field."""
    out = views.siblings(racing.runners(spark, sf_dir), "weight_lbs")
    return tidy(out.select("runner_id", "weight_lbs", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others")))


@query(f"with {RUNNERS_SQL}, n as (select race_id as rid, count(*) as declared, count(*) filter (not non_runner) as active from runners group by 1) select race_id, course, strftime(race_ts, '%Y-%m-%d') as day, coalesce(active, 0) as active, coalesce(declared, 0) as declared from races left join n on rid = race_id")
def race_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races with their active and declared runners."""
    out = views.races_of_day(racing.races(spark, sf_dir), racing.runners(spark, sf_dir))
    return out.select("race_id", "course", F.date_format("race_ts", "yyyy-MM-dd").alias("day"), "active", "declared")


@query(f"""with {RUNNERS_SQL}, {_EDGES} select runner_id, strftime(race_ts, '%Y-%m-%d') as day, p_win, won::bigint as won, round(edge, 9) as edge, row_number() over (partition by race_id order by p_win desc, draw) as pick from edged where year(race_ts) = 1996""")
def backtest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resulted races of a year, each runner with its probability, result and place in the model's order."""
    rows = _valued(spark, sf_dir).filter(F.year("race_ts") == 1996)
    pick = F.row_number().over(Window.partitionBy("race_id").orderBy(F.desc("p_win"), "draw"))
    return tidy(rows.select("runner_id", F.date_format("race_ts", "yyyy-MM-dd").alias("day"), "p_win", "won", "edge", pick.alias("pick")))


@query(f"with {RACES_SQL} select race_id, course, epoch_us(race_ts) as race_us from races order by race_ts desc, race_id limit 100")
def latest_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explorer's list: the latest hundred races."""
    return racing.races(spark, sf_dir).orderBy(F.desc("race_ts"), "race_id").limit(100).select("race_id", "course", F.unix_micros("race_ts").alias("race_us"))


@query(f"""with {RUNNERS_SQL} select runner_id, row_number() over (partition by race_id order by sp_decimal nulls last, runner_id) as by_price, row_number() over (partition by race_id order by sp_decimal desc nulls first, runner_id) as by_price_desc from runners""")
def runner_table_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of runners in the table sorted by price either way; missing prices come last upwards and first downwards."""
    race = Window.partitionBy("race_id")
    up, down = race.orderBy(F.col("sp_decimal").asc_nulls_last(), "runner_id"), race.orderBy(F.col("sp_decimal").desc_nulls_first(), "runner_id")
    return tidy(racing.runners(spark, sf_dir).select("runner_id", F.row_number().over(up).alias("by_price"), F.row_number().over(down).alias("by_price_desc")))


@query(f"""with {RUNNERS_SQL}, c as (select case when sp_decimal is null then 'missing' when sp_decimal <= 2 then '<=2' when sp_decimal <= 4 then '2-4' when sp_decimal <= 6 then '4-6' when sp_decimal <= 8 then '6-8' when sp_decimal <= 10 then '8-10' else '>10' end as bucket, count(*) as n from runners group by 1)
select bucket, n, round(100.0::double * n / sum(n) over (), 9) as share_pct from c""")
def odds_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(views.odds_distribution(racing.runners(spark, sf_dir)))


@query(f"""with {RUNNERS_SQL}, f as (select course, race_id, count(*) as k from runners group by 1, 2)
select course, count(*) as races, round(avg(k), 9) as mean_field, round(median(k), 9) as median_field, min(k) as smallest, max(k) as largest, count(*) < 10 as thin from f group by 1""")
def field_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races and sizes of fields by course, and courses with few races."""
    fields = racing.runners(spark, sf_dir).groupBy("course", "race_id").agg(F.count(F.lit(1)).alias("k"))
    out = fields.groupBy("course").agg(F.count(F.lit(1)).alias("races"), F.avg("k").alias("mean_field"), F.median("k").alias("median_field"), F.min("k").alias("smallest"), F.max("k").alias("largest"))
    return tidy(out.withColumn("thin", F.col("races") < 10))


@query(f"""with {RUNNERS_SQL}, r as (select year(race_ts) as year, course, count(distinct race_id) as k from runners group by 1, 2), t as (select year, count(*) filter (k < 10) as thin_courses from r group by 1),
a as (select year(race_ts) as year, count(distinct race_id) as races, 100.0::double * count(*) filter (flat_jumps = 'FLAT') / count(*) as flat_pct, 100.0::double * count(*) filter (sp_decimal is null) / count(*) as price_pct, 100.0::double * count(*) filter (official_rating is null) / count(*) as rating_pct,
  100.0::double * count(*) filter (non_runner) / count(*) as nr_pct, 100.0::double * count(*) filter (dnf = 1) / count(*) as dnf_pct from runners group by 1)
select year, races, round(100 - (price_pct + rating_pct) / 2, 9) as completeness, concat_ws('; ', case when races < 10000 then 'fewer than 10000 races' end, case when thin_courses > 0 then 'courses with fewer than 10 races' end, case when greatest(flat_pct, 100 - flat_pct) > 90 then 'nearly all races of one code' end,
  case when price_pct > 20 then 'many runners without a starting price' end, case when rating_pct > 20 then 'many runners without a rating' end, case when nr_pct > 15 then 'many non-runners' end, case when dnf_pct > 10 then 'many runners that did not finish' end) as warnings from a join t using (year)""")
def bias_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings and completeness by year."""
    rows = racing.runners(spark, sf_dir).withColumn("year", F.year("race_ts"))
    share = lambda test: 100.0 * F.count_if(test) / F.count(F.lit(1))
    about = rows.groupBy("year").agg(F.countDistinct("race_id").alias("races"), share(F.col("flat_jumps") == "FLAT").alias("flat_pct"), share(F.col("sp_decimal").isNull()).alias("price_missing_pct"), share(F.col("official_rating").isNull()).alias("rating_missing_pct"), share(F.col("non_runner")).alias("non_runner_pct"), share(F.col("dnf") == 1).alias("dnf_pct"))
    courses = rows.groupBy("year", "course").agg(F.countDistinct("race_id").alias("k")).groupBy("year").agg(F.count_if(F.col("k") < 10).alias("thin_courses"))
    out = about.join(courses, "year")
    message = views.bias_warnings({c: F.col(c) for c in out.columns})
    return tidy(out.select("year", "races", views.completeness([F.col("price_missing_pct"), F.col("rating_missing_pct")]).alias("completeness"), F.array_join(message, "; ").alias("warnings")))


@query(f"""with {RUNNERS_SQL} select trainer_id, count(*) as bets, count(*) filter (finishing_position = 1) as wins, count(*) filter (finishing_position <= 3) as places, round(sum(case when finishing_position = 1 then sp_decimal - 1 else -1 end), 9) as profit from runners where sp_decimal is not null group by 1""")
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets, wins, places and profit at starting prices by trainer."""
    rows = racing.runners(spark, sf_dir).filter("sp_decimal is not null")
    won = F.coalesce(F.col("finishing_position") == 1, F.lit(False))
    return tidy(rows.groupBy("trainer_id").agg(F.count(F.lit(1)).alias("bets"), F.count_if(won).alias("wins"), F.count_if(F.col("finishing_position") <= 3).alias("places"), F.sum(F.when(won, F.col("sp_decimal") - 1).otherwise(-1.0)).alias("profit")))


@query(f"""with {RUNNERS_SQL}, t as (select distinct trainer_id from runners where flat_jumps = 'FLAT'), j as (select distinct trainer_id from runners where flat_jumps = 'JUMPS')
select 'both' as kind, count(*) as n from (select * from t intersect select * from j) union all select 'either', count(*) from (select * from t union select * from j) union all select 'flat only', count(*) from (select * from t except select * from j)""")
def trainer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainers of both codes, of either, and of the flat alone."""
    rows = racing.runners(spark, sf_dir)
    flat, jumps = (rows.filter(F.col("flat_jumps") == c).select("trainer_id").distinct() for c in ("FLAT", "JUMPS"))
    n = lambda kind, df: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("both", flat.intersect(jumps)).union(n("either", flat.union(jumps).distinct())).union(n("flat only", flat.exceptAll(jumps)))


@query(f"""with {RUNNERS_SQL}, d as (select distinct cast(race_ts as date) as day from runners where finishing_position is not null and model_score > 0) select strftime(day, '%Y-%m-%d') as day from d""")
def prediction_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that have both predictions and results."""
    rows = racing.runners(spark, sf_dir).filter("finishing_position is not null and model_score > 0")
    return rows.select(F.date_format("race_ts", "yyyy-MM-dd").alias("day")).distinct()


@query("""with w as (select user_id, event_type, 1.0 + value as price, ts, event_id, unnest([time_bucket(interval 15 minute, ts), time_bucket(interval 15 minute, ts) - interval 15 minute, time_bucket(interval 15 minute, ts) - interval 30 minute, time_bucket(interval 15 minute, ts) - interval 45 minute]) as start from events)
select epoch_us(start) as window_us, event_type as bookmaker, count(*) as ticks, round(avg(price), 6) as mean_price from w group by 1, 2""")
def odds_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices in windows of an hour that begin every quarter."""
    out = sliding_windows(racing.odds(spark, sf_dir))
    return out.select(F.unix_micros("window_start").alias("window_us"), "bookmaker", "ticks", F.round("mean_price", 6).alias("mean_price"))


@query("""with g as (select user_id, ts, event_id, coalesce((ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minute)::int, 1) as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from g)
select user_id as runner_id, epoch_us(min(ts)) as first_us, epoch_us(max(ts) + interval 30 minute) as end_us, count(*) as ticks from s group by user_id, k""")
def odds_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a runner's ticks that half an hour without any ends."""
    out = session_windows(racing.odds(spark, sf_dir))
    return out.select("runner_id", F.unix_micros("window_start").alias("first_us"), F.unix_micros("window_end").alias("end_us"), "ticks")
