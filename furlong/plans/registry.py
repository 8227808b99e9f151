"""The registered racing queries, each with the SQL of an independent engine for the same rows.

Fractions are rounded to nine digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.functions.scalars import is_placed, place_odds, rounded, settle_each_way, settle_win
from furlong.operators import asof, careers, evaluation, field, history, models, quality, rolling
from furlong.operators.quantiles import quantile_values
from furlong.sources import racing
from furlong.streaming.odds import windowed_prices

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

RACES_SQL = """
races as (
  select o_orderkey as race_id, o_orderdate as race_ts, n_name as course, r_name as country,
    cast(substr(o_orderpriority, 1, 1) as int) as race_class,
    case when o_orderstatus = 'F' then 'FLAT' else 'JUMPS' end as flat_jumps,
    5.0::double + (o_orderkey % 40)::double / 2 as distance_f,
    ['Firm', 'Good to Firm', 'Standard', 'Good', 'Standard to Slow', 'Good to Soft', 'Slow', 'Soft', 'Heavy', null][o_custkey % 10 + 1] as going
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""
RUNNERS_SQL = RACES_SQL + """,
kept as (
  select * from lineitem
  qualify row_number() over (partition by l_orderkey, l_partkey order by l_extendedprice, l_suppkey, l_linenumber) = 1),
drawn as (
  select *, row_number() over (partition by l_orderkey order by l_partkey) as draw,
    case when l_returnflag = 'R' and l_linenumber = 7 then 1 else 0 end as dnf
  from kept),
runners as (
  select l_orderkey * 100 + draw as runner_id, races.*, l_partkey as horse_id, l_suppkey as trainer_id, (l_suppkey * 7 + l_linenumber) % 60 as jockey_id, draw,
    112 + cast(l_quantity as int) % 42 as weight_lbs,
    case when l_discount <> 0 then 40 + l_partkey % 60 + cast(round(l_discount * 100) as int) end as official_rating,
    case when l_tax <> 0 then 1.0::double + l_quantity / 4 end as sp_decimal, dnf,
    case when dnf = 0 then row_number() over (partition by l_orderkey order by dnf, l_extendedprice desc, l_partkey) end as finishing_position,
    l_returnflag = 'N' and l_linenumber = 6 as non_runner, 2 + l_partkey % 9 as age,
    case when l_linenumber % 4 <> 0 then 'h' || (l_linenumber % 4) end as headgear,
    case when l_linenumber % 3 <> 0 then 'c' || (l_linenumber % 3) end as pace_comment,
    (51.0::double - l_quantity) / 51.0::double as model_score,
    count(*) over (partition by l_orderkey) as field_size
  from drawn join races on race_id = l_orderkey)"""
HISTORY_SQL = RUNNERS_SQL + """,
pct as (select *, case when field_size > 1 then (field_size - finishing_position)::double / (field_size - 1) end as pct from runners),
past as (
  select r.runner_id, h.*, row_number() over (partition by r.runner_id order by h.race_ts desc, h.race_id desc) as rn, r.race_ts as own_ts,
    r.course as own_course, r.distance_f as own_distance, r.going as own_going, r.flat_jumps as own_code, r.race_class as own_class, r.official_rating as own_rating, r.trainer_id as own_trainer, r.headgear as own_headgear
  from runners r join (select * exclude (runner_id) from pct) h on h.horse_id = r.horse_id and h.race_ts < r.race_ts)"""
SOFT_SQL = "coalesce(map {'Firm': 0.0, 'Good to Firm': 0.2, 'Standard': 0.3, 'Good': 0.4, 'Standard to Slow': 0.55, 'Good to Soft': 0.6, 'Slow': 0.7, 'Soft': 0.85, 'Heavy': 1.0}[%s], 0.5)::double"
ODDS_SQL = "odds as (select user_id as runner_id, event_type as bookmaker, ts as tick_ts, 1.0 + value as price, date_trunc('day', ts) + interval 18 hour as off_ts, event_type = 'purchase' as is_sp, event_id from events)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to nine digits, integers as long."""
    kinds = {"double": rounded, "int": lambda c: c.cast("long"), "float": rounded}
    return df.select(*[kinds[t](F.col(c)).alias(c) if t in kinds else F.col(c) for c, t in df.dtypes])


def _history(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """Runners with those columns of their earlier runs that a query needs."""
    return history.with_history(racing.runners(spark, sf_dir), only=list(only))


def _record_sql(prefix: str, test: str, rates: bool = True) -> str:
    n, w, p = (f"count(h.runner_id) filter ({test}{x})" for x in ("", " and h.finishing_position = 1", " and h.finishing_position <= 3"))
    out = f"{n} as {prefix}_starts, {w} as {prefix}_wins, {p} as {prefix}_places"
    return out + (f", round({w}::double / nullif({n}, 0), 9) as {prefix}_win_rate, round({p}::double / nullif({n}, 0), 9) as {prefix}_place_rate" if rates else "")


_NEAR = "abs(h.distance_f - own_distance) <= 1.5"


def _known_going_sql() -> str:
    """Null where today's going is unknown and there are earlier runs."""
    n, w, p = (f"count(h.runner_id) filter (h.going = own_going{x})" for x in ("", " and h.finishing_position = 1", " and h.finishing_position <= 3"))
    known = "count(h.runner_id) = 0 or any_value(r.going) is not null"
    values = {"starts": n, "wins": w, "places": p, "win_rate": f"round({w}::double / nullif({n}, 0), 9)", "place_rate": f"round({p}::double / nullif({n}, 0), 9)"}
    return ", ".join(f"case when {known} then {v} end as going_{k}" for k, v in values.items())


@query(f"""with {HISTORY_SQL}
select r.runner_id, {_record_sql("course", "h.course = own_course")}, {_record_sql("distance", _NEAR)}, {_record_sql("course_distance", f"h.course = own_course and {_NEAR}", False)},
  {_known_going_sql()}, {_record_sql("race_type", "h.flat_jumps = own_code")}
from runners r left join past h on h.runner_id = r.runner_id group by r.runner_id""")
def course_distance_going(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.course_distance_going(racing.runners(spark, sf_dir)))


_W = "exp(-(rn - 1) * ln(2) / 3)"


@query(f"""with {HISTORY_SQL}
select r.runner_id, count(h.runner_id) as career_runs_to_date, (count(h.runner_id) = 0)::bigint as first_time_out_flag,
  max(finishing_position) filter (rn = 1) as form_last_run_position,
  round(avg(finishing_position) filter (rn <= 3), 9) as form_avg_position_last3, round(avg(finishing_position) filter (rn <= 5), 9) as form_avg_position_last5,
  round(sum(pct * {_W}) / sum({_W}) filter (pct is not null), 9) as form_recency_weighted_percentile,
  round(avg(pct) filter (rn <= 3), 9) as form_or_relative_recent,
  case when count(pct) filter (rn <= 5) >= 2 then round(stddev_pop(pct) filter (rn <= 5), 9) end as form_consistency,
  {", ".join(f"case when count(h.runner_id) > 0 then count(h.runner_id) filter (rn <= {k} and finishing_position = 1) end as form_wins_last{k}, case when count(h.runner_id) > 0 then count(h.runner_id) filter (rn <= {k} and finishing_position <= 3) end as form_places_last{k}" for k in (3, 5, 10))}
from (select runner_id from runners) r left join past h on h.runner_id = r.runner_id group by r.runner_id""")
def current_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.recent_form(racing.runners(spark, sf_dir), racing.parts(spark, sf_dir)))


@query(f"""with {HISTORY_SQL},
p as (select runner_id, pct, -row_number() over (partition by runner_id order by rn) as x from past where rn <= 5 and pct is not null),
o as (select runner_id, official_rating, -row_number() over (partition by runner_id order by rn) as x from past where rn <= 5 and official_rating is not null),
g as (select runner_id, floor((epoch_us(race_ts) - epoch_us(lead(race_ts) over (partition by runner_id order by rn))) / 86400000000) as gap from past where rn <= 10)
select r.runner_id, round(a.s, 9) as form_improvement_slope, round(b.s, 9) as rating_slope, round(c.m, 9) as avg_days_between_runs
from runners r
left join (select runner_id, case when count(*) >= 2 then regr_slope(pct, x) end as s from p group by 1) a using (runner_id)
left join (select runner_id, case when count(*) >= 2 then regr_slope(official_rating, x) end as s from o group by 1) b using (runner_id)
left join (select runner_id, avg(gap) as m from g group by 1) c using (runner_id)""")
def form_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.form_slopes(racing.runners(spark, sf_dir)))


def _versus_sql(value: str) -> str:
    return f"""with {RUNNERS_SQL}
select runner_id, {value}::double as {value},
  case when {value} is not null then round((rank() over (partition by race_id order by {value} nulls last) - 1 + 0.5 * count({value}) over (partition by race_id, {value})) / count({value}) over (partition by race_id), 9) end as percentile_in_field,
  round({value} - avg({value}) over (partition by race_id), 9) as diff_to_field_mean, ({value} - max({value}) over (partition by race_id))::double as diff_to_field_top
from runners"""


@query(_versus_sql("official_rating"))
def rating_vs_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.versus_field(racing.runners(spark, sf_dir), "official_rating"))


@query(_versus_sql("weight_lbs"))
def weight_vs_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.versus_field(racing.runners(spark, sf_dir), "weight_lbs"))


@query(f"""with {HISTORY_SQL},
marks as (select *, row_number() over (partition by runner_id order by rn) as k from past where official_rating is not null),
m as (select runner_id, max(official_rating) filter (k = 1) as p1, max(official_rating) filter (k = 3) as p3, max(official_rating) filter (k <= 5) as best from marks group by 1),
w as (select runner_id, arg_min(struct_pack(x := official_rating), rn).x as win_or from past where finishing_position = 1 group by 1)
select r.runner_id, official_rating - p1 as mark_change_since_last_run, official_rating - p3 as mark_change_last3, official_rating - win_or as or_vs_last_winning_or,
  official_rating - best as or_vs_best_recent_mark, (official_rating - best <= -3)::bigint as well_in_flag
from runners r left join m using (runner_id) left join w using (runner_id)""")
def rating_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.rating_history(_history(spark, sf_dir, "race_ts", "official_rating", "finishing_position")))


@query(f"""with {HISTORY_SQL}
select r.runner_id, any_value(r.race_class) as current_class, max(h.race_class) filter (rn = 1) - any_value(r.race_class) as class_change_from_prev,
  case when count(h.race_class) >= 3 then round(avg(h.race_class) filter (rn <= 3), 9) end as avg_class_last3,
  round(count(*) filter (h.race_class = own_class and h.finishing_position = 1)::double / nullif(count(*) filter (h.race_class = own_class), 0), 9) as class_success_rate,
  round(count(*) filter (h.race_class = own_class and h.finishing_position <= 3)::double / nullif(count(*) filter (h.race_class = own_class), 0), 9) as class_place_rate,
  round(avg(pct) filter (h.race_class <= own_class), 9) as class_adjusted_recent_form
from runners r left join past h on h.runner_id = r.runner_id group by r.runner_id""")
def class_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.class_record(racing.runners(spark, sf_dir)))


@query(f"""with {HISTORY_SQL},
g as (select runner_id, {SOFT_SQL % "going"} as s, {SOFT_SQL % "own_going"} as own, row_number() over (partition by runner_id order by rn) as k from past where going is not null)
select r.runner_id, round(sum((1 - abs(s - own)) * exp(-(k - 1) * ln(2) / 3)) / sum(exp(-(k - 1) * ln(2) / 3)), 9) as going_similarity_score,
  max((abs(own - s) > 0.25)::bigint) filter (k = 1) as going_change_flag
from (select runner_id from runners) r left join g using (runner_id) group by r.runner_id""")
def going_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.going_similarity(racing.runners(spark, sf_dir)))


@query(f"""with {RUNNERS_SQL},
p as (select runner_id, field_size, draw as draw_number, case when count(draw) over (partition by race_id) > 1 then (rank() over (partition by race_id order by draw) - 0.5) / count(draw) over (partition by race_id)::double end as q from runners)
select runner_id, field_size, draw_number, round(q, 9) as draw_percentile, (q <= 1.0::double / 3)::bigint as draw_bucket_low,
  (q > 1.0::double / 3 and q <= 2 * (1.0::double / 3))::bigint as draw_bucket_mid, (q > 2 * (1.0::double / 3))::bigint as draw_bucket_high from p""")
def draw_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.draw_position(racing.runners(spark, sf_dir)))


_THIRD = "case when {0} <= 1.0::double / 3 then 0 when {0} <= 2 * (1.0::double / 3) then 1 else 2 end"


@query(f"""with {RUNNERS_SQL},
b as (select *, epoch_us(race_ts) as t, {_THIRD.format("(draw / field_size::double)")} as third, case when field_size > 1 then {_THIRD.format("((draw - 0.5::double) / field_size::double)")} else 0 end as own_third,
  case when field_size <= 8 then 'SMALL' when field_size <= 14 then 'MEDIUM' else 'LARGE' end as size_band, round_even(distance_f / 2, 0) * 2 as distance_band from runners),
o as (select *, count(*) over w as sample_size, {", ".join(f"count(*) filter (third = {x}) over w as n{x}, count(*) filter (third = {x} and finishing_position = 1) over w as w{x}" for x in range(3))} from b
  window w as (partition by course, distance_band, size_band order by t range between unbounded preceding and 1 preceding)),
k as (select runner_id, sample_size, case own_third when 0 then n0 when 1 then n1 else n2 end as own, case own_third when 0 then w0 when 1 then w1 else w2 end as own_wins from o)
select runner_id, sample_size, case when sample_size >= 30 and own >= 10 then round(own_wins::double / own, 9) end as draw_bias_win_rate, (sample_size >= 30 and own >= 10)::bigint as draw_bias_available from k""")
def draw_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rolling.draw_bias(racing.runners(spark, sf_dir), in_parts=racing.parts(spark, sf_dir)))


def _strike_sql(key: str) -> str:
    day = 86_400_000_000
    w = lambda d: f"over (partition by {key} order by epoch_us(race_ts) range between {d * day} preceding and 1 preceding)"
    n = lambda x, d: f"coalesce(sum({x}) {w(d)}, 0)::bigint"
    won, placed = "coalesce((finishing_position = 1)::int, 0)", "coalesce((finishing_position <= 3)::int, 0)"
    return f"""with {RUNNERS_SQL}
select runner_id, {n("1", 14)} as runs_14d, {n("1", 30)} as runs_30d, round(({n(won, 14)} + 0.4::double) / ({n("1", 14)} + 4), 9) as strike_rate_14d,
  round(({n(won, 30)} + 0.4::double) / ({n("1", 30)} + 4), 9) as strike_rate_30d, round(({n(placed, 30)} + 1.2::double) / ({n("1", 30)} + 4), 9) as place_rate_30d from runners"""


@query(_strike_sql("trainer_id"))
def trainer_rolling_14_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rolling.strike_rates(racing.runners(spark, sf_dir), "trainer_id"))


@query(_strike_sql("jockey_id"))
def jockey_rolling_14_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rolling.strike_rates(racing.runners(spark, sf_dir), "jockey_id"))


def _combo(name: str, keys: str) -> str:
    w = f"over (partition by {keys} order by epoch_us(race_ts) range between unbounded preceding and 1 preceding)"
    return f"count(*) {w} as {name}_runs, round((coalesce(sum(coalesce((finishing_position = 1)::int, 0)) {w}, 0) + 0.4::double) / (count(*) {w} + 4), 9) as {name}_rate"


@query(f"""with {RUNNERS_SQL}
select runner_id, {_combo("trainer_course", "trainer_id, course")}, {_combo("jockey_course", "jockey_id, course")}, {_combo("trainer_jockey", "trainer_id, jockey_id")} from runners""")
def combo_course_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(rolling.combination_rates(racing.runners(spark, sf_dir)))


@query(f"""with {HISTORY_SQL}
select r.runner_id, case when any_value(r.headgear) is not null and count(h.runner_id) > 0 then count(*) filter (h.headgear = own_headgear) end as prior_headgear_runs,
  case when any_value(r.headgear) is not null and count(h.runner_id) > 0 then round(count(*) filter (h.headgear = own_headgear and h.finishing_position = 1)::double / nullif(count(*) filter (h.headgear = own_headgear), 0), 9) end as prior_headgear_win_rate,
  count(*) filter (h.trainer_id = own_trainer) as runs_for_current_trainer, (count(*) filter (h.trainer_id = own_trainer) = 0)::bigint as first_run_for_trainer_flag,
  (count(*) filter (h.trainer_id = own_trainer) = 1)::bigint as second_run_for_trainer_flag, coalesce(max((h.trainer_id <> own_trainer)::bigint) filter (rn = 1), 0) as trainer_change_flag
from runners r left join past h on h.runner_id = r.runner_id group by r.runner_id""")
def headgear_trainer_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.headgear_trainer(racing.runners(spark, sf_dir)))


@query(f"""with {HISTORY_SQL},
n as (select runner_id, count(*) as n, count(*) filter (race_ts >= own_ts - interval 365 day) as y from past group by 1),
a as (select r.*, coalesce(n, 0) as n, coalesce(y, 0) as y from runners r left join n using (runner_id))
select runner_id, n as career_starts_to_date, y as starts_last_12_months, (n = 0)::bigint as experience_band_unraced, (n between 1 and 3)::bigint as experience_band_lightly_raced,
  (n between 4 and 9)::bigint as experience_band_moderate, (n >= 10)::bigint as experience_band_exposed, (n <= 3)::bigint as lightly_raced_flag, age as horse_age,
  case when flat_jumps = 'JUMPS' then age else 0 end as age_x_jumps, round(age * distance_f, 9) as age_x_distance from a""")
def age_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(history.age_experience(_history(spark, sf_dir, "race_ts")))


def _runs_sql(key: str) -> str:
    return f"count(*) over (partition by {key} order by epoch_us(race_ts) range between {30 * 86_400_000_000} preceding and 1 preceding)"


_SUB = {"career_starts": "least(coalesce(n, 0), 15) / 15.0::double", "recent_starts": "least(coalesce(y, 0), 6) / 6.0::double", "course_distance_evidence": "least(coalesce(cd, 0), 3) / 3.0::double", "sectional_availability": "coalesce(sectional, 0.0::double)", "race_comment_availability": "coalesce(commented, 0.0::double)", "rating_history": "coalesce(rated, 0.0::double)", "trainer_jockey_data": "least(least(t30 / 5.0::double, 1.0::double), least(j30 / 5.0::double, 1.0::double))"}


@query(f"""with {HISTORY_SQL},
n as (select runner_id, count(*) as n, count(*) filter (race_ts >= own_ts - interval 365 day) as y, count(*) filter (h.course = own_course and {_NEAR}) as cd,
  count(*) filter (rn <= 5)::double / count(*) filter (rn <= 5) as sectional, count(pace_comment) filter (rn <= 5)::double / count(*) filter (rn <= 5) as commented,
  count(official_rating) filter (rn <= 5)::double / count(*) filter (rn <= 5) as rated from past h group by 1),
b as (select runner_id, {_runs_sql("trainer_id")} as t30, {_runs_sql("jockey_id")} as j30 from runners),
a as (select runner_id, {", ".join(f"{v} as {k}" for k, v in _SUB.items())} from b left join n using (runner_id)),
s as (select *, round(100 * ({" + ".join(f"{w}::double * {k}" for k, w in history.EVIDENCE.items())}), 9) as score from a)
select runner_id, round(score, 2) as evidence_density_score_100, round(score / 100, 4) as evidence_density_score,
  case when score < 20 then 'VERY_LOW' when score < 40 then 'LOW' when score < 65 then 'MODERATE' when score < 85 then 'HIGH' else 'VERY_HIGH' end as evidence_density_label,
  {", ".join(f"round({k}, 4) as evidence_subscore_{k}" for k in _SUB)} from s""")
def evidence_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.evidence(with_evidence(racing.runners(spark, sf_dir)))


def with_evidence(runners: DataFrame, *keep: str, counters: dict[str, str] | None = None) -> DataFrame:
    """The columns to keep, dealt out by horse, with what the evidence of a runner is made of, and records by columns under prefixes."""
    runs = rolling.counts()["runs"]
    needed = ["runner_id", "race_id", "horse_id", "race_ts", "trainer_id", "jockey_id", "course", "distance_f", "finishing_position", "field_size", "pace_comment", "official_rating"]
    rows = runners.select(*dict.fromkeys([*needed, *keep]))
    for who in ("trainer", "jockey"):
        rows = rows.withColumn(f"{who}_runs_30d", rolling.within(runs, [f"{who}_id"], 30))
    rows = careers.dealt(rows)
    for prefix, key in (counters or {}).items():
        rows = careers.counted(rows, prefix, key)
    return careers.with_evidence_counts(rows)


@query(f"""with {RUNNERS_SQL},
p as (select *, (rank() over (partition by race_id order by draw) - 0.5) / count(*) over (partition by race_id) as q from runners),
o as (select *, case when q <= 0.25 then 'LEADER' when q <= 0.5 then 'PROMINENT' when q <= 0.75 then 'MIDFIELD' else 'HOLD_UP' end as role from p),
c as (select *, count(*) filter (role = 'LEADER') over w as leaders, count(*) filter (role = 'PROMINENT') over w as prominent, count(*) filter (role = 'HOLD_UP') over w as holdup, count(*) over w as n from o window w as (partition by race_id)),
s as (select *, least(2.0::double, (1.5::double * leaders + 0.6::double * prominent) / n) as pressure from c)
select runner_id, role, leaders, prominent, holdup, round(pressure, 9) as pressure, round(least(1.0::double, pressure / 2), 9) as collapse_risk,
  round(case when role in ('LEADER', 'PROMINENT') then pressure else 0 end, 9) as prominent_in_burnout_risk,
  round(case when role = 'HOLD_UP' then greatest(0.0::double, least(0.5::double, 0.5::double - pressure)) else 0 end, 9) as holdup_in_weak_pace_penalty,
  round(case when role = 'HOLD_UP' then pressure else 0 end, 9) as closer_in_strong_pace_boost from s""")
def race_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.race_shape(racing.runners(spark, sf_dir)))


FIELDS = ["click", "purchase", "signup", "view"]


@query("""with c as (select user_id as entity_id, event_type as f, cast(props->>'k' as bigint) as v, ts, event_id from events where ts <= timestamp '2024-01-15 12:00:00'),
l as (select * from c qualify row_number() over (partition by entity_id, f order by ts desc, event_id desc) = 1)
select entity_id, max(v) filter (f = 'click') as click, max(v) filter (f = 'purchase') as purchase, max(v) filter (f = 'signup') as signup, max(v) filter (f = 'view') as "view" from l group by 1""")
def field_asof_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.fields_as_of(racing.field_changes(spark, sf_dir), "2024-01-15 12:00:00", FIELDS)


@query("""with f as (select user_id, ts as effective_ts, cast(props->>'k' as bigint) as v from events where event_type = 'purchase'), p as (select event_id, user_id, ts from events where event_type <> 'purchase')
select event_id, p.user_id as user_id, epoch_us(ts) as probe_us, v as field_value_as_of from p asof left join f on p.user_id = f.user_id and p.ts >= f.effective_ts""")
def asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = racing.field_changes(spark, sf_dir).withColumnRenamed("entity_id", "user_id")
    probes = changes.filter("field_name <> 'purchase'").select("event_id", "user_id", F.col("effective_ts").alias("ts"))
    facts = changes.filter("field_name = 'purchase'").select("user_id", "effective_ts", "field_value")
    joined = asof.as_of_join(probes, facts, "user_id", "ts", "effective_ts", "field_value")
    return joined.select("event_id", "user_id", F.unix_micros("ts").alias("probe_us"), "field_value_as_of")


_SNAPS = ", ".join(f"round(arg_max(price, (tick_ts, event_id)) filter (tick_ts <= off_ts - interval {m} minute), 9) as {n}" for n, m in asof.OFFSETS.items())


@query(f"""with {ODDS_SQL}
select runner_id, bookmaker, strftime(off_ts, '%Y-%m-%d') as day, round(arg_min(price, (tick_ts, event_id)), 9) as opening, {_SNAPS}, round(arg_max(price, (tick_ts, event_id)) filter (is_sp), 9) as sp, count(*) as ticks
from odds where tick_ts <= off_ts group by runner_id, bookmaker, off_ts""")
def odds_named_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.named_snapshots(racing.odds(spark, sf_dir))
    return tidy(out.select("runner_id", "bookmaker", F.date_format("off_ts", "yyyy-MM-dd").alias("day"), *[c for c in out.columns if c not in ("runner_id", "bookmaker", "off_ts")]))


@query(f"""with {ODDS_SQL}
select epoch_us(time_bucket(interval 1 hour, tick_ts)) as window_us, runner_id, bookmaker, round(arg_min(price, (tick_ts, event_id)), 9) as opening, round(arg_max(price, (tick_ts, event_id)), 9) as closing, round(min(price), 9) as lowest, round(max(price), 9) as highest, count(*) as ticks
from odds group by 1, 2, 3""")
def odds_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_prices(racing.odds(spark, sf_dir))
    return tidy(out.select(F.unix_micros("window_start").alias("window_us"), *out.columns[1:]))


@query(f"""with {ODDS_SQL}
select runner_id, arg_max(bookmaker, (tick_ts, event_id)) as bookmaker, round(max_by(price, (tick_ts, event_id)), 9) as price, count(*) as ticks from odds group by 1""")
def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("tick_ts", "event_id")
    return tidy(racing.odds(spark, sf_dir).groupBy("runner_id").agg(F.max_by("bookmaker", order).alias("bookmaker"), F.max_by("price", order).alias("price"), F.count(F.lit(1)).alias("ticks")))


_MARKET = "market as (select *, case when count(*) filter (sp_decimal is null or sp_decimal <= 0) over (partition by race_id) = 0 then 1 / sp_decimal / sum(1 / sp_decimal) over (partition by race_id) end as p_market, case when count(*) filter (sp_decimal is null or sp_decimal <= 0) over (partition by race_id) = 0 then (sum(1 / sp_decimal) over (partition by race_id) - 1) * 100 end as overround_pct from runners)"
_WIN = "win as (select *, round(greatest(model_score, 1e-6::double) / sum(greatest(model_score, 1e-6::double)) over (partition by race_id), 9) as p_win from runners)"


@query(f"with {RUNNERS_SQL}, {_MARKET} select runner_id, round(p_market, 9) as p_market, round(overround_pct, 9) as overround_pct from market")
def market_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.market_normalised(racing.runners(spark, sf_dir)).select("runner_id", "p_market", "overround_pct"))


@query(f"with {RUNNERS_SQL}, {_WIN} select runner_id, p_win from win")
def win_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field.win_normalised(racing.runners(spark, sf_dir)).select("runner_id", "p_win")


_PLACE_CTES = ", ".join(
    f"s{k} as (select *, least(greatest(p_win ** (1.0::double / {k}), 1e-6::double) * least({k}, count(*) over (partition by race_id)) / sum(greatest(p_win ** (1.0::double / {k}), 1e-6::double)) over (partition by race_id), 0.999::double) as q{k} from {'win' if k == 2 else f's{k - 1}'})" for k in range(2, 7)
)


@query(f"with {RUNNERS_SQL}, {_WIN}, {_PLACE_CTES} select runner_id, " + ", ".join(f"round(greatest({', '.join(f'q{j}' for j in range(2, k + 1))}), 9) as p_top{k}" for k in range(2, 7)) + " from s6")
def place_rescaled_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(field.place_probabilities(racing.runners(spark, sf_dir)).select("runner_id", *[f"p_top{k}" for k in range(2, 7)]))


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners with win probability and edges, to nine digits so that equal fractions are equal."""
    priced = field.win_normalised(racing.runners(spark, sf_dir))
    rows = evaluation.edges(priced, "p_win", "sp_decimal").withColumns({"implied": F.round("implied", 9), "edge": F.round("edge", 9), "relative_edge": F.round("relative_edge", 12)})
    return rows.withColumn("won", F.coalesce((F.col("finishing_position") == 1).cast("int"), F.lit(0)))


_EDGES = f"{_WIN}, edged as (select *, round(1 / sp_decimal, 9) as implied, 1 / p_win as fair_odds, round(p_win - 1 / sp_decimal, 9) as edge, round((p_win - 1 / sp_decimal) / (1 / sp_decimal), 12) as relative_edge, coalesce((finishing_position = 1)::int, 0) as won from win)"


@query(f"with {RUNNERS_SQL}, {_EDGES} select runner_id, implied, round(fair_odds, 4) as fair_odds, edge, relative_edge from edged")
def value_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _valued(spark, sf_dir)
    return out.select("runner_id", "implied", F.round("fair_odds", 4).alias("fair_odds"), "edge", "relative_edge")


_BINS = "case " + " ".join(f"when edge <= {c} then {i}" for i, c in enumerate(evaluation.COHORTS)) + f" else {len(evaluation.COHORTS)} end"


@query(f"""with {RUNNERS_SQL}, {_EDGES}, f as (select {_BINS} as cohort, count(*) as n, sum(won) as wins, avg(p_win) as mean_p, sum(won * sp_decimal) - count(*) as profit from edged where edge is not null group by 1)
select range as cohort, coalesce(n, 0) as n, wins::bigint as wins, round(mean_p, 9) as mean_p, round(100 * profit / n, 4) as roi_pct from range({len(evaluation.COHORTS) + 1}) left join f on cohort = range""")
def value_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir).withColumn("cohort", evaluation.cohort(F.col("edge")).cast("long")).filter("edge is not null")
    found = rows.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.avg("p_win").alias("mean_p"), (F.sum(F.col("won") * F.col("sp_decimal")) - F.count(F.lit(1))).alias("profit"))
    every = spark.range(len(evaluation.COHORTS) + 1).withColumnRenamed("id", "cohort")
    return tidy(every.join(found, "cohort", "left").select("cohort", F.coalesce("n", F.lit(0)).alias("n"), "wins", "mean_p", F.round(100 * F.col("profit") / F.col("n"), 4).alias("roi_pct")))


@query(f"""with {RUNNERS_SQL}, {_EDGES}, f as (select least(floor(round(p_win * 10, 8)), 9)::int as bucket, count(*) as n, avg(p_win) as mean_p, avg(won) as observed from edged group by 1)
select range as bucket, coalesce(n, 0) as n, round(mean_p, 9) as mean_p, round(observed, 9) as observed from range(10) left join f on bucket = range""")
def calibration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.calibration(_valued(spark, sf_dir), "p_win", "won"))


@query(f"""with {RUNNERS_SQL}, {_EDGES}, c as (select won, least(greatest(p_win, 1e-6::double), 1 - 1e-6::double) as q, p_win from edged),
r as (select won, rank() over (order by p_win) + (count(*) over (partition by p_win) - 1) / 2.0::double as k from c)
select (select count(*) from c) as n, (select round(avg((p_win - won) ** 2), 9) from c) as brier, (select round(avg(-(won * ln(q) + (1 - won) * ln(1 - q))), 9) from c) as log_loss,
  (select round((sum(k) filter (won = 1) - count(*) filter (won = 1) * (count(*) filter (won = 1) + 1) / 2.0::double) / (count(*) filter (won = 1) * count(*) filter (won = 0)), 9) from r) as auc""")
def brier_logloss_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir).select("p_win", "won")
    one = rows.agg(F.count(F.lit(1)).alias("n"), evaluation.brier(F.col("p_win"), F.col("won")).alias("brier"), evaluation.log_loss(F.col("p_win"), F.col("won")).alias("log_loss"))
    return tidy(one.join(evaluation.roc_auc(rows, "p_win", "won"), F.lit(True)))  # one row each


_BAND = "case when sp_decimal <= 2 then '<=2' when sp_decimal <= 4 then '2-4' when sp_decimal <= 8 then '4-8' else '>8' end"


@query(f"with {RUNNERS_SQL}, {_EDGES} select {_BAND} as band, count(*) as n, round(sum(won * sp_decimal), 9) as returned, round(sum(won * sp_decimal) - count(*), 9) as profit, round(100 * (sum(won * sp_decimal) - count(*)) / count(*), 9) as roi_pct from edged where sp_decimal is not null group by 1")
def roi_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.flat_stake(_valued(spark, sf_dir), [F.expr(_BAND).alias("band")], "sp_decimal", "won"))


@query(f"""with {RUNNERS_SQL}, {_EDGES}
select case when grouping(flat_jumps) = 0 then 'code' when grouping(race_class) = 0 then 'class' else 'course' end as dimension, coalesce(flat_jumps, race_class::varchar, course) as label,
  count(*) as n, sum(won)::bigint as wins, round(sum(p_win), 4) as expected, round(avg((p_win - won) ** 2), 9) as brier
from edged group by grouping sets ((flat_jumps), (race_class), (course))""")
def breakdown_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir).select("flat_jumps", F.col("race_class").cast("string").alias("race_class"), "course", "won", "p_win")
    dims = [F.col("flat_jumps"), F.col("race_class"), F.col("course")]
    sets = rows.groupingSets([[dims[0]], [dims[1]], [dims[2]]], *dims).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("won").alias("wins"), F.round(F.sum("p_win"), 4).alias("expected"), evaluation.brier(F.col("p_win"), F.col("won")).alias("brier"))
    name = F.when(F.col("g") == 3, "code").when(F.col("g") == 5, "class").otherwise("course")
    return tidy(sets.select(name.alias("dimension"), F.coalesce("flat_jumps", "race_class", "course").alias("label"), "n", "wins", "expected", "brier"))


@query(f"""with {RACES_SQL}, o as (select race_id, row_number() over (order by race_ts, race_id) as k, count(*) over () as n from races)
select race_id, case when k <= floor(n * 0.6::double) then 'train' when k <= floor(n * (0.6::double + 0.2::double)) then 'validation' else 'test' end as split from o""")
def chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chronological_split(racing.races(spark, sf_dir))


@query(f"with {HISTORY_SQL}, n as (select runner_id, count(*) as n from past group by 1) select course, count(*) as runners, sum(coalesce(n, 0))::bigint as visible_runs, 0::bigint as violations, 'PASSED' as status from runners left join n using (runner_id) group by course")
def leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.leakage(_history(spark, sf_dir, "race_ts"))


@query(f"""with {RUNNERS_SQL}, f as (select *, coalesce((sp_decimal = min(sp_decimal) over (partition by race_id))::int, 0) as fav, coalesce((finishing_position = 1)::int, 0) as won from runners)
select year(race_ts) as year, count(distinct race_id) as races, count(*) as runners, round(count(*) / count(distinct race_id)::double, 9) as mean_field, round(100.0::double * count(*) filter (flat_jumps = 'FLAT') / count(*), 9) as flat_pct,
  round(100.0::double * sum(fav * won) / nullif(sum(fav), 0), 9) as favourite_win_pct from f group by 1""")
def bias_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.year_bias(racing.runners(spark, sf_dir)))


_RANK = "case when sp_decimal is null then 'none' when k = 1 then '1' when k <= 3 then '2-3' else '4+' end"


@query(f"""with {RUNNERS_SQL}, k as (select *, rank() over (partition by race_id order by sp_decimal nulls last) as k from runners)
select {_RANK} as favourite_bucket, count(*) as n, count(*) filter (finishing_position = 1) as wins, count(*) filter (dnf = 1) as dnf, count(*) filter (non_runner) as non_runners from k group by 1""")
def bias_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = racing.runners(spark, sf_dir).withColumn("k", F.rank().over(Window.partitionBy("race_id").orderBy(F.col("sp_decimal").asc_nulls_last())))
    return rows.groupBy(F.expr(_RANK).alias("favourite_bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("finishing_position") == 1).alias("wins"), F.count_if(F.col("dnf") == 1).alias("dnf"), F.count_if("non_runner").alias("non_runners"))


@query(f"with {RACES_SQL}, d as (select distinct cast(race_ts as date) as day from races), e as (select unnest(generate_series((select min(day) from d), (select max(day) from d), interval 1 day))::date as day) select strftime(day, '%Y-%m-%d') as day from e anti join d using (day)")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missing_days(racing.races(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


_FEATURES = ["official_rating", "sp_decimal", "finishing_position", "headgear", "going", "draw", "weight_lbs"]


@query(f"with {RUNNERS_SQL} " + " union all ".join(f"select '{c}' as feature, count(*) as rows, count({c}) as present, round(100.0::double * count({c}) / count(*), 9) as available_pct from runners" for c in _FEATURES))
def quality_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(quality.availability(racing.runners(spark, sf_dir), _FEATURES))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) over (partition by l_orderkey, l_partkey) as copies from lineitem qualify row_number() over (partition by l_orderkey, l_partkey order by l_extendedprice, l_suppkey, l_linenumber) = 1")
def dedup_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.import_once(racing.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"], ["l_extendedprice", "l_suppkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "copies")


@query("""with c as (select *, coalesce((event_type <> lag(event_type) over w)::int, 1) as changed from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum(changed) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from c)
select user_id, island::bigint as island, any_value(event_type) as event_type, count(*) as n, min(event_id) as first_event from i group by 1, 2""")
def islands_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.islands(racing.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


_NAMES = "select c_custkey as id, case c_custkey % 3 when 0 then c_mktsegment || ' D''Été' when 1 then 'St. ' || c_mktsegment || '  ' || c_nationkey else c_name end as name from customer"


@query(f"""with n as ({_NAMES}), m as (select id, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '[''`.,]', '', 'g'), '\\s+', ' ', 'g')) as normalized from n),
f as (select normalized, min(id) as canonical_id, count(*) as candidates from m group by 1)
select id, normalized, canonical_id, candidates, case when candidates > 1 then 'QUEUED' else 'NEW' end as status from m join f using (normalized)""")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_mktsegment", F.lit(" D'Été"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("St. "), F.col("c_mktsegment"), F.lit("  "), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name"))
    names = racing.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"))
    return quality.resolve(names, "id", "name")


_SETTLED = "settled as (select runner_id, sp_decimal as sp, finishing_position = 1 as won, coalesce(finishing_position between 1 and 3, false) as placed from runners where sp_decimal is not null)"


@query(f"""with {RUNNERS_SQL}, {_SETTLED}
select runner_id, placed, round(1 + (sp - 1) * 0.2::double, 9) as place_odds, round(case when won then sp - 1 else -1 end, 9) as pl_win,
  round(case when won then sp - 1 else -1 end + case when won or placed then (sp - 1) * 0.2::double else -1 end, 9) as pl_each_way from settled""")
def settlement_each_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    fraction = F.lit(0.2)
    rows = racing.runners(spark, sf_dir).filter("sp_decimal is not null").withColumn("won", F.coalesce(F.col("finishing_position") == 1, F.lit(False))).withColumn("placed", is_placed(F.col("finishing_position"), F.lit(3)))
    won, placed, sp = F.col("won"), F.col("placed"), F.col("sp_decimal")
    return tidy(rows.select("runner_id", "placed", place_odds(sp, fraction).alias("place_odds"), settle_win(won, sp).alias("pl_win"), settle_each_way(won, placed, sp, fraction).alias("pl_each_way")))


def _badges() -> Column:
    """The five flags of a runner, in their order; the pressure of the race stands for its risk of collapse."""
    place = (F.col("draw") - 1) / (F.col("field_size") - 1)
    rules = [
        ("HIGH_VALUE", F.col("edge") > 0.05),
        ("LOW_CONFIDENCE", F.col("confidence") < 0.4),
        ("HIGH_EVIDENCE", F.col("evidence_density_score") > 0.7),
        ("PACE_RISK", F.col("collapse_risk") > 0.4),
        ("DRAW_RISK", (F.col("field_size") >= 12) & ((place <= 0.15) | (place >= 1 - 0.15))),
    ]
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules]))


@query(f"""with e as ({{evidence}}), s as ({{shape}}), v as (with {RUNNERS_SQL}, {_EDGES} select runner_id, edge, p_win, draw, field_size, (draw - 1)::double / nullif(field_size - 1, 0) as place from edged)
select runner_id, concat_ws(',', case when edge > 0.05::double then 'HIGH_VALUE' end, case when round(2 * p_win, 9) < 0.4::double then 'LOW_CONFIDENCE' end, case when evidence_density_score > 0.7::double then 'HIGH_EVIDENCE' end,
  case when collapse_risk > 0.4::double then 'PACE_RISK' end, case when field_size >= 12 and (place <= 0.15::double or place >= 1 - 0.15::double) then 'DRAW_RISK' end) as badges
from v join e using (runner_id) join s using (runner_id)""".format(evidence=ORACLE_SQL["evidence_density"], shape=ORACLE_SQL["race_shape"]))
def badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twice the win probability stands for the confidence until a model gives one."""
    rows = field.with_pressure(_valued(spark, sf_dir)).withColumns({"confidence": F.round(2 * F.col("p_win"), 9), "collapse_risk": F.round(field.collapse_risk(), 9)})
    known = with_evidence(rows, "edge", "confidence", "collapse_risk", "draw").withColumn("evidence_density_score", history.evidence_columns()["evidence_density_score"])
    return known.select("runner_id", F.array_join(_badges(), ",").alias("badges"))


@query(f"with {RUNNERS_SQL}, {_EDGES} select runner_id, edge, p_win from edged where edge is not null order by edge desc, runner_id limit 10")
def value_scanner_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir).filter("edge is not null")
    return tidy(rows.orderBy(F.desc("edge"), "runner_id").limit(10).select("runner_id", "edge", "p_win"))


_SCORES = [("purchase", 4), ("click", 1), ("view", 0)]


@query("""select user_id, count(*) filter (event_type in ('purchase', 'click', 'view')) as mapped, sum(case event_type when 'purchase' then 4 when 'click' then 1 when 'view' then 0 end)::bigint as score,
  bool_or(event_type = 'purchase') as any_purchase, coalesce(string_agg(distinct event_type, ',' order by event_type) filter (event_type not in ('purchase', 'click', 'view')), '') as unmapped from events group by 1""")
def behaviour_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags become scores; the sum is null without a mapped tag, and other tags are listed."""
    tag = F.col("event_type")
    points = F.when(tag == _SCORES[0][0], _SCORES[0][1])
    for name, score in _SCORES[1:]:
        points = points.when(tag == name, score)
    known = tag.isin([n for n, _ in _SCORES])
    return racing.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(known).alias("mapped"), F.sum(points).alias("score"), F.bool_or(tag == "purchase").alias("any_purchase"), F.array_join(F.sort_array(F.collect_set(F.when(~known, tag))), ",").alias("unmapped"))


_NUMERIC = ["official_rating", "sp_decimal", "weight_lbs"]


@query(f"with {RUNNERS_SQL}, b as (select " + ", ".join(f"quantile_cont({c}::double, 0.05) as {c}_lo, quantile_cont({c}::double, 0.95) as {c}_hi" for c in _NUMERIC) + " from runners) select runner_id, round((" + " + ".join(f"coalesce(({c} < {c}_lo or {c} > {c}_hi)::int, 0)" for c in _NUMERIC) + f") / {len(_NUMERIC)}::double, 9) as extreme_fraction from runners, b")
def ood_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a runner's numbers outside the 5 to 95 percent band of all runners."""
    rows = racing.runners(spark, sf_dir)
    return tidy(rows.select("runner_id", models.extreme_fraction(_NUMERIC, models.training_bands(rows, _NUMERIC)).alias("extreme_fraction")))


@query(f"with {RUNNERS_SQL}, m as (select " + ", ".join(f"median({c}::double) as {c}_m" for c in _NUMERIC) + " from runners) select runner_id, " + ", ".join(f"round(coalesce({c}, {c}_m)::double, 9) as {c}, ({c} is null)::bigint as {c}__isnan" for c in _NUMERIC) + " from runners, m")
def impute_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians for missing numbers, and indicators of where they were missing."""
    rows = racing.runners(spark, sf_dir)
    middle = quantile_values(rows, _NUMERIC, [0.5])
    return tidy(rows.select("runner_id", *[x for c in _NUMERIC for x in (F.coalesce(F.col(c).cast("double"), F.lit(middle.get((c, 0.5)))).alias(c), F.col(c).isNull().cast("int").alias(f"{c}__isnan"))]))


def _part(x: str, test: str) -> str:
    return f"round(count(*) filter ({x} {test})::double / nullif(count({x}), 0), 9)"


@query(f"""with {RUNNERS_SQL},
s as (select runner_id, horse_id, race_ts, race_id, """ + ", ".join(f"case when field_size > 1 then (field_size - {e})::double / (field_size - 1) end as {n}" for n, e in (("p3", "(1 + (draw * 3 + 3) % field_size)"), ("p2", "(1 + (draw * 3 + 2) % field_size)"), ("p1", "(1 + (draw * 3 + 1) % field_size)"), ("pf", "finishing_position"))) + f""" from runners),
h as (select r.runner_id, s.race_id, s.p3, s.p2 - s.p3 as a, s.p1 - s.p2 as b, s.p1 - s.p3 as t, s.pf - s.p1 as l from s r left join s on s.horse_id = r.horse_id and s.race_ts < r.race_ts)
select runner_id, (count(race_id) >= 2)::bigint as pace_features_available, round(avg(p3), 9) as avg_early_position_percentile, case when count(p3) >= 2 then round(stddev_pop(p3), 9) end as early_position_consistency,
  {_part("p3", ">= 0.85")} as prob_competing_for_lead, {_part("p3", "<= 0.3")} as slow_start_frequency, {_part("p3", ">= 0.7")} as fast_start_frequency,
  round(avg(a), 9) as transition_change_3f_to_2f, round(avg(b), 9) as transition_change_2f_to_1f, round(avg(t), 9) as avg_transition_gain,
  {_part("t", "> 0.02")} as pct_gaining_in_transition, {_part("t", "< -0.02")} as pct_losing_in_transition, round(avg(l), 9) as late_position_change_1f_to_finish,
  {_part("l", "< -0.02")} as late_fade_frequency, {_part("l", "> 0.02")} as late_gain_frequency from h group by 1""")
def pace_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(careers.pace(racing.with_positions(racing.runners(spark, sf_dir))))


@query(f"""with {RUNNERS_SQL}, {_EDGES}, t as (select won from edged qualify row_number() over (partition by race_id order by p_win desc, runner_id) = 1)
select count(*) as races, sum(won)::bigint as wins, round(avg(won), 9) as strike_rate from t""")
def top_pick_strike_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(evaluation.top_pick(_valued(spark, sf_dir), "p_win", "won"))


_CLIP = "least(greatest({0}, 1e-6::double), 1 - 1e-6::double)"


@query(f"""with {RUNNERS_SQL}, {_MARKET}, b as (select coalesce((finishing_position = 1)::int, 0) as y, p_market as q, round(greatest(model_score, 1e-6::double) / sum(greatest(model_score, 1e-6::double)) over (partition by race_id), 9) as p from market),
m as (select count(*) as n, round(avg((p - y) ** 2), 9) as brier_model, round(avg((q - y) ** 2), 9) as brier_market,
  round(avg(-(y * ln({_CLIP.format("p")}) + (1 - y) * ln(1 - {_CLIP.format("p")}))), 9) as log_loss_model, round(avg(-(y * ln({_CLIP.format("q")}) + (1 - y) * ln(1 - {_CLIP.format("q")}))), 9) as log_loss_market from b where q is not null)
select *, brier_model < brier_market as beats_brier, log_loss_model < log_loss_market as beats_log_loss from m""")
def market_vs_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = field.market_normalised(field.win_normalised(racing.runners(spark, sf_dir))).withColumn("won", F.coalesce((F.col("finishing_position") == 1).cast("int"), F.lit(0)))
    return tidy(evaluation.against_market(rows, "p_win", "p_market", "won"))


@query(f"""with {RACES_SQL}
select coalesce(race_class::varchar, 'none') as race_class, flat_jumps, count(*) as races, count(distinct course) as courses, round(100.0::double * count(*) filter (going is null) / count(*), 9) as going_missing_pct, round(avg(distance_f), 9) as mean_distance from races group by 1, 2""")
def class_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = racing.races(spark, sf_dir)
    out = rows.groupBy(F.coalesce(F.col("race_class").cast("string"), F.lit("none")).alias("race_class"), "flat_jumps")
    return tidy(out.agg(F.count(F.lit(1)).alias("races"), F.countDistinct("course").alias("courses"), (100.0 * F.count_if(F.col("going").isNull()) / F.count(F.lit(1))).alias("going_missing_pct"), F.avg("distance_f").alias("mean_distance")))


from furlong.plans import betting, imports, modelling, readers, sources, storage, training, views  # noqa: E402,F401  register their queries, too
