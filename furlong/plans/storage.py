"""Queries over tables that are written first (databases, merged results, provenance logs) and of joined, filled and aligned ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.operators import frames, provenance, results, sectionals, wide_rows
from furlong.plans.registry import RACES_SQL, RUNNERS_SQL, query, tidy
from furlong.sources import racing, sqlite
from furlong.sources.shared import Files, fresh_path, stored

_RACE_COLUMNS = ["id", "date", "racecourse", "distanceFurlongs", "going", "flatJumps", "raceClass", "numberOfRunners"]


def _race_table(races: DataFrame) -> DataFrame:
    return races.select(F.col("race_id").cast("string").alias("id"), F.col("race_ts").alias("date"), F.col("course").alias("racecourse"), F.col("distance_f").alias("distanceFurlongs"), "going", F.col("flat_jumps").alias("flatJumps"), F.col("race_class").alias("raceClass"))


@query(f"with {RACES_SQL} select race_id::varchar as id, course as racecourse, race_class::bigint as race_class, epoch_us(race_ts) as race_us from races where race_class in (1, 3) and course >= 'G' and going is not null and distance_f > 7.5::double")
def sqlite_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races out of a folder of databases, those that SQLite lets through by class, course, going and distance."""
    path = fresh_path(spark, "races-sqlite")
    sqlite.save(_race_table(racing.races(spark, sf_dir)), path, "Race")
    out = sqlite.scan(spark, path, "Race", ["id", "racecourse", "raceClass", "date"], [("raceClass", "in", [1, 3]), ("racecourse", ">=", "G"), ("going", "is not", None), ("distanceFurlongs", ">", 7.5)])
    return out.select("id", "racecourse", F.col("raceClass").alias("race_class"), F.unix_micros("date").alias("race_us"))


@query(f"""with {RUNNERS_SQL} select runner_id::varchar as id, race_id::varchar as race_id, horse_id::varchar as horse_id, epoch_us(race_ts) as race_us, course, distance_f, going, flat_jumps, race_class::bigint as race_class, field_size::bigint as n_runners,
  case when field_size <= 8 then 'SMALL' when field_size <= 14 then 'MEDIUM' else 'LARGE' end as band, 'T' || trainer_id as trainer, 'J' || jockey_id as jockey, draw::bigint as draw, weight_lbs::bigint as weight, official_rating::bigint as rating, headgear, finishing_position::bigint as position from runners""")
def sqlite_global_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs with their races and results, from a racing database whose tables are read once."""
    path, held = fresh_path(spark, "racing-sqlite"), fresh_path(spark, "racing-held")
    kept = fresh_path(spark, "racing-rows")
    racing.runners(spark, sf_dir).select("runner_id", "race_id", "horse_id", "trainer_id", "jockey_id", "draw", "weight_lbs", "official_rating", "headgear", "non_runner", "finishing_position", "field_size").write.parquet(kept)
    rows = spark.read.parquet(kept)
    size = rows.select(F.col("race_id").cast("string").alias("id"), F.col("field_size").alias("numberOfRunners")).distinct()
    sqlite.save(_race_table(racing.races(spark, sf_dir)).join(size, "id", "left").select(*_RACE_COLUMNS), f"{path}/Race", "Race")
    own = {"id": F.col("runner_id").cast("string"), "raceId": F.col("race_id").cast("string"), "horseId": F.col("horse_id").cast("string"), "trainerName": F.concat(F.lit("T"), "trainer_id"), "jockeyName": F.concat(F.lit("J"), "jockey_id"), "draw": F.col("draw"), "weightLbsTotal": F.col("weight_lbs"), "officialRating": F.col("official_rating"), "headgear": F.col("headgear"), "nonRunner": F.col("non_runner")}
    sqlite.save(rows.select(*[c.alias(k) for k, c in own.items()]), f"{path}/Runner", "Runner")
    sqlite.save(rows.filter("finishing_position is not null").select(own["id"].alias("runnerId"), F.col("finishing_position").alias("finishingPosition")), f"{path}/ResultEntry", "ResultEntry")
    Files(spark, kept).delete("")
    runs = sqlite.RacingData(spark, path, held, hold_sources=False).global_runs
    Files(spark, path).delete("")  # the runs are held
    names = ["id", "race_id", "horse_id", "race_us", "course", "distance_f", "going", "flat_jumps", "race_class", "n_runners", "band", "trainer", "jockey", "draw", "weight", "rating", "headgear", "position"]
    return tidy(runs.withColumn("raceDate", F.unix_micros("raceDate")).toDF(*names))


_BATCH = "runner_id % 5 = 0"


def _outcomes(rows: DataFrame) -> DataFrame:
    """What was submitted after the races: places, some withdrawn, some prices missing."""
    status = F.when(F.col("finishing_position").isNull(), "PU").otherwise(" ")
    price = F.when(F.col("runner_id") % 3 == 0, F.col("sp_decimal"))
    return rows.select("runner_id", "finishing_position", status.alias("finish_status"), price.alias("starting_price"), F.lit(None).cast("double").alias("closing_price"))


def _known(rows: DataFrame) -> DataFrame:
    n = F.col("field_size")
    return rows.select("runner_id", "race_id", "race_ts", F.when(F.col("runner_id") % 2 == 0, F.col("sp_decimal")).alias("current_price"), F.when(n >= 8, 3).when(n >= 5, 2).alias("places"), F.lit(0.2).alias("place_fraction"))


_SETTLED = """case when position is null and status is null and price is null then null else 1 end is not null as said, case when places is not null then coalesce(position between 1 and places, false) end as place_outcome,
  case when price is not null then case when position = 1 then price - 1 else -1 end end as pl_win, case when price is not null and places is not null then round(case when position = 1 then price - 1 else -1 end + case when position <= places then (price - 1) * 0.2::double else -1 end, 9) end as pl_each_way"""


@query(f"""with {RUNNERS_SQL}, t as (select *, case when field_size >= 8 then 3 when field_size >= 5 then 2 end as places, case when finishing_position is null then 'PU' end as st, coalesce(case when runner_id % 3 = 0 then sp_decimal end, case when runner_id % 2 = 0 then sp_decimal end) as pr from runners),
first as (select runner_id, race_id, race_ts, finishing_position as position, st as status, pr as price, places from t where runner_id % 7 <> 0),
late as (select runner_id, race_id, race_ts, case when {_BATCH} and finishing_position = 1 then 2 when finishing_position = 2 then 1 else finishing_position end as position, st as status, pr as price, places from t where {_BATCH}),
f as (select *, {_SETTLED} from first), l as (select *, {_SETTLED} from late)
select coalesce(l.runner_id, f.runner_id) as runner_id, coalesce(l.race_id, f.race_id) as race_id, strftime(coalesce(l.race_ts, f.race_ts), '%Y-%m') as race_month, coalesce(l.position, f.position)::bigint as finishing_position, coalesce(l.status, f.status) as finish_status, round(coalesce(l.price, f.price), 9) as starting_price,
  coalesce(l.place_outcome, f.place_outcome) as place_outcome, round(coalesce(l.pl_win, f.pl_win), 9) as pl_win, round(coalesce(l.pl_each_way, f.pl_each_way), 9) as pl_each_way, 'CONFIRMED' as result_status
from (select * from f where said) f full join (select * from l where said) l on f.runner_id = l.runner_id""")
def written_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results table after two batches: most outcomes, then corrections of first and second places for a fifth of the runners, new ones among them."""
    path = fresh_path(spark, "results")
    rows = stored(racing.runners(spark, sf_dir).select("runner_id", "race_id", "race_ts", "finishing_position", "sp_decimal", "field_size"), "runners")
    known = _known(rows)
    first = results.settled(_outcomes(rows.filter("runner_id % 7 <> 0")), known)
    swapped = F.when(F.col("finishing_position") == 1, 2).when(F.col("finishing_position") == 2, 1).otherwise(F.col("finishing_position"))
    late = results.settled(_outcomes(rows.filter(_BATCH).withColumn("finishing_position", swapped)), known)
    results.write_results(path, first, "first")
    results.write_results(path, late, "late")
    results.write_results(path, late, "late")  # changes nothing
    out = spark.read.schema(first.schema).parquet(f"{path}/results")
    names = [c for c in first.columns if c not in ("race_ts", "closing_price")]
    return tidy(out.select(*names))


@query("""with o as (select user_id, event_type, event_id, props::json->>'$.k' as k, ts, row_number() over (partition by user_id order by event_id desc) as n from events),
l as (select user_id, event_id, case when event_type in ('click', 'view') then event_type end as tag, case when event_id % 3 = 0 then 'note ' || event_id end as note from o where n = 1),
e as (select user_id, tag, null as note from l where tag is not null union all select user_id, null, note from l where note is not null)
select user_id as runner_id, tag, note from e union all select user_id, null, null from l where tag is null and note is null""")
def written_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags and notes after two batches: each runner's last ones stand in place of those before."""
    e = racing.table(spark, sf_dir, "events")
    last = F.max("event_id").over(Window.partitionBy("user_id"))
    rows = e.select(F.lit("all").alias(results.MONTH), F.col("user_id").alias("runner_id"), F.array("event_type", "event_type").alias("tags"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("note "), "event_id")).otherwise("  ").alias("note"), (F.col("event_id") == last).alias("is_last"))
    path = fresh_path(spark, "observations")
    results.write_observations(path, rows.filter("not is_last").drop("is_last"), ["click", "view"], "before")
    results.write_observations(path, rows.filter("is_last").drop("is_last"), ["click", "view"], "last")
    return spark.read.parquet(f"{path}/observations").select("runner_id", "tag", "note")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in two batches: each event says something of a race, by a provider of its type; every fourth event is recorded again later."""
    e = racing.table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("race_id"), "event_type", (F.col("event_id") % 3).alias("version"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    make = lambda rows: provenance.entries(rows, "Race", "race_id", F.col("event_type"), F.col("ts"), ["race_id", "version"])
    path = fresh_path(spark, "provenance")
    provenance.record(path, make(e), "1")
    provenance.record(path, make(e.filter("event_id % 4 = 0").withColumn("ts", F.expr("ts + interval 1 day"))), "2")
    provenance.record(path, make(e), "2")  # is there already
    return spark.read.parquet(path)


_LOG_SQL = """s as (select user_id % 200 as race_id, event_type as provider, event_id % 3 as version, ts, event_id from events),
u as (select race_id, provider, version, ts, 1 as batch from s union select race_id, provider, version, ts + interval 1 day, 2 from s where event_id % 4 = 0),
k as (select race_id, provider, version, sha256('{"race_id":' || race_id || ',"version":' || version || '}') as payload_hash, min(epoch_us(ts)) as first_us, max(epoch_us(ts)) as last_us, count(*) as times, count(distinct batch) as batches from u group by 1, 2, 3)"""


@query(f"with {_LOG_SQL} select race_id::varchar as race_id, provider, payload_hash, first_us, last_us, times, batches, count(*) over (partition by race_id, provider) as versions, row_number() over (partition by race_id, provider order by last_us desc, payload_hash desc) = 1 as current from k")
def provenance_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each provider said of each race: when first and last, how often, and which of it stands."""
    out = provenance.folded(_log(spark, sf_dir))
    return out.select(F.col("entity_id").alias("race_id"), "provider", "payload_hash", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"), "times", "batches", "versions", "current")


@query("with r as (select distinct user_id % 200 as race_id from events), w as (select race_id from r union select range + 190 from range(20)) select w.race_id as race_id, coalesce((select string_agg(distinct event_type, ',' order by event_type) from events where user_id % 200 = w.race_id and event_type <> 'view'), 'legacy-seed-or-generator') as providers from w")
def race_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who gave the records of each race; a label stands for races without provenance."""
    log = _log(spark, sf_dir).filter("provider <> 'view'")
    ids = racing.table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("race_id")).union(spark.range(190, 210)).distinct()
    return provenance.providers(ids, log).select("race_id", F.array_join("providers", ",").alias("providers"))


@query(f"""with {RUNNERS_SQL} select 'E' || race_id as event_ref, runner_id, horse_id as horse, r.course as course, 'F' || race_class as race_class, race_id % 1000 as code_race, jockey_id as code_runner from runners r where race_id % 11 <> 0""")
def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset's race and runner tables joined by the columns that hold the races' ids, found among decoys by their values."""
    races = stored(racing.races(spark, sf_dir).select("race_id", "race_ts", "course", "race_class"), "races")  # the sketches, the count and the join read both tables
    rows = racing.entries(spark, sf_dir).join(races.select("race_id"), "race_id").filter("race_id % 11 <> 0 or race_id % 121 = 0")
    rows = stored(rows.select("race_id", "runner_id", "horse_id", "trainer_id", "jockey_id"), "runners")
    left = races.filter("race_id % 11 <> 0").select((F.col("race_id") % 1000).alias("code"), F.concat(F.lit("E"), "race_id").alias("meeting_ref"), "course", F.concat(F.lit("F"), "race_class").alias("race_class"), F.col("race_ts").alias("race_date"))
    right = rows.select("runner_id", F.col("jockey_id").alias("code"), F.concat(F.lit("E"), "race_id").alias("event_ref"), F.col("horse_id").alias("horse"), F.col("trainer_id").alias("trainer"))
    out = wide_rows.wide_rows({"meetings": left, "entries": right})
    return out.select("event_ref", "runner_id", "horse", "course", "race_class", F.col("code_race").alias("code_race"), "code_runner")


_POINTS_SQL = f"""{RUNNERS_SQL}, p as (select runner_id, s.range as seg, 1 + s.range % 2 as d, 12.0::double + ((runner_id + s.range * 3) % 10)::double / 4 as t, c.range as copy from runners, range(7) s, range(2) c
  where (runner_id * 7 + s.range * 3) % 5 <> 0 and (c.range = 0 or runner_id % 11 = 0)),
q as (select runner_id, seg, d, case when copy = 1 then t + 1 else t end as t, case when runner_id % 2 = 0 then 20.0::double * (seg + 1) end as clock, copy from p),
one as (select * from q qualify row_number() over (partition by runner_id, seg order by copy desc) = 1),
n as (select *, lead(seg) over w as nseg, lead(t) over w as nt, lead(d) over w as nd, lead(clock) over w as nclock from one window w as (partition by runner_id order by seg)),
g as (select runner_id, i.range as seg, d, case when nclock - nt - clock > 0 then (nclock - nt - clock) / (nseg - seg - 1) else (t / d + (i.range - seg)::double / (nseg - seg) * (nt / nd - t / d)) * d end as t from n, range(7) i where i.range > seg and i.range < nseg)"""


#: Lines whose points (seven or more each) one task puts in order.
_POINT_LINES = 100_000


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to seven segments of each runner, some missing, some said twice, a clock for every other runner."""
    r, s = F.col("runner_id"), F.col("segment_index")
    rows = racing.runners(spark, sf_dir).select("runner_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("segment_index")).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(1))))
    rows = rows.filter(((r * 7 + s * 3) % 5 != 0) & ((F.col("copy") == 0) | (r % 11 == 0)))
    seconds = F.lit(12.0) + ((r + s * 3) % 10).cast("double") / 4
    return rows.select("runner_id", "segment_index", (1 + s % 2).cast("double").alias("distance_f"), F.when(F.col("copy") == 1, seconds + 1).otherwise(seconds).alias("seconds"), F.lit(None).cast("double").alias("speed_mps"), F.lit(None).cast("int").alias("position_in_race"),
                       F.when(r % 2 == 0, F.lit(20.0) * (s + 1)).alias("clock"), F.concat(F.lit("gps"), "copy").alias("source"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("copy")).alias("recorded_at"))


@query(f"with {_POINTS_SQL} select runner_id, seg as segment_index, d::double as distance_f, round(t, 9) as seconds, false as filled from one union all select runner_id, seg, d::double, round(t, 9), true from g")
def filled_sectionals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each runner's segments without gaps: the latest point of each, missing ones from the race's clock or their neighbours' pace."""
    return tidy(sectionals.whole_sequences(_points(spark, sf_dir), racing.parts(spark, sf_dir, each=_POINT_LINES)))


@query(f"""with {_POINTS_SQL}, w as (select runner_id, seg, d, t, false as f from one union all select runner_id, seg, d, t, true from g),
a as (select runner_id, count(*) as segments, count(*) filter (f) as filled, sum(t) as seconds, sum(d)::double as d, arg_max(t, seg) as lt, arg_max(d, seg) as ld from w group by 1)
select runner_id, segments, filled, round(seconds, 9) as seconds, round(d * 201.168::double / seconds, 9) as mean_mps, round(100 * (ld * 201.168::double / lt) / (d * 201.168::double / seconds), 9) as finishing_speed_pct from a""")
def sectional_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each runner's total time, mean speed and finishing speed over its filled segments."""
    return tidy(sectionals.summaries(sectionals.whole_sequences(_points(spark, sf_dir), racing.parts(spark, sf_dir, each=_POINT_LINES))))


@query("""with l as (select event_id as place, user_id % 400 as horse, event_type from events), o as (select user_id % 400 as horse, arg_min(round(1 + value, 6), event_id) as odds from events where event_type = 'click' group by 1),
r as (select c_custkey as horse, case when c_custkey % 3 = 0 then c_nationkey end as position, case when c_custkey % 5 = 0 then c_acctbal end as sp from customer where c_custkey < 300)
select place, l.horse as horse, odds, odds is not null as has_odds, position::bigint as position, round(sp, 6) as sp, position is not null or sp is not null as has_results, row_number() over (partition by l.horse order by place) = 1 as first from l left join o on o.horse = l.horse left join r on r.horse = l.horse""")
def aligned_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in their order, repeats among them, with odds and results by key beside them and the first of each key marked."""
    e, c = racing.table(spark, sf_dir, "events").withColumn("horse", F.col("user_id") % 400), F.col("c_custkey")
    left = e.select(F.col("event_id").alias("place"), "horse")
    odds = e.filter("event_type = 'click'").select("horse", F.col("event_id").alias("place"), F.round(1 + F.col("value"), 6).alias("odds"))
    results_of = racing.table(spark, sf_dir, "customer").filter("c_custkey < 300").select(c.alias("horse"), c.alias("place"), F.when(c % 3 == 0, F.col("c_nationkey")).alias("position"), F.when(c % 5 == 0, F.round("c_acctbal", 6)).alias("sp"))
    out = frames.aligned(left, "horse", {"odds": (odds, ["odds"]), "results": (results_of, ["position", "sp"])})
    return tidy(frames.marked_first(out, "horse"))
