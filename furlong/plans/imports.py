"""Queries of readers and imports; what they read is derived from the tables, as the text that a file would hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.operators import ingest
from furlong.plans.registry import RACES_SQL, RUNNERS_SQL, query, tidy
from furlong.sources import files, racing
from furlong.sources.shared import stored

_RAW_SQL = RUNNERS_SQL + """,
raw as (select runner_id, case when runner_id % 17 = 0 then '01/02/1995' when runner_id % 19 = 0 then '' else strftime(race_ts, '%Y-%m-%d') end as race_date,
  case when runner_id % 23 <> 0 then course end as racecourse, 'Horse ' || horse_id as horse_name, case when runner_id % 13 = 0 then 'ten' when runner_id % 2 = 0 then ' ' || weight_lbs || '.0' else weight_lbs::varchar end as weight_lbs_total,
  case when non_runner then 'Yes' else 'no' end as non_runner, case when runner_id % 5 <> 0 then flat_jumps else '' end as flat_jumps, race_id from runners),
card as (select *, race_date <> '' and race_date like '____-%' as dated from raw),
judged as (select *, concat_ws('; ', case when race_date = '' then 'race_date is missing' end, case when racecourse is null then 'racecourse is missing' end, case when race_date <> '' and not dated then 'race_date is no ISO date' end, case when weight_lbs_total = 'ten' then 'weight_lbs_total is no number' end) as errors from card)"""


def _raw_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card in text, with dates, numbers and cells gone wrong here and there."""
    i = F.col("runner_id")
    date = F.when(i % 17 == 0, "01/02/1995").when(i % 19 == 0, "").otherwise(F.date_format("race_ts", "yyyy-MM-dd"))
    weight = F.when(i % 13 == 0, "ten").when(i % 2 == 0, F.concat(F.lit(" "), F.col("weight_lbs"), F.lit(".0"))).otherwise(F.col("weight_lbs").cast("string"))
    return racing.runners(spark, sf_dir).select("runner_id", "race_id", date.alias("race_date"), F.when(i % 23 != 0, F.col("course")).alias("racecourse"), F.concat(F.lit("Horse "), "horse_id").alias("horse_name"), weight.alias("weight_lbs_total"), F.when(F.col("non_runner"), "Yes").otherwise("no").alias("non_runner"), F.when(i % 5 != 0, F.col("flat_jumps")).otherwise("").alias("flat_jumps"))


@query(f"""with {_RAW_SQL} select runner_id, case when dated then race_date end as day, racecourse, try_cast(weight_lbs_total as double)::bigint as weight, non_runner = 'Yes' as non_runner, case when flat_jumps = '' then 'FLAT' else flat_jumps end as code, 'TURF' as surface, errors from judged""")
def racecard_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card's cells typed, with defaults, and each row's errors."""
    rows = files.typed_card(_raw_card(spark, sf_dir))
    return rows.select("runner_id", F.date_format("race_date", "yyyy-MM-dd").alias("day"), "racecourse", F.col("weight_lbs_total").alias("weight"), "non_runner", F.col("flat_jumps").alias("code"), "surface", F.array_join("errors", "; ").alias("errors"))


@query(f"""with {_RAW_SQL} select racecourse, count(*) as read, count(*) filter (errors = '') as created, count(*) filter (errors <> '') as failed, case when count(*) filter (errors <> '') = 0 then 'SUCCESS' when count(*) filter (errors = '') > 0 then 'PARTIAL' else 'FAILED' end as status from judged group by 1""")
def import_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each course: rows read, created and failed, and how it ended."""
    rows = files.typed_card(_raw_card(spark, sf_dir)).withColumn("bad", F.size("errors") > 0)
    out = rows.groupBy("racecourse").agg(F.count(F.lit(1)).alias("read"), F.count_if(~F.col("bad")).alias("created"), F.count_if("bad").alias("failed"))
    return out.withColumn("status", ingest.batch_status(F.col("created"), F.col("failed")))


@query(f"""with {_RAW_SQL}, v as (select *, race_date || '|' || racecourse as k from judged where errors = '')
select k as race_key, arg_min(case when flat_jumps = '' then 'FLAT' else flat_jumps end, runner_id) as code, min(runner_id) as first_runner, count(*) as n_runners, string_agg(horse_name, ',' order by runner_id) as horses from v group by 1""")
def grouped_racecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows grouped into races by day and course, wherever they stand; race columns come from the first row."""
    valid, _ = ingest.split_valid(files.typed_card(_raw_card(spark, sf_dir)))
    rows = valid.withColumn("race_key", F.concat_ws("|", F.date_format("race_date", "yyyy-MM-dd"), "racecourse"))
    out = ingest.grouped_races(rows, ["race_key"], ["flat_jumps"], ["horse_name"], "runner_id")
    return out.select("race_key", F.col("flat_jumps").alias("code"), F.col("runners")[0]["runner_id"].alias("first_runner"), F.col("n_runners").cast("long").alias("n_runners"), F.array_join(F.transform("runners", lambda r: r["horse_name"]), ",").alias("horses"))


@query(f"""with {RACES_SQL} select race_id, coalesce(case when race_id % 3 = 0 then 'P' || race_id end, sha256(strftime(race_ts, '%Y-%m-%d') || '|' || course || '|' || race_id)) as race_key,
  sha256('{{"course":"' || course || '","going":' || coalesce('"' || going || '"', 'null') || ',"race_id":' || race_id || '}}') as payload from races""")
def race_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of races, the provider's or a hash, and hashes of their payloads."""
    rows = racing.races(spark, sf_dir)
    provider = F.when(F.col("race_id") % 3 == 0, F.concat(F.lit("P"), "race_id")).otherwise(" ")
    return rows.select("race_id", ingest.race_key(provider, F.date_format("race_ts", "yyyy-MM-dd"), F.col("course"), F.col("race_id")).alias("race_key"), ingest.payload_hash(["race_id", "course", "going"]).alias("payload"))


@query("""with m as (select event_id, user_id % 40 as market, ts, value, event_type, event_id % 13 = 0 as broken from events where event_id % 29 <> 0 and event_type in ('signup', 'click', 'view', 'purchase')),
n as (select *, last_value(case when event_type = 'signup' then 'S' || event_id end ignore nulls) over (partition by market order by epoch_us(ts) // 1000, event_id rows unbounded preceding) as name from m where not broken)
select market::varchar as market, epoch_us(ts) // 1000 as tick_ms, case event_type when 'click' then round(1 + value, 6) when 'view' then round(2 + value, 6) when 'purchase' then round(3 + value, 6) end as price, name from n where event_type <> 'signup'""")
def exchange_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices out of an exchange's message lines, malformed and blank ones among them; names come from the market's latest definition."""
    messages, _ = files.exchange_messages(_lines(spark, sf_dir))
    out = files.exchange_prices(messages, "event_id")
    return tidy(out.select("market", F.unix_millis("tick_ts").alias("tick_ms"), F.round("price", 6).alias("price"), "name"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of four types as message lines: sign-ups define the market's one selection, the others move its last, back or lay price."""
    e = racing.table(spark, sf_dir, "events")
    v = lambda add: F.format_string("%.9f", F.col("value") + add)
    change = F.when(F.col("event_type") == "click", F.concat(F.lit('"ltp":'), v(1))).when(F.col("event_type") == "view", F.concat(F.lit('"batb":[[0,'), v(2), F.lit(",5]]"))).when(F.col("event_type") == "purchase", F.concat(F.lit('"batl":[[0,'), v(3), F.lit(",5]]")))
    body = F.when(F.col("event_type") == "signup", F.concat(F.lit('"marketDefinition":{"runners":[{"id":7,"name":"S'), "event_id", F.lit('"}]}'))).otherwise(F.concat(F.lit('"rc":[{"id":7,'), change, F.lit("}]")))
    line = F.concat(F.lit('{"op":"mcm","pt":'), F.unix_millis(F.col("ts").cast("timestamp")), F.lit(',"mc":[{"id":"'), F.col("user_id") % 40, F.lit('",'), body, F.lit("}]}"))
    return e.select("event_id", F.when(F.col("event_id") % 29 == 0, " ").when(F.col("event_id") % 13 == 0, F.concat(F.lit("{oops"), line)).otherwise(line).alias("value"))


@query("select 'line ' || event_id as line, event_id from events where event_id % 13 = 0 and event_id % 29 <> 0 and event_type in ('signup', 'click', 'view', 'purchase')")
def exchange_poison_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that hold no message, kept apart."""
    _, bad = files.exchange_messages(_lines(spark, sf_dir))
    return bad.select(F.concat(F.lit("line "), "event_id").alias("line"), "event_id")


@query(f"""with {RUNNERS_SQL}, sp as (select distinct horse_id, cast(race_ts as date) as day from runners where horse_id % 4 <> 1 union select horse_id + 1000000000, cast(race_ts as date) from runners where horse_id % 9 = 0),
k as (select horse_id, cast(race_ts as date) as day, count(*) as n, min(runner_id) as runner_id from runners group by 1, 2)
select sp.horse_id || ' ' || strftime(sp.day, '%Y-%m-%d') as sp_row, case when n = 1 then runner_id end as runner_id, case when n is null then 'no match' when n > 1 then n || ' matches' end as reason from sp left join k on k.horse_id = sp.horse_id and k.day = sp.day""")
def sp_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starting prices matched by horse and day: one match is taken, none or several are reported."""
    runs, parts = stored(racing.runners(spark, sf_dir).select("runner_id", "horse_id", F.to_date("race_ts").alias("day")), "runs"), racing.parts(spark, sf_dir)
    rows = runs.filter("horse_id % 4 <> 1").select("horse_id", "day").union(runs.filter("horse_id % 9 = 0").select(F.col("horse_id") + 1000000000, "day")).repartition(parts, "horse_id", "day").distinct()
    rows = rows.withColumn("sp_row", F.concat_ws(" ", "horse_id", F.date_format("day", "yyyy-MM-dd")))
    return ingest.one_match(rows, runs.repartition(parts, "horse_id", "day"), ["horse_id", "day"], "sp_row", "runner_id")


@query(f"""with {RACES_SQL}, u as (select race_id, 'going' as field, going as value, race_ts from races union all select race_id, 'race_class', race_class::varchar, race_ts from races union all select race_id, 'flat_jumps', flat_jumps, race_ts from races)
select race_id, field, value, epoch_us(race_ts) as effective_us from u where value is not null""")
def field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of races as a log of changes."""
    out = ingest.changes(racing.races(spark, sf_dir), ["race_id"], ["going", "race_class", "flat_jumps"], "race_ts")
    return out.select("race_id", "field", "value", F.unix_micros("effective_at").alias("effective_us"))


_TERMS = "t as (select user_id % 50 as race_id, event_type as bookmaker, 2 + event_id % 4 as places, ts, event_id from events qualify row_number() over (partition by user_id % 50, event_type, ts order by event_id) = 1)"


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = racing.table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("race_id"), F.col("event_type").alias("bookmaker"), (2 + F.col("event_id") % 4).alias("places"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    return rows.groupBy("race_id", "bookmaker", "ts").agg(F.min_by("places", "event_id").alias("places"))


@query(f"with {_TERMS} select race_id, bookmaker, places, epoch_us(ts) as from_us, epoch_us(lead(ts) over (partition by race_id, bookmaker order by ts)) as to_us from t")
def terms_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place terms with when they were superseded."""
    out = ingest.superseded(_terms(spark, sf_dir), ["race_id", "bookmaker"], "ts")
    return out.select("race_id", "bookmaker", "places", F.unix_micros("ts").alias("from_us"), F.unix_micros("superseded_at").alias("to_us"))


@query(f"with {_TERMS} select race_id, bookmaker, arg_max(places, ts) as places, max(epoch_us(ts)) as from_us from t where ts <= timestamp '2024-01-15 12:00:00' group by 1, 2")
def place_terms_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place terms that held at a moment."""
    out = ingest.current_at(_terms(spark, sf_dir), ["race_id", "bookmaker"], "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return out.select("race_id", "bookmaker", "places", F.unix_micros("ts").alias("from_us"))


@query("""with n as (select distinct event_type as name from events union select distinct c_mktsegment from customer), h as (select distinct event_type as name, 'id-' || event_type as id from events where event_type < 'm')
select n.name as name, coalesce(id, sha256(n.name)) as id, id is null as created from n left join h on h.name = n.name""")
def bookmaker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with their ids, held ones and new ones."""
    events = racing.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))
    names = events.union(racing.table(spark, sf_dir, "customer").select("c_mktsegment"))
    held = events.filter("name < 'm'").distinct().withColumn("id", F.concat(F.lit("id-"), "name"))
    return ingest.ids_of(names, held, "name", "id")


_SOURCED = "s as (select *, case when race_id % 50 = 0 then 'SYNTHETIC' else 'REAL' end as source_type from races)"


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return racing.races(spark, sf_dir).withColumn("source_type", F.when(F.col("race_id") % 50 == 0, "SYNTHETIC").otherwise("REAL"))


@query(f"""with {RUNNERS_SQL}, {_SOURCED}, k as (select * from s where race_id % 4 <> 0), l as (select * from runners where race_id % 4 <> 0 or race_id is null)
select count(*) as races, min(epoch_us(race_ts)) as first_us, max(epoch_us(race_ts)) as last_us, case when count(distinct source_type) > 1 then 'MIXED' else min(source_type) end as source_type, (select count(*) from l) as runners, (select count(*) filter (official_rating is null) from l) as unrated, 5::bigint as missing,
  count(*) >= 10000 and (select count(*) from l) >= 100000 and count(distinct source_type) = 1 and min(source_type) = 'REAL' as ready, case when count(*) >= 100000 then 'PRODUCTION' when count(*) >= 25000 then 'ADVANCED' when count(*) >= 10000 then 'BASELINE' else 'DEMO' end as level from k""")
def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset version over three quarters of the races, with five ids that aren't there."""
    races = _sourced(spark, sf_dir)
    ids = races.filter("race_id % 4 <> 0").select("race_id").union(spark.range(5).select(-1 - F.col("id")))
    out = ingest.dataset_version(races, racing.runners(spark, sf_dir), ids)
    return out.select("races", F.unix_micros("first_race").alias("first_us"), F.unix_micros("last_race").alias("last_us"), "source_type", "runners", "unrated", "missing", "ready", "level")


@query(f"with {RACES_SQL} select race_id, course from races where not (race_id % 7 = 0 and race_id % 2 = 0)")
def unrestricted_races(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Races without a restricted provenance; those without any stay."""
    races = racing.races(spark, sf_dir)
    provenance = races.filter("race_id % 7 = 0").select("race_id", F.when(F.col("race_id") % 2 == 0, "RESTRICTED").otherwise("VERIFIED_OPEN").alias("status"))
    return ingest.without_restricted(races, provenance).select("race_id", "course")


@query("""with h as (select c_custkey as id, c_mktsegment as segment, c_nationkey::bigint as nation from customer where c_custkey % 3 <> 0), n as (select c_custkey as id, case when c_custkey % 2 = 0 then 'NEW' end as segment, 99::bigint as nation from customer where c_custkey % 5 <> 0)
select coalesce(h.id, n.id) as id, coalesce(n.segment, h.segment) as segment, coalesce(n.nation, h.nation) as nation from h full join n on h.id = n.id""")
def upserted_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles put in or over those held."""
    c = racing.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("long").alias("nation"))
    new = c.filter("id % 5 <> 0").select("id", F.when(F.col("id") % 2 == 0, "NEW").alias("segment"), F.lit(99).cast("long").alias("nation"))
    return ingest.upserted(c.filter("id % 3 <> 0"), new, ["id"])
