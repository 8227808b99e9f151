"""Queries that read files and streams: what they read is written first, by Spark, from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.plans.imports import _RAW_SQL, _lines, _raw_card
from furlong.plans.registry import ORACLE_SQL, RUNNERS_SQL, query, tidy
from furlong.sources import files, providers, racing
from furlong.sources.shared import fresh_path
from furlong.streaming.names import named_prices
from furlong.streaming.odds import idempotent_sink, once

_CARD = ["runner_id", "race_id", "race_date", "racecourse", "horse_name", "weight_lbs_total", "non_runner", "flat_jumps"]


@query(f"""with {_RAW_SQL} select runner_id::varchar as runner_id, case when dated then race_date end as day, racecourse, horse_name, try_cast(weight_lbs_total as double)::bigint as weight, non_runner = 'Yes' as non_runner, case when flat_jumps = '' then 'FLAT' else flat_jumps end as code, errors from judged""")
def card_from_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card out of compressed CSV files."""
    path = f"{fresh_path(spark, 'card')}.csv"
    _raw_card(spark, sf_dir).select(*_CARD).write.option("header", True).option("compression", "gzip").option("emptyValue", "").csv(path)
    rows = files.race_card(spark, path)
    return rows.select("runner_id", F.date_format("race_date", "yyyy-MM-dd").alias("day"), "racecourse", "horse_name", F.col("weight_lbs_total").alias("weight"), "non_runner", F.col("flat_jumps").alias("code"), F.array_join("errors", "; ").alias("errors"))


@query(f"""with {RUNNERS_SQL} select strftime(race_ts, '%Y-%m-%d') as day, course as racecourse, race_class::bigint as race_class, round(distance_f, 9) as distance, coalesce(going, '') as going, 'Horse ' || horse_id as horse_name, draw::bigint as draw, coalesce(finishing_position, -1)::bigint as position, non_runner, count(*) as n
from runners group by all""")
def card_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race card out of files with a race in every line, its runners within."""
    r = racing.runners(spark, sf_dir)
    runner = F.struct(F.concat(F.lit("Horse "), "horse_id").alias("horse_name"), F.col("draw").cast("string").alias("draw"), F.col("finishing_position").cast("string").alias("finishing_position"), F.col("non_runner").cast("string").alias("non_runner"), F.lit("x").alias("unknown"))
    races = r.groupBy("race_id", "race_ts", "course", "race_class", "distance_f", "going").agg(F.collect_list(runner).alias("runners"))
    path = f"{fresh_path(spark, 'card')}.jsonl"
    races.select(F.date_format("race_ts", "yyyy-MM-dd").alias("race_date"), F.col("course").alias("racecourse"), "race_class", F.col("distance_f").alias("distance_furlongs"), "going", "runners").write.json(path)
    out = files.race_card(spark, path)
    named = out.select(F.date_format("race_date", "yyyy-MM-dd").alias("day"), "racecourse", "race_class", F.col("distance_furlongs").alias("distance"), F.coalesce("going", F.lit("")).alias("going"), "horse_name", "draw", F.coalesce("finishing_position", F.lit(-1)).alias("position"), "non_runner")
    return tidy(named.groupBy(*named.columns).agg(F.count(F.lit(1)).alias("n")))


@query("""with s as (select event_id, strftime(ts, '%d-%m-%Y') as day, strftime(ts, '%Y-%m-%d') as iso, 'S' || user_id as name, (1 + event_id % 40)::varchar as price from events)
select event_id, case when event_id % 31 = 0 then event_id || ',' || day || ',' || name when event_id % 29 = 0 then event_id || ',' || iso || ',' || name || ',' || price when event_id % 23 = 0 then event_id || ',' || day || ',,' || price when event_id % 19 = 0 then event_id || ',' || day || ',' || name || ',none' else event_id || ',' || day || ',' || name || ',' || price end as raw,
  case when event_id % 31 = 0 then 'not as many cells as the header' when event_id % 29 = 0 then 'day is not DD-MM-YYYY' when event_id % 23 = 0 then 'name is missing' when event_id % 19 = 0 then 'price is no number' end as reason,
  case when event_id % 31 <> 0 and event_id % 29 <> 0 then iso end as day, case when event_id % 31 = 0 then name when event_id % 29 = 0 or event_id % 23 <> 0 then name end as selection, case when event_id % 31 = 0 then null when event_id % 29 = 0 or event_id % 23 = 0 or event_id % 19 <> 0 then price::double end as bsp from s""")
def starting_price_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of starting-price files, each with what is wrong with it."""
    e, i = racing.table(spark, sf_dir, "events"), F.col("event_id")
    day, iso, name, price = F.date_format("ts", "dd-MM-yyyy"), F.date_format("ts", "yyyy-MM-dd"), F.concat(F.lit("S"), "user_id"), (1 + i % 40).cast("string")
    line = lambda *cells: F.concat_ws(",", i.cast("string"), *cells)
    text = F.when(i % 31 == 0, line(day, name)).when(i % 29 == 0, line(iso, name, price)).when(i % 23 == 0, line(day, F.lit(""), price)).when(i % 19 == 0, line(day, name, F.lit("none"))).otherwise(line(day, name, price))
    path = fresh_path(spark, "prices")
    files.headed(e.select(text.alias("value")), "EVENT_ID,EVENT_DT,SELECTION_NAME,BSP").write.text(path)
    out = files.starting_price_rows(spark, path)
    number = F.split("raw", ",")[0].cast("long")
    broken = F.col("reason") == "not as many cells as the header"
    return out.select(number.alias("event_id"), "raw", "reason", F.when(~F.coalesce(broken, F.lit(False)), F.date_format("day", "yyyy-MM-dd")).alias("day"), "selection", "bsp")


@query(f"select market, tick_ms, price, name from ({ORACLE_SQL['exchange_ticks']})")
def streamed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices out of a stream of message lines, with names kept as each market's state."""
    path, lines = fresh_path(spark, "lines"), _lines(spark, sf_dir)
    lines.write.parquet(f"{path}/in")
    messages, _ = files.exchange_messages(spark.readStream.schema(lines.schema).parquet(f"{path}/in"))
    q = named_prices(messages, "event_id").writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return tidy(spark.read.parquet(f"{path}/out").select("market", F.col("pt").alias("tick_ms"), F.round("price", 6).alias("price"), "name"))


@query("select event_id, user_id, round(value, 9) as value from events")
def streamed_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every fifth event comes again, each kept once by a sink that can be run again."""
    path, e = fresh_path(spark, "stream"), racing.table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.col("ts").cast("timestamp").alias("tick_ts"))
    again = e.filter("event_id % 5 = 0").withColumn("tick_ts", F.expr("tick_ts + interval 10 minutes"))
    e.unionByName(again).write.parquet(f"{path}/in")
    rows = once(spark.readStream.schema(e.schema).parquet(f"{path}/in"), ["event_id"])
    q = rows.writeStream.foreachBatch(idempotent_sink(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return tidy(spark.read.parquet(f"{path}/out").select("event_id", "user_id", "value"))


def _documents(rows: DataFrame) -> DataFrame:
    """Rows as a provider's documents, one line each, some of them broken."""
    text = F.to_json(F.struct(*[c for c in rows.columns if c != "k"]))
    return rows.select("k", F.when(F.col("k") % 41 == 0, F.concat(F.lit("{oops "), text)).when(F.col("k") % 43 == 0, F.lit("[1, 2]")).otherwise(text).alias("value"))


@query(f"""with {RUNNERS_SQL}, ok as (select * from runners where race_id % 41 <> 0 and race_id % 43 <> 0)
select race_id::varchar as race_id, case when race_id % 7 <> 0 then strftime(race_ts, '%Y-%m-%dT00:00') end as off, course as racecourse, case when race_id % 2 = 0 then 'HANDICAP' else 'NON_HANDICAP' end as handicap_type, flat_jumps, case when race_id % 5 = 0 then 99 else field_size end::bigint as n_runners,
  round(distance_f, 9) as distance, 'Horse ' || horse_id as horse, official_rating::bigint as rating, case when runner_id % 3 = 0 then null else weight_lbs end::bigint as weight, draw::bigint as draw, non_runner, case when race_id % 7 = 0 then 'off is missing' else '' end || case when race_id % 7 = 0 and runner_id % 3 = 0 then '; ' else '' end || case when runner_id % 3 = 0 then 'weight_lbs_total is no int' else '' end as errors from ok""")
def provider_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runners out of a provider's race documents, whose fields go by several names."""
    r, even = racing.runners(spark, sf_dir), F.col("race_id") % 2 == 0
    runner = F.struct(F.concat(F.lit("Horse "), "horse_id").alias("horse"), F.when(even, F.col("official_rating")).alias("ofr"), F.when(~even, F.col("official_rating")).alias("rating"), F.when(F.col("runner_id") % 3 == 0, "heavy").otherwise(F.col("weight_lbs").cast("string")).alias("lbs"), F.when(even, F.col("draw")).alias("stall"), F.when(~even, F.col("draw")).alias("draw"), F.when(F.col("non_runner"), True).alias("non_runner"))
    races = r.groupBy(F.col("race_id").alias("k"), "race_id", "race_ts", "course", "flat_jumps", "distance_f").agg(F.collect_list(runner).alias("runners"))
    kind = F.when(F.col("flat_jumps") == "FLAT", "Flat").otherwise("National Hunt")
    docs = races.select("k", F.when(even, F.col("race_id")).alias("race_id"), F.when(~even, F.col("race_id")).alias("id"), F.when(F.col("race_id") % 7 != 0, F.date_format("race_ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("off_time"), "course", kind.alias("type"), F.col("distance_f").alias("dist_f"), F.when(even, True).alias("is_handicap"), F.when(F.col("race_id") % 5 == 0, 99).alias("field_size"), "runners")
    good, _ = providers.documents(_documents(docs))
    out = providers.race_cards(good.select("document"))
    return tidy(out.select(F.col("provider_race_id").alias("race_id"), F.date_format("off", "yyyy-MM-dd'T'HH:mm").alias("off"), "racecourse", "handicap_type", "flat_jumps", F.col("number_of_runners").alias("n_runners"), F.col("distance_furlongs").alias("distance"), F.col("horse_name").alias("horse"), F.col("official_rating").alias("rating"), F.col("weight_lbs_total").alias("weight"), "draw", "non_runner", F.array_join("errors", "; ").alias("errors")))


@query("""select event_id, 'U' || user_id as runner, strftime(ts, '%Y-%m-%d %H:%M:%S') as tick, round(coalesce(case when event_id % 3 <> 0 then value + 1 end, case when event_id % 5 <> 0 then value + 2 end, 0), 9) as price, event_type = 'purchase' as is_sp, 'Betfair Exchange' as bookmaker
from events where event_id % 41 <> 0 and event_id % 43 <> 0 and cast(ts as date) between date '2024-01-05' and date '2024-01-20'""")
def provider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of some days out of an exchange's documents: the back price, else the lay price, else none."""
    e, i = racing.table(spark, sf_dir, "events"), F.col("event_id")
    docs = e.select(i.alias("k"), i, F.concat(F.lit("U"), "user_id").alias("selection_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("market_time"), F.when(i % 3 != 0, F.col("value") + 1).alias("back"), F.when(i % 5 != 0, F.col("value") + 2).alias("lay"), F.when(F.col("event_type") == "purchase", "closed").otherwise("OPEN").alias("status"))
    good, _ = providers.documents(_documents(docs))
    out = providers.exchange_points(good.select(F.col("k").alias("event_id"), "document"), "document", "2024-01-05", "2024-01-20")
    return tidy(out.select("event_id", "runner", F.date_format("tick_ts", "yyyy-MM-dd HH:mm:ss").alias("tick"), "price", "is_sp", "bookmaker"))


@query("select 'line ' || event_id as line from events where event_id % 41 = 0 or event_id % 43 = 0")
def provider_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that hold no document."""
    e = racing.table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), "event_type")
    return providers.documents(_documents(e))[1].select(F.concat(F.lit("line "), "k").alias("line"))
