"""Readers of race cards, exchange price lines and starting-price files.

All return tables with a column for what could not be read, so that a bad row or line
never ends a job and never vanishes.
"""

from __future__ import annotations

import csv
import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furlong.functions.betting import iso_time, real_number, truth, whole_number

# Columns of a race card by kind (fixed values of the format).
RACE_TEXT = ["provider_race_id", "race_time", "racecourse", "country", "race_name", "race_type", "flat_jumps", "surface", "handicap_type", "going", "currency", "race_status"]
RACE_WHOLE = ["race_class", "number_of_runners"]
RACE_REAL = ["distance_furlongs", "prize_money"]
RUNNER_TEXT = ["horse_name", "jockey_name", "trainer_name", "headgear", "result_status"]
RUNNER_WHOLE = ["draw", "age_at_race", "weight_lbs_total", "official_rating", "finishing_position"]
RUNNER_REAL = ["starting_price_decimal", "beaten_distance"]
RUNNER_TRUTH = ["non_runner"]
DEFAULTS = {"flat_jumps": "FLAT", "surface": "TURF", "handicap_type": "NON_HANDICAP", "currency": "GBP", "race_status": "RESULTED", "result_status": "PENDING"}
REQUIRED = ["race_date", "racecourse", "horse_name"]


def card_columns() -> list[str]:
    return ["race_date", *RACE_TEXT, *RACE_WHOLE, *RACE_REAL, *RUNNER_TEXT, *RUNNER_WHOLE, *RUNNER_REAL, *RUNNER_TRUTH]


def typed_card(raw: DataFrame) -> DataFrame:
    """A race card's text columns as typed ones, defaults filled in, and ``errors``: what is wrong with a row (empty if nothing is)."""
    text = {c: (F.nullif(F.trim(F.col(c)), F.lit("")) if c in raw.columns else F.lit(None).cast("string")) for c in card_columns()}
    out = {"race_date": iso_time(text["race_date"])}
    out |= {c: F.coalesce(text[c], F.lit(DEFAULTS[c])) if c in DEFAULTS else text[c] for c in [*RACE_TEXT, *RUNNER_TEXT]}
    out |= {c: whole_number(text[c]) for c in [*RACE_WHOLE, *RUNNER_WHOLE]} | {c: real_number(text[c]) for c in [*RACE_REAL, *RUNNER_REAL]} | {c: F.coalesce(truth(text[c]), F.lit(False)) for c in RUNNER_TRUTH}
    wrong = [F.when(text[c].isNull(), f"{c} is missing") for c in REQUIRED]
    wrong.append(F.when(text["race_date"].isNotNull() & out["race_date"].isNull(), "race_date is no ISO date"))
    wrong += [F.when(text[c].isNotNull() & out[c].isNull(), f"{c} is no number") for c in [*RACE_WHOLE, *RACE_REAL, *RUNNER_WHOLE, *RUNNER_REAL]]
    wrong.append(F.when(~out["flat_jumps"].isin("FLAT", "JUMPS"), "flat_jumps is neither FLAT nor JUMPS"))
    keep = [F.col(c) for c in raw.columns if c not in out]
    return raw.select(*keep, *[v.alias(c) for c, v in out.items()], F.array_compact(F.array(*wrong)).alias("errors"))


def race_card_csv(spark: SparkSession, path: str) -> DataFrame:
    """A wide CSV file, one row per runner; ``.gz`` files are unpacked by the reader."""
    return typed_card(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'))


def race_card_json(spark: SparkSession, path: str) -> DataFrame:
    """An array, an object with ``races``, or a line for each race; races hold their runners. Unknown keys are left out."""
    race = T.StructType([T.StructField(c, T.StringType()) for c in ["race_date", *RACE_TEXT, *RACE_WHOLE, *RACE_REAL]])
    runner = T.StructType([T.StructField(c, T.StringType()) for c in [*RUNNER_TEXT, *RUNNER_WHOLE, *RUNNER_REAL, *RUNNER_TRUTH]])
    race = race.add("runners", T.ArrayType(runner))
    if by_lines(spark, path):
        races = spark.read.json(path, schema=race)
    else:
        rows = spark.read.json(path, schema=T.StructType([*race.fields, T.StructField("races", T.ArrayType(race))]), multiLine=True)
        own = F.when(F.col("races").isNull(), F.array(F.struct(*race.names))).otherwise(F.col("races"))
        races = rows.select(F.inline(own))
    return typed_card(races.select(*[c for c in race.names if c != "runners"], F.inline("runners")))


def by_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line is a JSON object of its own."""
    first = spark.read.text(path).limit(1).select(F.try_parse_json(F.trim("value")).isNotNull() & F.trim("value").startswith("{")).first()
    return bool(first and first[0])


def race_card(spark: SparkSession, path: str) -> DataFrame:
    """By the file's suffix, ``.gz`` aside."""
    name = path.lower().removesuffix(".gz")
    if name.endswith(".csv"):
        return race_card_csv(spark, path)
    if name.endswith((".json", ".jsonl", ".ndjson")):
        return race_card_json(spark, path)
    raise ValueError(f"{path}: neither CSV nor JSON")


EXCHANGE = "op string, pt long, mc array<struct<id: string, marketDefinition: struct<runners: array<struct<id: long, name: string>>>, rc: array<struct<id: long, ltp: double, batb: array<array<double>>, batl: array<array<double>>>>>>"


def exchange_messages(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(messages, lines that are none): blank lines go, malformed ones are kept apart."""
    rows = lines.filter(F.trim(value) != "").withColumn("message", F.from_json(value, EXCHANGE))
    good = F.col("message.op").isNotNull()
    return rows.filter(good), rows.filter(~good | F.col("message").isNull()).drop("message")


def exchange_prices(messages: DataFrame, order: str | None = None) -> DataFrame:
    """(market, tick_ts, selection, name, price) of each change of price: last traded, else best back, else best lay; none without any.

    A selection's name is the market's latest definition up to the message; ``order`` breaks ties of time.
    """
    from pyspark.sql import Window

    m = messages.filter("message.op = 'mcm'").select(F.col("message.pt").alias("pt"), *([F.col(order).alias("seq")] if order else [F.lit(0).alias("seq")]), F.explode("message.mc").alias("mc"))
    names = F.when(F.col("mc.marketDefinition").isNotNull(), F.map_from_entries(F.transform("mc.marketDefinition.runners", lambda r: F.struct(r["id"], r["name"]))))
    so_far = Window.partitionBy("market").orderBy("pt", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = m.select("pt", "seq", F.col("mc.id").alias("market"), F.col("mc.rc").alias("rc"), names.alias("names")).withColumn("names", F.last("names", ignorenulls=True).over(so_far))
    best = lambda book: F.try_element_at(F.try_element_at(F.col(f"c.{book}"), F.lit(1)), F.lit(2))  # noqa: E731  level, price, size
    ticks = rows.select("pt", "market", "names", F.explode("rc").alias("c")).withColumn("price", F.coalesce("c.ltp", best("batb"), best("batl")))
    return ticks.filter("price is not null").select("market", F.timestamp_millis("pt").alias("tick_ts"), F.col("c.id").alias("selection"), F.try_element_at("names", F.col("c.id")).alias("name"), "price")


def headed(lines: DataFrame, header: str) -> DataFrame:
    """Lines of text (one column) to be written as files that each begin with a header."""
    name = lines.columns[0]

    def with_header(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({name: [header]})
        yield from parts

    return lines.mapInPandas(with_header, lines.schema)


SP_COLUMNS = ["EVENT_DT", "SELECTION_NAME", "BSP"]


def starting_price_rows(spark: SparkSession, path: str) -> DataFrame:
    """(day, selection, bsp, raw, reason) of every line of CSV files, or of zip archives of them; ``reason`` says what is wrong with a line, null if nothing is.

    A line of more or fewer cells than the header has, a day that isn't DD-MM-YYYY, a missing name and a price that is no number are wrong. ``raw`` is
    the line's cells as they stand.
    """
    if path.lower().endswith(".zip"):
        packed = spark.read.format("binaryFile").load(path).select("path", "content")
        rows = packed.mapInPandas(_unzipped, ", ".join(f"{c} string" for c in (*SP_COLUMNS, RAW, BROKEN)))
    else:
        header = spark.read.csv(path, header=True).schema
        missing = [c for c in SP_COLUMNS if c not in header.names]
        if missing:
            raise ValueError(f"{path}: columns {missing} are missing")
        whole = T.StructType([*[T.StructField(f.name, T.StringType()) for f in header.fields], T.StructField(BROKEN, T.StringType())])
        rows = spark.read.csv(path, header=True, schema=whole, mode="PERMISSIVE", columnNameOfCorruptRecord=BROKEN, enforceSchema=False)
        rows = rows.withColumn(RAW, F.coalesce(F.col(BROKEN), F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in header.names])))
    day = F.try_to_timestamp(F.substring("EVENT_DT", 1, 10), F.lit("dd-MM-yyyy")).cast("date")
    out = rows.select(day.alias("day"), F.nullif(F.trim("SELECTION_NAME"), F.lit("")).alias("selection"), real_number(F.col("BSP")).alias("bsp"), RAW, BROKEN)
    wrong = F.array_compact(F.array(F.when(F.col("day").isNull(), "day is not DD-MM-YYYY"), F.when(F.col("selection").isNull(), "name is missing"), F.when(F.col("bsp").isNull(), "price is no number")))
    reason = F.when(F.col(BROKEN).isNotNull(), "not as many cells as the header").when(F.size(wrong) > 0, F.array_join(wrong, "; "))
    return out.select("day", "selection", "bsp", F.col(RAW).alias("raw"), reason.alias("reason"))


def starting_prices(spark: SparkSession, path: str) -> DataFrame:
    """(day, selection, bsp) of the lines that nothing is wrong with."""
    return starting_price_rows(spark, path).filter("reason is null").select("day", "selection", "bsp")


def rejected_prices(spark: SparkSession, path: str) -> DataFrame:
    """(raw, reason) of the other lines."""
    return starting_price_rows(spark, path).filter("reason is not null").select("raw", "reason")


RAW, BROKEN = "__raw", "__broken"


def _unzipped(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of all CSV files of each archive, a batch at a time; a file without the columns is one broken line."""
    names = [*SP_COLUMNS, RAW, BROKEN]
    for part in parts:
        for content in part["content"]:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for name in sorted(n for n in z.namelist() if n.lower().endswith(".csv")):
                    lines = csv.reader(io.TextIOWrapper(z.open(name), "utf-8-sig", errors="replace", newline=""))
                    header = [c.strip() for c in next(lines, [])]
                    at = [header.index(c) if c in header else None for c in SP_COLUMNS]
                    if None in at:
                        yield pd.DataFrame([[None, None, None, f"{name}: {','.join(header)}", "header"]], columns=names, dtype=object)
                        continue
                    while batch := list(itertools.islice(lines, 50_000)):
                        rows = [[*([None] * 3 if len(x) != len(header) else [x[i] for i in at]), ",".join(x), None if len(x) == len(header) else "cells"] for x in batch if x]
                        yield pd.DataFrame(rows, columns=names, dtype=object)
