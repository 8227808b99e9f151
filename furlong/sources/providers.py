"""Providers' nested JSON as the columns of a race card, of form, and of exchange prices.

A provider's document is a text column; fields are taken from it by name, the
first of several names that has a value, whatever else the document holds.  What
a column can't take is null, and ``errors`` says so; a text that is no document
is kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.betting import iso_time


@dataclass(frozen=True)
class Field:
    """A column: its type, the names that it may have, and what stands for none."""

    kind: str
    names: tuple[str, ...]
    default: object = None
    required: bool = False


def _f(kind: str, *names: str, default: object = None, required: bool = False) -> Field:
    return Field(kind, names, default, required)


# The names that providers give to the fields of races, runners, form and prices.
RACE = {
    "provider_race_id": _f("string", "race_id", "id"), "off": _f("time", "off_time", "off_dt", required=True), "racecourse": _f("string", "course", default=""), "country": _f("string", "region", default=""),
    "race_name": _f("string", "race_name", "name", default=""), "race_type": _f("string", "type", "race_type"), "code": _f("string", "type", "jumps_flat"), "distance_furlongs": _f("double", "distance_f", "dist_f", "distance", default=0.0),
    "race_class": _f("int", "race_class", "class"), "is_handicap": _f("boolean", "is_handicap", default=False), "number_of_runners": _f("int", "field_size"), "going": _f("string", "going"),
}
RUNNER = {
    "horse_name": _f("string", "horse", default=""), "horse_id": _f("string", "horse_id"), "sex": _f("string", "sex", "sex_code"), "trainer_name": _f("string", "trainer"), "jockey_name": _f("string", "jockey"), "official_rating": _f("int", "ofr", "or", "official_rating", "rating"),
    "draw": _f("int", "draw", "stall_number", "stall"), "weight_lbs_total": _f("int", "lbs", "weight_lbs", "weight"), "headgear": _f("string", "headgear", "hg"), "sire_name": _f("string", "sire"), "dam_name": _f("string", "dam"), "damsire_name": _f("string", "damsire", "dams_sire"),
    "cloth_number": _f("int", "number", "cloth_number"), "age_at_race": _f("int", "age"), "non_runner": _f("boolean", "non_runner", default=False),
}
FORM = {
    "horse_name": _f("string", "horse", default=""), "horse_id": _f("string", "horse_id"), "race_date": _f("time", "date", required=True), "course": _f("string", "course", default=""), "country": _f("string", "country"), "distance_furlongs": _f("double", "distance_f"), "going": _f("string", "going"),
    "race_class": _f("int", "class"), "field_size": _f("int", "field_size"), "finishing_position": _f("int", "position"), "finish_status": _f("string", "finish_status"), "beaten_distance": _f("double", "beaten_lengths"), "starting_price": _f("double", "sp_decimal"), "official_rating": _f("int", "or"),
    "draw": _f("int", "draw"), "jockey_name": _f("string", "jockey"), "headgear": _f("string", "headgear"), "comment": _f("string", "comment"), "halfway_position": _f("int", "halfway_pos"), **{f"position_{k}f": _f("int", f"pos_{k}f_out") for k in (3, 2, 1)}, "finishing_speed_pct": _f("double", "finishing_speed_pct"), "race_id": _f("string", "race_id"),
}
PRICE = {"runner": _f("string", "selection_id", default=""), "tick_ts": _f("time", "market_time", required=True), "back": _f("double", "back"), "lay": _f("double", "lay"), "volume": _f("double", "total_matched"), "status": _f("string", "status")}
CODES = {"flat": "FLAT", "jumps": "JUMPS", "nh": "JUMPS", "national hunt": "JUMPS"}
EXCHANGE = "Betfair Exchange"
#: Any of these tells how a run went in running.
POSITIONS = ["halfway_position", "position_3f", "position_2f", "position_1f", "finishing_position"]


def texts(document: Column, fields: dict[str, Field]) -> Column:
    """All fields of a document that any name may mean, as a struct of texts: one pass over the document."""
    names = dict.fromkeys(n for f in fields.values() for n in f.names)
    return F.try_variant_get(document, "$", f"struct<{', '.join(f'`{n}`: string' for n in names)}>")


def first_of(found: Column, names: tuple[str, ...]) -> Column:
    """The first named field that isn't null, of a struct of texts."""
    return F.coalesce(*[found[n] for n in names])


def typed(found: Column, field: Field) -> tuple[Column, Column]:
    """A field's value, and whether it has one that doesn't fit."""
    text = first_of(found, field.names)
    value = {"string": lambda: text, "time": lambda: iso_time(text), "int": lambda: F.trim(text).try_cast("double").try_cast("int"), "double": lambda: F.trim(text).try_cast("double"), "boolean": lambda: F.lower(F.trim(text)).isin("true", "1", "yes")}[field.kind]()
    return (value if field.default is None else F.coalesce(value, F.lit(field.default))), text.isNotNull() & value.isNull()


def mapped(rows: DataFrame, document: str, fields: dict[str, Field]) -> DataFrame:
    """``rows`` with the fields of a variant column as columns, and ``errors``: what is missing or doesn't fit."""
    found, kept = F.col("__texts"), rows.columns
    made = {name: typed(found, f) for name, f in fields.items()}
    wrong = [F.when(bad, f"{name} is no {fields[name].kind}") for name, (_, bad) in made.items() if fields[name].kind != "string"]
    wrong += [F.when(first_of(found, f.names).isNull(), f"{name} is missing") for name, f in fields.items() if f.required]
    return rows.withColumn("__texts", texts(F.col(document), fields)).select(*[F.col(f"`{c}`") for c in kept], *[v.alias(name) for name, (v, _) in made.items()], F.array_compact(F.array(*wrong)).alias("errors"))


def documents(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(lines with ``document``, lines that hold none)."""
    rows = lines.withColumn("document", F.try_parse_json(value))
    good = F.col("document").isNotNull() & F.coalesce(F.schema_of_variant("document").startswith("OBJECT"), F.lit(False))
    # as a generator: a filter would parse each line a second time
    kept = rows.select(*[F.col(f"`{c}`") for c in lines.columns if c != "document"], F.explode(F.when(good, F.array("document"))).alias("document"))
    return kept, rows.filter(~good | F.col("document").isNull()).drop("document")


def race_cards(rows: DataFrame, document: str = "document") -> DataFrame:
    """A row for each runner of each race document, its race's columns beside it; a race without runners has none.

    The size of the field is what the document says, else how many runners it has. An unknown code is flat, the surface turf, the race resulted.
    """
    races = mapped(rows, document, RACE).withColumnRenamed("errors", "race_errors")
    runners = F.coalesce(F.try_variant_get(F.col(document), "$.runners", "array<variant>"), F.array().cast("array<variant>"))
    races = races.withColumns({"number_of_runners": F.coalesce(F.col("number_of_runners"), F.size(runners)), "__runners": runners})
    code = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), F.lower("code")), F.lit("FLAT"))
    races = races.withColumns({"flat_jumps": code, "handicap_type": F.when(F.col("is_handicap"), "HANDICAP").otherwise("NON_HANDICAP"), "surface": F.lit("TURF"), "race_status": F.lit("RESULTED"), "race_time": F.date_format("off", "HH:mm")})
    one = races.withColumn("runner", F.explode("__runners")).drop("__runners", "code", "is_handicap")
    out = mapped(one, "runner", RUNNER)
    return out.withColumn("errors", F.concat("race_errors", "errors")).drop("race_errors", "runner")


def form_entries(rows: DataFrame, document: str = "document", first: str | None = None, last: str | None = None) -> DataFrame:
    """A past run from each document, those from ``first`` to ``last`` (days) if they are named; ``has_positions`` tells whether any position is known."""
    known = F.lit(False)
    for c in POSITIONS:
        known = known | F.col(c).isNotNull()
    return between(mapped(rows, document, FORM).withColumn("has_positions", known), "race_date", first, last)


def exchange_points(rows: DataFrame, document: str = "document", first: str | None = None, last: str | None = None) -> DataFrame:
    """A price from each document: the back price, else the lay price, else 0; a closed market's is a starting price."""
    out = mapped(rows, document, PRICE)
    made = {"price": F.coalesce("back", "lay", F.lit(0.0)), "bookmaker": F.lit(EXCHANGE), "is_exchange": F.lit(True), "is_sp": F.upper(F.coalesce("status", F.lit(""))) == "CLOSED"}
    return between(out.withColumns(made), "tick_ts", first, last)


def between(rows: DataFrame, at: str, first: str | None, last: str | None) -> DataFrame:
    """Rows of the days from ``first`` to ``last``, both included."""
    day = F.to_date(at)
    if first is not None:
        rows = rows.filter(day >= F.lit(first).cast("date"))
    return rows if last is None else rows.filter(day <= F.lit(last).cast("date"))
