"""Tables of unknown layout: what their columns may mean, what they hold, and their rows under the names of a confirmed mapping."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# For each role the column names that mean it, the parts of names that suggest it, and abbreviations that may stand for it.
# fmt: off
ROLES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "race_id": (["race_id", "raceid", "event_id"], ["race_id"], ["rid"]),
    "race_date": (["race_date", "date", "meeting_date"], ["race_date", "off_date"], []),
    "race_time": (["race_time", "off_time"], ["race_time", "off_time"], ["off"]),
    "course": (["course", "track", "venue"], ["course", "track", "venue"], []),
    "country": (["country", "region"], ["country"], []),
    "race_name": (["race_name"], ["race_name"], []),
    "race_type": (["race_type", "type"], ["race_type"], []),
    "race_class": (["race_class", "class"], ["race_class"], ["rclass"]),
    "distance": (["distance", "distance_f", "distance_furlongs", "distance_yards", "distance_m"], ["distance", "dist_"], ["dist"]),
    "going": (["going", "ground"], ["going"], []),
    "flat_jumps": (["flat_jumps", "discipline", "code"], ["flat_jumps"], []),
    "field_size": (["field_size", "number_of_runners", "num_runners"], ["field_size", "num_runners"], ["nr"]),
    "horse_name": (["horse_name", "horse", "runner_name", "runner"], ["horse"], []),
    "horse_id": (["horse_id", "horseid"], ["horse_id"], []),
    "draw": (["draw", "stall_number"], ["draw"], ["stall"]),
    "weight": (["weight", "weight_lbs"], ["weight"], ["lbs", "wgt"]),
    "age": (["age"], ["age"], []),
    "sex": (["sex", "gender"], ["sex"], []),
    "official_rating": (["official_rating", "rating"], ["official_rating", "rating"], ["or", "ofr"]),
    "jockey": (["jockey", "jockey_name"], ["jockey"], []),
    "trainer": (["trainer", "trainer_name"], ["trainer"], []),
    "sire": (["sire", "sire_name"], ["sire"], []),
    "dam": (["dam", "dam_name"], ["dam"], []),
    "damsire": (["damsire"], ["damsire"], []),
    "headgear": (["headgear", "equipment"], ["headgear"], ["hg"]),
    "finishing_position": (["finishing_position", "finish_position", "position"], ["finish_pos", "finishing_position"], ["pos", "place"]),
    "beaten_distance": (["beaten_distance", "distance_beaten"], ["beaten_distance", "beaten"], ["btn"]),
    "starting_price": (["starting_price", "starting_price_decimal", "sp_decimal"], ["starting_price"], ["sp", "odds", "price"]),
    "bsp": (["bsp", "betfair_sp"], ["bsp"], []),
    "comment": (["comment", "comments"], ["comment"], ["note"]),
    "sectional": (["sectional", "sectionals", "sectional_times"], ["sectional"], ["split"]),
    "non_runner": (["non_runner", "withdrawn"], ["non_runner"], ["nr_flag"]),
}
# fmt: on
DATE_COLUMNS = ["race_date", "date", "off_date", "meeting_date", "event_dt"]
OF_RACES, OF_RUNNERS = {"course", "race_date", "race_name"}, {"horse_name", "jockey", "trainer", "finishing_position"}
REQUIRED = ["race_date", "course", "horse_name"]


class MappingError(ValueError):
    """A mapping that can't be used as it is."""


def column_name(name: str) -> str:
    return re.sub("[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def role(name: str) -> tuple[str | None, str]:
    """(role, confidence): high for an exact name, medium for the longest part found, low for an abbreviation, else unmapped."""
    plain = column_name(name)
    exact, parts, short = ({token: r for r in reversed(ROLES) for token in ROLES[r][i]} for i in range(3))
    if plain in exact:
        return exact[plain], "high"
    inside = [token for token in parts if token in plain]
    if inside:
        longest = max(map(len, inside))
        return next((r, "medium") for r in ROLES if any(len(t) == longest and t in inside for t in ROLES[r][1]))
    return (short[plain], "low") if plain in short else (None, "unmapped")


def proposal(columns: list[str]) -> dict[str, tuple[str | None, str]]:
    return {c: role(c) for c in columns}


def ambiguous(columns: list[str]) -> list[str]:
    """The columns whose role someone must confirm."""
    return [c for c, (_, confidence) in proposal(columns).items() if confidence != "high"]


def kind(columns: list[str]) -> str:
    """Whether a table is about races, runners, both, or neither."""
    found = {r for r, _ in proposal(columns).values()}
    return {(True, True): "race_and_runner_level", (True, False): "race_level", (False, True): "runner_level", (False, False): "unknown"}[bool(found & OF_RACES), bool(found & OF_RUNNERS)]


def date_range(rows: DataFrame) -> DataFrame:
    """One row: the date column (null without one), its first and last day; cells that are no date are left out."""
    by_name = {column_name(c): c for c in reversed(rows.columns)}
    name = next((by_name[d] for d in DATE_COLUMNS if d in by_name), None)
    day = F.try_to_timestamp(F.col(f"`{name}`").cast("string")).cast("date") if name else F.lit(None).cast("date")
    return rows.agg(F.lit(name).cast("string").alias("date_column"), F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _first_cells(columns: list[str], k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each column a task's rows, present values and first ``k`` values; the batch has the place, whether there is one, and the columns by number."""
        held: dict[int, pa.Table] = {}
        rows, present, kind = 0, [0] * len(columns), None
        for batch in batches:
            rows, kind = rows + batch.num_rows, batch.schema.field(0).type
            for i in range(len(columns)):
                cells = batch.column(i + 2)
                present[i] += len(cells) - cells.null_count
                some = pa.table({"at": batch.column(0), "placed": batch.column(1), "value": cells}).filter(cells.is_valid())
                if not some.num_rows:
                    continue
                some = pa.concat_tables([held[i], some]) if i in held else some
                held[i] = some.take(pc.select_k_unstable(some, k, [(c, "ascending") for c in ("placed", "at", "value")]))
        if rows:
            names = ["column_name", "rows", "present", "at", "value"]
            yield pa.RecordBatch.from_arrays([pa.array(columns, pa.string()), pa.array([rows] * len(columns), pa.int64()), pa.array(present, pa.int64()), pa.nulls(len(columns), kind), pa.nulls(len(columns), pa.string())], names=names)
            for i, some in held.items():
                n = some.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([columns[i]] * n, pa.string()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64()), some["at"].combine_chunks(), some["value"].combine_chunks().cast(pa.string())], names=names)

    return keep


def profile(rows: DataFrame, order: str, samples: int = 3, width: int = 60) -> DataFrame:
    """A row per column: rows, share of present values in percent, the first present values in ``order``, proposed role and confidence.

    One pass, from which each task passes on counts and ``samples`` values of a column.
    """
    columns = rows.columns
    at = F.col(f"`{order}`")
    numbered = rows.select(at.alias("__at"), at.isNotNull().cast("int").alias("__placed"), *[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    schema = T.StructType([T.StructField("column_name", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("present", T.LongType()), T.StructField("at", rows.schema[order].dataType), T.StructField("value", T.StringType())])
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("at", "value")))), 1, samples)
    figures = numbered.mapInArrow(_first_cells(columns, samples), schema).groupBy("column_name").agg(F.sum("rows").alias("rows"), F.sum("present").alias("present"), first.alias("s"))
    known = proposal(columns)
    of = lambda i: F.create_map(*[F.lit(x).cast("string") for x in chain.from_iterable((c, v[i]) for c, v in known.items())])[F.col("column_name")]
    pct = F.round(100.0 * F.col("present") / F.col("rows"), 1)
    return figures.select("column_name", "rows", pct.alias("present_pct"), F.transform("s", lambda x: F.left(x["value"], F.lit(width))).alias("samples"), of(0).alias("role"), of(1).alias("confidence"))


def reviewed(mapping: dict[str, str], columns: list[str], changes: dict[str, str | None]) -> dict[str, str]:
    """The mapping (column to role) with someone's changes; null takes a column out. Unknown columns, roles, and a role given twice are refused."""
    unknown = [c for c in changes if c not in columns] + [r for r in changes.values() if r is not None and r not in ROLES]
    out = {c: r for c, r in (mapping | changes).items() if r is not None}
    twice = sorted({r for r in out.values() if list(out.values()).count(r) > 1})
    if unknown or twice:
        raise MappingError(f"unknown: {unknown}; given twice: {twice}")
    return out


def confident(columns: list[str]) -> dict[str, str]:
    """The mapping of the columns that need no confirmation; of columns of one role, the first."""
    out: dict[str, str] = {}
    for c, (r, confidence) in proposal(columns).items():
        if confidence == "high" and r not in out.values():
            out[c] = r
    return out


def mapped(rows: DataFrame, mapping: dict[str, str], required: list[str] = REQUIRED) -> DataFrame:
    """The mapped columns under their roles' names, as text; a mapping without a required role is refused."""
    missing = [r for r in required if r not in mapping.values()]
    if missing:
        raise MappingError(f"no column for {', '.join(missing)}")
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(r) for c, r in mapping.items()])
