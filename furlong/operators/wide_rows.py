"""Race-level and runner-level tables of unknown layout joined into one row per runner.

Which columns hold the race's id is measured, not guessed.  A sketch of a column
is its ``k`` smallest hashes of distinct values; two sketches tell how much of
one column's values the other has, and how many values there are.  A key must be
nearly unique among races and hold nearly all of the runners' values.  Where a
mapping names the key, the sketches only check it; where nothing is named and
the best pair isn't clearly best, the join is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.operators.mapping import MappingError, kind, role

SKETCH = 1024
#: A key has at least this share of the runners' values among the races', as many distinct values to a race, and such a lead over the next pair.
CONTAINED, UNIQUE, LEAD = 0.9, 0.9, 0.05
_SPAN = float(2**64)


@dataclass(frozen=True)
class Pair:
    """A column of each table, what share of the runners' values the races have, and how nearly unique the races' column is."""

    race_column: str
    runner_column: str
    contained: float
    unique: float


def cell_text(c: Column) -> Column:
    """A cell as it is compared: trimmed text; whole numbers without a fraction; null for a blank."""
    text = F.trim(c.cast("string"))
    whole = F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1")).otherwise(text)  # most cells have no point and skip the pattern
    return F.nullif(whole, F.lit(""))


def _smallest(k: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ``k`` smallest distinct hashes of each column that a task has seen; the batch's columns are the table's."""
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                fresh = column.drop_null().to_numpy(zero_copy_only=False)
                had = held.get(name, fresh[:0])
                if len(had) == k:
                    fresh = fresh[fresh < had[-1]]  # soon few
                held[name] = np.unique(np.concatenate([had, fresh]))[:k] if len(fresh) else had
        for name, found in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found, pa.int64())], names=["column", "h"])

    return keep


def sketches(rows: DataFrame, columns: list[str] | None = None, k: int = SKETCH) -> DataFrame:
    """(column, h): the ``k`` smallest hashes of each column's distinct values. Each task passes on ``k`` of a column at most."""
    columns = rows.columns if columns is None else columns
    texts = rows.select(*[cell_text(F.col(f"`{c}`")).alias(c) for c in columns])
    hashed = texts.select(*[F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(f"`{c}`")).alias(c) for c in columns])
    long = hashed.mapInArrow(_smallest(k), "column string, h long").distinct()
    return long.withColumn("n", F.row_number().over(Window.partitionBy("column").orderBy("h"))).filter(F.col("n") <= k).select("column", "h")


def collected(found: DataFrame) -> dict[str, list[int]]:
    """Sketches in the driver: at most ``k`` numbers for each column."""
    return {r["column"]: sorted(r["h"]) for r in found.groupBy("column").agg(F.collect_list("h").alias("h")).collect()}


def distinct_of(sketch: list[int], k: int = SKETCH) -> float:
    """The number of distinct values: counted if the sketch isn't full, else from how far its largest hash lies."""
    if len(sketch) < k:
        return float(len(sketch))
    return (len(sketch) - 1) / ((sketch[-1] + 2**63 + 1) / _SPAN)


def contained(inner: list[int], outer: list[int], k: int = SKETCH) -> float:
    """What share of the inner column's distinct values the outer one has, up to where both sketches are complete."""
    bound = min(inner[-1] if len(inner) >= k else 2**63, outer[-1] if len(outer) >= k else 2**63)
    low = [h for h in inner if h <= bound]
    have = set(outer)
    return sum(h in have for h in low) / len(low) if low else 0.0


def key_pairs(races: DataFrame, runners: DataFrame, k: int = SKETCH) -> list[Pair]:
    """All pairs of columns that share values, best first."""
    a, b, n = collected(sketches(races, k=k)), collected(sketches(runners, k=k)), max(1, races.count())
    pairs = [Pair(x, y, contained(b[y], a[x], k), min(1.0, distinct_of(a[x], k) / n)) for x in a for y in b]
    return sorted((p for p in pairs if p.contained), key=lambda p: (-p.contained * p.unique, p.race_column, p.runner_column))


def join_key(races: DataFrame, runners: DataFrame, race_roles: dict[str, str] | None = None, runner_roles: dict[str, str] | None = None, k: int = SKETCH) -> Pair:
    """The pair of columns that joins the tables; ``*_roles`` are confirmed mappings (column to role).

    Named race ids are taken if the measure bears them out. Named on one side only, they are refused. Without any, the best pair by the measure is taken
    if it is good and clearly the best. Everything else is refused with the figures.
    """
    named = [next((c for c, r in (roles or {}).items() if r == "race_id"), None) for roles in (race_roles, runner_roles)]
    if any(named) and not all(named):
        raise MappingError(f"race_id is named in one table only: {named[0] or named[1]}")
    found = key_pairs(races, runners, k)
    if all(named):
        pair = next((p for p in found if (p.race_column, p.runner_column) == tuple(named)), Pair(*named, 0.0, 0.0))
        if pair.contained == 0:
            raise MappingError(f"{named[0]} and {named[1]} share no value")
        return pair
    good = [p for p in found if p.contained >= CONTAINED and p.unique >= UNIQUE]
    if not good:
        raise MappingError(f"no columns that join the tables; best: {found[:3]}")
    hinted = [p for p in good if role(p.race_column)[0] == role(p.runner_column)[0] == "race_id"] or good
    if len(hinted) > 1 and hinted[0].contained * hinted[0].unique - hinted[1].contained * hinted[1].unique < LEAD:
        raise MappingError(f"several columns may join the tables: {hinted[:3]}")
    return hinted[0]


def which(tables: dict[str, DataFrame]) -> tuple[str, str]:
    """The names of the race-level and the runner-level table; refused unless there is one of each."""
    kinds = {name: kind(df.columns) for name, df in tables.items()}
    races, runners = ([n for n, k in kinds.items() if k == of] for of in ("race_level", "runner_level"))
    if len(races) != 1 or len(runners) != 1:
        raise MappingError(f"no one race-level and one runner-level table: {kinds}")
    return races[0], runners[0]


def joined(races: DataFrame, runners: DataFrame, pair: Pair) -> DataFrame:
    """A row for each runner of a known race; of columns of one name the runner's gets ``_runner`` and the race's ``_race``.

    Races are nearly unique by the key; of several rows of one the first in the order of their columns is taken, so that no runner is doubled.
    """
    both = set(races.columns) & set(runners.columns)
    key = cell_text(F.col(f"`{pair.race_column}`"))
    one = races.withColumn("__k", key).filter("__k is not null")
    one = one.withColumn("__n", F.row_number().over(Window.partitionBy("__k").orderBy(*[F.col(f"`{c}`") for c in races.columns]))).filter("__n = 1").drop("__n")
    one = one.select("__k", *[F.col(f"`{c}`").alias(f"{c}_race" if c in both else c) for c in races.columns])
    own = runners.select(cell_text(F.col(f"`{pair.runner_column}`")).alias("__k"), *[F.col(f"`{c}`").alias(f"{c}_runner" if c in both else c) for c in runners.columns])
    return own.join(one, "__k").drop("__k")


def wide_rows(tables: dict[str, DataFrame], roles: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """One table as it is; of several the race-level and the runner-level one joined. ``roles`` are confirmed mappings by table.

    The sketches, the count and the join each read the tables; what is costly to compute should be stored first.
    """
    if len(tables) == 1:
        return next(iter(tables.values()))
    race, runner = which(tables)
    roles = roles or {}
    return joined(tables[race], tables[runner], join_key(tables[race], tables[runner], roles.get(race), roles.get(runner)))
