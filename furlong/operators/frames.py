"""Frames that keep the order of their rows: positions, repeats, and other frames' values put beside them by key.

A position is a column, so nothing depends on how rows lie in files or tasks once
it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACE = "place"


def placed(rows: DataFrame, name: str = PLACE) -> DataFrame:
    """Numbers rows from 0 in the order in which they are read: the number within a task plus the rows of the tasks before.

    No row moves. The driver sees one count a task. The source must read alike each time (files do; a shuffle without an order doesn't).
    """
    dealt = rows.withColumns({"__task": F.spark_partition_id(), "__n": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["__task"]: r["n"] for r in dealt.groupBy("__task").agg(F.count(F.lit(1)).alias("n")).collect()}
    earlier, so_far = [], 0
    for task in range(max(sizes, default=-1) + 1):
        earlier.append(so_far)
        so_far += sizes.get(task, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in earlier]), F.col("__task") + 1) if earlier else F.lit(0).cast("long")
    return dealt.withColumn(name, start + F.col("__n")).drop("__task", "__n")


def first_of_each(rows: DataFrame, key: list[str], place: str = PLACE) -> DataFrame:
    """The first row of each key in order of place; nulls are a key like others. Rows of a key combine before they meet."""
    other = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*other), place).alias("__r")).select(*key, "__r.*").select(*rows.columns)


def present(columns: list[str]) -> Column:
    """Whether a row has any of the values."""
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNotNull()
    return out


def aligned(left: DataFrame, key: str, beside: dict[str, tuple[DataFrame, list[str]]], place: str = PLACE) -> DataFrame:
    """All rows of ``left``, each once, with the values that other frames have for its key, and ``has_<frame>``: whether the frame has the key and any value.

    ``beside`` names frames (with ``key`` and ``place``) and their columns. A frame's first row of a key counts. All frames are put together by key
    first, so there is one join however many there are; a null key finds nothing. Repeats and places of ``left`` stay as they are.
    """
    parts = []
    for name, (frame, columns) in beside.items():
        values = F.struct(*[F.col(c) for c in columns])
        mine = frame.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(values, place).alias(f"__{name}"))
        parts.append(mine)
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part, allowMissingColumns=True)
    one = together.groupBy(key).agg(*[F.first(f"__{name}", ignorenulls=True).alias(f"__{name}") for name in beside])
    out = left.join(one, key, "left")
    made: dict[str, Column] = {}
    for name, (_, columns) in beside.items():
        made |= {c: F.col(f"__{name}.{c}") for c in columns}
        made[f"has_{name}"] = F.coalesce(F.greatest(*[F.col(f"__{name}.{c}").isNotNull() for c in columns], F.lit(False)), F.lit(False))
    return out.select(*left.columns, *[v.alias(k) for k, v in made.items()])



def marked_first(rows: DataFrame, key: str, place: str = PLACE) -> DataFrame:
    """Adds ``first``: whether a row is the first of its key by place; of a null key every row is. Only the key's least place is looked for."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("__least"))
    return rows.join(least, key, "left").select(*rows.columns, F.coalesce(F.col(place) == F.col("__least"), F.lit(True)).alias("first"))


def by_value(rows: DataFrame, column: str, made: dict[str, Column]) -> DataFrame:
    """``rows`` with columns that follow from one column, worked out once for each of its values; null for null. ``rows`` is read twice."""
    values = rows.select(column).filter(F.col(column).isNotNull()).distinct().withColumns(made)
    return rows.join(values, column, "left")
