"""Merging batches into a partitioned Parquet table: only the partitions that a batch touches are written again.

A merge first writes the new contents of those partitions beside the table
(``_merge/<batch>``), then puts them in place by a dynamic partition overwrite,
then marks the batch as done.  Whatever fails, running it again ends well: an
unfinished first step is done anew, a finished one is put in place once more,
and a batch that is done changes nothing.  One merge runs at a time on a table.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from furlong.sources.shared import Files

JOURNAL = "_merge"


def latest(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    """One row of each key: the last in ``order`` (nulls first), of equal ones the last by its other columns."""
    rest = [F.col(c).desc_nulls_last() for c in rows.columns if c not in key and c != order and not c.startswith("__")]
    by = ([F.col(order).desc_nulls_last()] if order else []) + rest
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*(by or [F.lit(1)])))).filter("__n = 1").drop("__n")


def put_over(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The held rows with the values of the new ones of their key; a null keeps what is held. Keys that aren't held are added."""
    other = [c for c in held.columns if c not in key]
    fresh = new.select(*key, *[F.col(c).alias(f"__new_{c}") for c in other])
    return held.join(fresh, key, "full_outer").select(*key, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) for c in other])


def latest_over(held: DataFrame, new: DataFrame, key: list[str], partition: list[str], order: str | None) -> DataFrame:
    """``put_over`` of the ``latest`` new rows, in one shuffle by ranges of partition and key: held and new rows of a key meet there, and stay where they are to be written."""
    other = [c for c in held.columns if c not in key]
    rest = [F.col(c).desc_nulls_last() for c in other if c != order and not c.startswith("__")]
    by = ([F.col(order).desc_nulls_last()] if order else []) + rest
    both = held.withColumn("__is_new", F.lit(False)).unionByName(new.withColumn("__is_new", F.lit(True)))
    both = both.repartitionByRange(*dict.fromkeys([*partition, *key]))
    mine, is_new = Window.partitionBy(*key), F.col("__is_new")
    ordered = mine.orderBy(is_new.desc(), *by)
    both = both.withColumns({"__n": F.row_number().over(ordered), "__new": F.first(F.when(is_new, F.struct(*other))).over(ordered), "__held": F.max(~is_new).over(mine)})
    return both.filter(~is_new | ((F.col("__n") == 1) & ~F.col("__held"))).select(*key, *[F.coalesce(F.col("__new")[c], F.col(c)).alias(c) for c in other])


def put_for(held: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The new rows in place of all the held ones of their key, however many there are of either."""
    return held.join(new.select(*key).distinct(), key, "left_anti").select(*held.columns).unionByName(new.select(*held.columns))


def of_partitions(table: DataFrame, touched: list[tuple], partition: list[str]) -> DataFrame:
    """The rows of some partitions; the filter reaches the listing of files."""
    one = lambda values: reduce(Column.__and__, [F.col(c).eqNullSafe(F.lit(v)) if v is None else F.col(c) == F.lit(v) for c, v in zip(partition, values, strict=True)])
    if len(partition) == 1 and not any(v is None for (v,) in touched):
        return table.filter(F.col(partition[0]).isin([v for (v,) in touched]))
    return table.filter(reduce(Column.__or__, [one(v) for v in touched]) if touched else F.lit(False))


def _put_in_place(files: Files, batch: str, partition: list[str]) -> None:
    spark, journal = files.spark, f"{JOURNAL}/{batch}"
    ready = spark.read.option("basePath", f"{files.root}/{journal}/data").schema(_schema(files, batch)).parquet(f"{files.root}/{journal}/data")
    ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(files.root)
    files.write(f"{journal}.done", batch)
    files.delete(journal)


def _schema(files: Files, batch: str) -> StructType:
    return StructType.fromJson(json.loads(files.read(f"{JOURNAL}/{batch}/schema.json")))


def merge_into(path: str, batch: DataFrame, name: str, key: list[str], partition: list[str], order: str | None = None, replace: bool = False) -> bool:
    """Merges a batch into the table at ``path``; false if a batch of that name is done already.

    The partition's columns must follow from the key.  Rows of one key in a batch: the last in ``order`` counts; with ``replace`` all count, and they
    take the place of all held rows of their key.  A null value keeps the held one (not with ``replace``).  A null in the key is refused.
    The driver sees the batch's partitions, not its rows.
    """
    spark, files = batch.sparkSession, Files(batch.sparkSession, path)
    if files.exists(f"{JOURNAL}/{name}.done"):
        return False
    for other in files.names(JOURNAL):  # what an earlier run had ready, but not in place
        if files.exists(f"{JOURNAL}/{other}/data/_SUCCESS") and files.exists(f"{JOURNAL}/{other}/schema.json"):
            _put_in_place(files, other, partition)
    if files.exists(f"{JOURNAL}/{name}.done"):
        return True
    files.delete(f"{JOURNAL}/{name}")
    columns = [*key, *[c for c in batch.columns if c not in key]]
    rows = batch.select(*columns)
    keyless = F.count_if(reduce(Column.__or__, [F.col(c).isNull() for c in key])).alias("__keyless")
    found = rows.groupBy(*partition).agg(keyless).collect()  # partitions, each a folder
    touched = [tuple(r)[:-1] for r in found]
    if any(r["__keyless"] for r in found):
        raise ValueError(f"{path}: a row of {name} has no {' or no '.join(key)}")
    there = [n for n in files.names() if not n.startswith(("_", "."))]
    held = of_partitions(spark.read.schema(rows.schema).parquet(path), touched, partition) if there else spark.createDataFrame([], rows.schema)
    merged = put_for(held, rows, key).repartitionByRange(*partition, *key) if replace else latest_over(held, rows, key, partition, order)
    merged.select(*columns).write.partitionBy(*partition).parquet(f"{path}/{JOURNAL}/{name}/data")
    files.write(f"{JOURNAL}/{name}/schema.json", rows.schema.json())
    _put_in_place(files, name, partition)
    return True

