"""One document of each class of near copies, for pipelines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm import _bloom
from furlong.llm._shared import stored
from furlong.llm.ngram_join import rows_with_classes, text_hash


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their class, with all columns: of each class the row of the smallest id
    (of rows of one id the one of the smallest text hash), once even where it is repeated.

    Rows of null id and rows without words, texts of null among them, all stay, repeated or not.  Rows of one id and different texts are different documents.
    Other columns are kept, whatever their names; of repeated rows that differ in those alone one stays.  An empty table gives an empty one.

    A document that certainly stays needs no join: the rows of classes of more than one row are looked
    up in a Bloom filter first, and only possible hits are joined exactly.
    """
    classes = rows_with_classes(docs, id_col, text_col).filter("root is not null and id is not null").select("root", F.col("id").alias("i"), "h")
    first = F.struct("i", "h")
    large = classes.groupBy("root").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    members = stored(classes.join(large, "root").select("i", "h", (first == F.col("first")).alias("stays")).distinct(), "members")
    bits = docs.sparkSession.sparkContext.broadcast(_bloom.bloom(members.select("i", "h"), members.count()))

    @F.pandas_udf("boolean")
    def possible(i: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(_bloom.may_hold(bits.value, i.to_numpy(np.int64), h.to_numpy(np.int64)))

    i, h, hit, stays = (_unused(docs, x) for x in ("i", "h", "hit", "stays"))
    tagged = docs.withColumn(i, F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long"))).withColumn(h, text_hash(id_col, text_col)).withColumn(hit, possible(i, h) & F.col(id_col).isNotNull())
    free = tagged.filter(~F.col(hit)).select(*docs.columns)
    known = members.select(F.col("i").alias(i), F.col("h").alias(h), F.col("stays").alias(stays))
    joined = tagged.filter(hit).join(known, [i, h], "left")
    alone = joined.filter(F.col(stays).isNull()).select(*docs.columns)
    kept = joined.filter(stays).dropDuplicates([i, h]).select(*docs.columns)
    return free.unionByName(alone).unionByName(kept)


def _unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
