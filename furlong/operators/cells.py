"""Values of features stored one to a row, each in the column of its type."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ["NUMERIC", "TEXT", "BOOLEAN", "CATEGORY"]


def typed_cells(values: DataFrame, definitions: dict[str, str], key: str = "key", kind: str = "kind", text: str = "text") -> DataFrame:
    """Adds numeric_value, text_value, boolean_value and error.

    A value goes where its type belongs; a key without a definition, a type other than the
    definition's, or a text that isn't of its type leaves all three null and gives an error.
    """
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(definitions.items())])
    expected = F.try_element_at(known, F.col(key))
    of = lambda kinds, value: F.when(F.col(kind).isin(kinds), value)
    cells = {"numeric_value": of(["NUMERIC"], F.expr(f"try_cast(`{text}` as double)")), "text_value": of(["TEXT", "CATEGORY"], F.col(text)), "boolean_value": of(["BOOLEAN"], F.expr(f"try_cast(`{text}` as boolean)"))}
    error = (
        F.when(expected.isNull(), F.concat(F.lit("unknown key "), F.coalesce(F.col(key), F.lit("null"))))
        .when(~F.col(kind).eqNullSafe(expected), F.concat(F.col(key), F.lit(" expects "), expected, F.lit(", got "), F.coalesce(F.col(kind), F.lit("null"))))
        .when(F.col(text).isNotNull() & F.coalesce(*[v.cast("string") for v in cells.values()]).isNull(), F.concat(F.col(key), F.lit(" holds no "), expected))
    )
    rows = values.withColumn("error", error)
    return rows.withColumns({c: F.when(F.col("error").isNull(), v) for c, v in cells.items()})


def read_cell() -> Column:
    """The one value that a row holds, as text."""
    return F.coalesce(F.col("numeric_value").cast("string"), F.col("boolean_value").cast("string"), F.col("text_value"))
