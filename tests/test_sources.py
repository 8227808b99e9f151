"""Quantiles, mappings, typed cells and streamed names on small rows."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.operators import cells, mapping
from furlong.operators.quantiles import quantile_values, quantiles
from furlong.sources import files
from furlong.streaming.names import named_prices


@pytest.mark.parametrize("buckets", [2, 7, 256])
def test_quantiles_equal_plain_ones(spark, buckets):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=997).tolist(), [None if i % 3 else float(i % 5) for i in range(997)]
    df = spark.createDataFrame([(x, y, None, 4.0 if i == 5 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))], "a double, b double, c double, d double")
    got = {(r.feature, r.share): r.value for r in quantiles(df, ["a", "b", "c", "d"], [0.0, 0.05, 0.5, 0.95, 1.0], buckets).collect()}
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        assert math.isclose(got["a", q], np.quantile(a, q), abs_tol=1e-12)
        assert math.isclose(got["b", q], np.quantile([x for x in b if x is not None], q), abs_tol=1e-12)
        assert got["d", q] == 4.0 and ("c", q) not in got
    assert quantile_values(df.filter("false"), ["a"], [0.5]) == {}


def test_roles_of_columns():
    want = {"Race Date": ("race_date", "high"), "horse_id_number": ("horse_id", "medium"), "OR": ("official_rating", "low"), "zzz": (None, "unmapped"), "": (None, "unmapped"), "SP (Decimal)": ("starting_price", "high")}
    assert mapping.proposal(list(want)) == want
    assert mapping.kind(["course", "jockey"]) == "race_and_runner_level" and mapping.kind(["x"]) == "unknown"
    assert mapping.ambiguous(["horse", "OR"]) == ["OR"]


def test_mappings_are_checked(spark):
    rows = spark.createDataFrame([("2024-05-01", "York", "A", "1.5"), ("soon", None, "B", None)], "`Date` string, racecourse string, Horse string, `a.b` string")
    held = mapping.confident(rows.columns)
    assert held == {"Date": "race_date", "Horse": "horse_name"}
    with pytest.raises(mapping.MappingError):
        mapping.mapped(rows, held)
    for wrong in ({"nope": "course"}, {"racecourse": "nope"}, {"racecourse": "horse_name"}):
        with pytest.raises(mapping.MappingError):
            mapping.reviewed(held, rows.columns, wrong)
    full = mapping.reviewed(held, rows.columns, {"racecourse": "course", "a.b": "weight"})
    assert [tuple(r) for r in mapping.mapped(rows, full).collect()] == [("2024-05-01", "A", "York", "1.5"), ("soon", "B", None, None)]
    assert [str(x) for x in mapping.date_range(rows).first()] == ["Date", "2024-05-01", "2024-05-01"]
    got = {r.column_name: (r.rows, r.present_pct, r.samples, r.role) for r in mapping.profile(rows, "Horse").collect()}
    assert got["racecourse"] == (2, 50.0, ["York"], "course") and got["a.b"][2:] == (["1.5"], None)


def test_cells_of_another_type_are_refused(spark):
    rows = spark.createDataFrame([("a", "NUMERIC", "2"), ("a", "TEXT", "2"), ("b", "BOOLEAN", "maybe"), ("b", "BOOLEAN", None), (None, "TEXT", "x"), ("c", "CATEGORY", "x")], "key string, kind string, text string")
    got = cells.typed_cells(rows, {"a": "NUMERIC", "b": "BOOLEAN", "c": "CATEGORY"}).withColumn("value", cells.read_cell()).collect()
    assert [(r.value, r.error) for r in got] == [("2.0", None), (None, "a expects NUMERIC, got TEXT"), (None, "b holds no BOOLEAN"), (None, None), (None, "unknown key null"), ("x", None)]


def test_streamed_names_equal_those_of_a_batch(spark, tmp_path):
    def line(pt, market, name=None, price=None):
        mc = {"id": market} | ({"marketDefinition": {"runners": [{"id": 7, "name": name}]}} if name else {}) | ({"rc": [{"id": 7, "ltp": price}]} if price else {})
        return json.dumps({"op": "mcm", "pt": pt, "mc": [mc]})

    parts = [[line(1, "a", "X"), line(2, "a", price=2.0), line(1, "b", price=9.0), "{oops"], [line(3, "a", price=3.0), line(4, "a", "Y"), line(5, "a", price=4.0)], [line(6, "a", price=5.0), line(7, "b", "Z", 6.0)]]
    (tmp_path / "in").mkdir()
    for i, lines in enumerate(parts):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines) + "\n")
        os.utime(tmp_path / "in" / f"{i}.txt", (1_700_000_000 + i, 1_700_000_000 + i))
    numbered = lambda df: df.withColumn("seq", F.lit(0))
    stream = numbered(spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in")))
    messages, _ = files.exchange_messages(stream)
    q = named_prices(messages, "seq").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    got = sorted((r.market, r.pt, r.selection, r.name, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    whole, _ = files.exchange_messages(numbered(spark.read.text(str(tmp_path / "in"))))
    want = sorted((r.market, r.pt, r.selection, r.name, r.price) for r in files.exchange_prices(whole, "seq").withColumn("pt", F.unix_millis("tick_ts")).collect())
    assert got == want and len(got) == 6
