"""Readers and import on small files."""

import datetime as dt
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from furlong.functions import betting
from furlong.operators import ingest
from furlong.operators.explain import explanation
from furlong.sources import files
from furlong.streaming.odds import idempotent_sink, once

HEADER = "race_date,race_time,racecourse,horse_name,weight_lbs_total,non_runner\n"


def test_race_cards_of_all_kinds(spark, tmp_path):
    text = HEADER + '2024-05-01,14:00,Ascot,"Red, ""the"" Rum",130.0,yes\n2024-05-01,14:00,Ascot,,x,\n01/05/2024,15:00,York,Blue,,no\n'
    (tmp_path / "a.csv").write_text(text)
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write(text)
    for name in ("a.csv", "b.csv.gz"):
        got = files.race_card(spark, str(tmp_path / name)).collect()
        assert [(r.horse_name, r.weight_lbs_total, r.non_runner, r.errors) for r in got] == [('Red, "the" Rum', 130, True, []), (None, None, False, ["horse_name is missing", "weight_lbs_total is no number"]), ("Blue", None, False, ["race_date is no ISO date"])]
        assert got[0].surface == "TURF" and got[0].race_date == dt.datetime(2024, 5, 1)
    races = [{"race_date": "2024-05-01", "racecourse": "Ascot", "unknown": 1, "runners": [{"horse_name": "A", "draw": "3"}, {"horse_name": "B"}]}, {"race_date": "2024-05-02", "racecourse": "York", "runners": [{"horse_name": "C"}]}]
    for name, body in (("l.jsonl", "\n".join(map(json.dumps, races))), ("a.json", json.dumps(races, indent=1)), ("o.json", json.dumps({"races": races}, indent=1))):
        (tmp_path / name).write_text(body)
        got = sorted((r.racecourse, r.horse_name, r.draw) for r in files.race_card(spark, str(tmp_path / name)).collect())
        assert got == [("Ascot", "A", 3), ("Ascot", "B", None), ("York", "C", None)], name
    with pytest.raises(ValueError):
        files.race_card(spark, "x.parquet")


def test_starting_prices_from_csv_and_zip(spark, tmp_path):
    text = "EVENT_DT,SELECTION_NAME,BSP,OTHER\n01-05-2024 14:00,Red,3.5,x\n32-05-2024,Blue,2,x\n02-05-2024,Green,n/a,x\n"
    (tmp_path / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("d/one.csv", text)
        z.writestr("two.txt", "no")
    for name in ("a.csv", "b.zip"):
        assert [tuple(r) for r in files.starting_prices(spark, str(tmp_path / name)).collect()] == [(dt.date(2024, 5, 1), "Red", 3.5)]
    (tmp_path / "c.csv").write_text("A,B\n1,2\n")
    with pytest.raises(ValueError):
        files.starting_prices(spark, str(tmp_path / "c.csv"))


def test_a_batch_is_imported_once(spark, tmp_path):
    rows = lambda *keys: spark.createDataFrame([(k, k * 2) for k in keys], "k int, v int")
    path = str(tmp_path / "t")
    assert ingest.append_once(rows(1, 2, 2), path, ["k"], "a") == {"created": 2, "skipped": 1}
    assert ingest.append_once(rows(2, 3), path, ["k"], "b") == {"created": 1, "skipped": 1}
    assert ingest.append_once(rows(2, 3), path, ["k"], "b") == {"created": 0, "skipped": 2}
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_split_races_are_whole_again(spark):
    rows = spark.createDataFrame([("r1", "FLAT", "A", 1), ("r2", "JUMPS", "B", 2), ("r1", "JUMPS", "C", 3)], "key string, code string, horse string, line int")
    got = {r.key: (r.code, [x.horse for x in r.runners]) for r in ingest.grouped_races(rows, ["key"], ["code"], ["horse"], "line").collect()}
    assert got == {"r1": ("FLAT", ["A", "C"]), "r2": ("JUMPS", ["B"])}


def test_prices_in_words(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(betting.decimal_from(F.lit(t))) for t in ("5/2", "5-2", "EVS", " even ", "1/0", "abc", None)] == [3.5, 3.5, 2.0, 2.0, None, None, None]
    assert [one(betting.fractional(F.lit(p))) for p in (3.5, 2.0, 1.01, 1.333, 1.0)] == ["5/2", "1/1", "1/100", "1/3", None]
    assert one(betting.valid_terms(F.lit(0), F.lit(0.2))) is False and one(betting.valid_price(F.lit(float("nan")))) in (False, True)


def test_explanations_of_relative_speed(spark):
    names = ["recent_runs", "competitive", "distance_starts", "distance_wins", "course_starts", "course_wins", "going_starts", "going_wins", "going_places", "rating", "best_rating", "movement", "weight", "field_weight", "field_weights", "collapse", "evidence", "starts"]
    c = {n: F.lit(None).cast("double") for n in names} | {"role": F.lit("LEADER"), "first_headgear": F.lit(False), "acceleration_pct": F.lit(0.85), "finish_pct": F.lit(0.1), "collapse": F.lit(0.5)}
    got = spark.range(1).select(*[v.alias(k) for k, v in explanation(c).items()]).first()
    assert len(got.positive) == 1 and "top 20%" in got.positive[0] and len(got.negative) == 2 and got.uncertain == []


def test_stream_without_repeats_into_a_repeatable_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 1))], "k int, tick_ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = once(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"])
    write = idempotent_sink(str(tmp_path / "out"))
    stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_lines_of_starting_prices_never_vanish(spark, tmp_path):
    """What can't be taken is told with its reason, from plain files and from archives alike."""
    body = "EVENT_DT,SELECTION_NAME,BSP\n01-05-2024 13:00,Red,4.5\n2024-05-01,Blue,2\n01-05-2024,,3\n01-05-2024,Green,much\n01-05-2024,Grey\n01-05-2024,Pink,2,9\n02-05-2024,White,7\n"
    (tmp_path / "p.csv").write_text(body)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.csv", body)
        z.writestr("none.csv", "A,B\n1,2\n")
    want = {("2024-05-01,Blue,2", "day is not DD-MM-YYYY"), ("01-05-2024,,3", "name is missing"), ("01-05-2024,Green,much", "price is no number"), ("01-05-2024,Grey", "not as many cells as the header"), ("01-05-2024,Pink,2,9", "not as many cells as the header")}
    for name in ("p.csv", "p.zip"):
        path = str(tmp_path / name)
        assert sorted(tuple(r) for r in files.starting_prices(spark, path).collect()) == [(dt.date(2024, 5, 1), "Red", 4.5), (dt.date(2024, 5, 2), "White", 7.0)]
        got = {tuple(r) for r in files.rejected_prices(spark, path).collect()}
        assert got == want | ({("none.csv: A,B", "not as many cells as the header")} if name == "p.zip" else set())
