"""Aligned frames against pandas, and sectional points with gaps, repeats and clocks gone wrong."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from furlong.operators import frames, sectionals


def test_places_follow_the_order_of_reading(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 5).withColumn("x", F.col("id") * 3).write.parquet(path)
    rows = spark.read.parquet(path)
    got = frames.placed(rows).collect()
    assert [r.place for r in got] == list(range(1000)) and [r.id for r in got] == [r.id for r in rows.collect()]
    assert frames.placed(rows.filter("id < 0")).count() == 0
    some = frames.placed(spark.range(0, 40, 1, 8).filter("id % 10 = 7")).collect()
    assert [(r.id, r.place) for r in some] == [(7, 0), (17, 1), (27, 2), (37, 3)]


def test_alignment_equals_reindex(spark):
    rnd = random.Random(1)
    left = pd.DataFrame({"place": range(300), "k": [rnd.choice([None, *range(40)]) for _ in range(300)]})
    odds = pd.DataFrame({"k": range(30), "odds": [rnd.random() if i % 4 else None for i in range(30)]})
    frame = spark.createDataFrame([(int(p), None if pd.isna(k) else int(k)) for p, k in left.itertuples(index=False)], "place long, k long")
    side = spark.createDataFrame([(int(i), int(k), None if pd.isna(o) else o) for i, (k, o) in enumerate(odds.itertuples(index=False))], "place long, k long, odds double")
    twice = side.union(side.withColumn("place", F.col("place") + 100).withColumn("odds", F.lit(-1.0)))  # later rows of a key don't count
    other = spark.createDataFrame([(0, 5, "a", None), (1, 5, "b", 1), (2, 6, None, None)], "place long, k long, note string, n int")
    got = frames.aligned(frame, "k", {"odds": (twice, ["odds"]), "notes": (other, ["note", "n"])}).toPandas().sort_values("place")
    want = odds.set_index("k")["odds"].reindex(left["k"]).reset_index(drop=True)
    assert len(got) == 300 and got["place"].tolist() == left["place"].tolist()
    assert got["odds"].reset_index(drop=True).equals(want) and (got["has_odds"].to_numpy() == want.notna().to_numpy()).all()
    assert set(got.loc[got.k == 5, "note"]) <= {"a"} and got.loc[got.k == 5, "n"].isna().all() and not got.loc[got.k == 6, "has_notes"].any()


def test_ordered_dedup_equals_a_dictionary(spark):
    rnd = random.Random(2)
    keys = [rnd.choice([None, "a", "b", "c", "d"]) for _ in range(200)]
    rows = spark.createDataFrame([(i, k, i * 2) for i, k in enumerate(keys)], "place long, k string, v long")
    got = sorted((r.place, r.k, r.v) for r in frames.first_of_each(rows.repartition(7), ["k"]).collect())
    assert got == [(keys.index(k), k, 2 * keys.index(k)) for k in dict.fromkeys(keys)]
    marked = [(r.place, r.first) for r in frames.marked_first(rows, "k").collect()]
    assert {p for p, first in marked if first} == {keys.index(k) for k in set(keys)} | {i for i, k in enumerate(keys) if k is None} and len(marked) == 200
    assert [r.p for r in rows.select(frames.present(["k"]).alias("p")).collect()] == [k is not None for k in keys]


def points(spark, rows):
    full = [(r, s, d, t, None, None, c, "gps", at) for r, s, d, t, c, at in rows]
    return spark.createDataFrame(full, "runner_id long, segment_index int, distance_f double, seconds double, speed_mps double, position_in_race int, clock double, source string, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))


def test_gaps_are_filled_within_the_clock(spark):
    rows = [(1, 0, 1.0, 12.0, 12.0, "2024-01-01"), (1, 3, 1.0, 14.0, 53.0, "2024-01-01"), (2, 1, 2.0, 24.0, None, "2024-01-01"), (2, 3, 1.0, 14.0, 9.0, "2024-01-01"), (3, 0, 1.0, 12.0, 12.0, "2024-01-01"), (3, 2, 1.0, 13.0, 20.0, "2024-01-01"), (4, 2, 1.0, None, None, "2024-01-01"), (4, 4, 1.0, 12.0, None, "2024-01-01")]
    got = {(r.runner_id, r.segment_index): (r.seconds, r.filled) for r in sectionals.whole_sequences(points(spark, rows)).collect()}
    assert got[1, 1] == got[1, 2] == (13.5, True) and got[1, 0] == (12.0, False)  # 53 - 14 - 12 in two shares
    assert got[2, 2] == (pytest.approx((12 + 14) / 2 * 2), True)  # half-way in pace, over the neighbour's distance
    assert got[3, 1] == (pytest.approx(12.5), True)  # the clock leaves nothing: pace instead
    assert got[4, 3] == (None, True) and len(got) == 4 + 3 + 3 + 3
    ends = sectionals.filled(points(spark, rows[:2]), spark.createDataFrame([(1, 6), (9, 2)], "runner_id long, n_segments int"))
    whole = {(r.runner_id, r.segment_index): (r.seconds, r.filled) for r in ends.collect()}
    assert whole[1, 4] == whole[1, 5] == whole[9, 0] == whole[9, 1] == (None, False) and len(whole) == 8
    total = {r.runner_id: (r.segments, r.filled, r.seconds) for r in sectionals.summaries(sectionals.whole_sequences(points(spark, rows))).collect()}
    assert total[1] == (4, 2, 53.0) and total[4][2] is None


def test_repeats_and_bad_points_are_told(spark):
    rows = [(1, 0, 1.0, 12.0, None, "2024-01-01"), (1, 0, 1.0, 11.0, None, "2024-01-02"), (1, 0, 1.0, 11.0, None, "2024-01-02"), (1, None, 1.0, 1.0, None, None), (1, -1, 1.0, 0.0, None, None), (None, 1, 0.0, 1.0, None, None), (1, 1, None, None, None, None)]
    kept, rejected = sectionals.one_each(points(spark, rows))
    assert sorted((r.segment_index, r.seconds) for r in kept.collect()) == [(0, 11.0), (1, None)]
    assert sorted(r.reason for r in rejected.collect()) == ["runner is missing; distance is not positive", "segment is missing", "segment is negative; time is not positive", "superseded", "superseded"]


def test_clocks_are_checked(spark):
    rows = [(1, 0, 1.0, 12.0, 12.0, None), (1, 1, 1.0, 13.0, 25.2, None), (1, 2, 1.0, 13.0, 40.0, None), (1, 3, 1.0, 1.0, 39.0, None), (1, 6, 1.0, 2.0, 90.0, None), (1, 7, 1.0, None, 95.0, None), (1, 8, 1.0, 1.0, None, None), (2, 0, 1.0, 1.0, 1.0, None)]
    got = {(r.runner_id, r.segment_index): r.status for r in sectionals.ordered(points(spark, rows)).collect()}
    assert got == {(1, 0): "ok", (1, 1): "ok", (1, 2): "off", (1, 3): "backwards", (1, 6): "ok", (1, 7): "ok", (1, 8): "ok", (2, 0): "ok"}
