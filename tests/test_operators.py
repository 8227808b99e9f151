"""Small cases of the racing operators."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.functions import scalars
from furlong.operators import asof, evaluation, field, history, quality, rolling
from furlong.streaming.odds import run_to_parquet, windowed_prices

DAY = dt.datetime(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def runs(spark, positions, **more):
    base = {"course": "A", "distance_f": 8.0, "going": "Good", "race_class": 3, "flat_jumps": "FLAT", "field_size": 5, "official_rating": 60, "headgear": None, "trainer_id": 1, "jockey_id": 1, "sp_decimal": 4.0, "age": 4, "draw": 1}
    rows = [base | {"runner_id": i, "race_id": i, "horse_id": 7, "race_ts": DAY + dt.timedelta(days=i), "finishing_position": p} | {k: v[i] for k, v in more.items()} for i, p in enumerate(positions)]
    schema = "runner_id long, race_id long, horse_id long, race_ts timestamp, finishing_position int, course string, distance_f double, going string, race_class int, flat_jumps string, field_size int, official_rating int, headgear string, trainer_id long, jockey_id long, sp_decimal double, age int, draw int"
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def test_history_sees_only_earlier_runs(spark):
    h = history.with_history(runs(spark, [2, 5, 1, 3]))
    got = {r.runner_id: [p.race_id for p in r.past] for r in h.collect()}
    assert got == {0: [], 1: [0], 2: [1, 0], 3: [2, 1, 0]}
    form = {r.runner_id: r for r in history.current_form(h).collect()}
    assert form[0].first_time_out_flag == 1 and form[0].form_wins_last3 is None
    assert form[3].form_wins_last3 == 1 and form[3].form_places_last3 == 2 and form[3].form_last_run_position == 1


def test_same_time_runs_are_invisible(spark):
    rows = runs(spark, [1, 2]).withColumn("race_ts", F.lit(DAY))
    assert [r.n for r in history.with_history(rows).collect()] == [0, 0]
    assert {r.status for r in history.leakage(history.with_history(rows)).collect()} == {"PASSED"}


def test_unplaced_runs_count_as_starts(spark):
    got = history.course_distance_going(history.with_history(runs(spark, [None, None, 1]))).filter("runner_id = 2").first()
    assert (got.course_starts, got.course_wins, got.course_win_rate) == (2, 0, 0.0)


def test_slope_needs_two_values(spark):
    assert one(spark, history.slope(F.array(F.lit(1.0)))) is None
    assert abs(one(spark, history.slope(F.array(F.lit(3.0), F.lit(2.0), F.lit(1.0)))) - 1) < 1e-12


def test_percentile_counts_half_of_equals(spark):
    rows = spark.createDataFrame([(1, 1, 10), (1, 2, 10), (1, 3, 20), (1, 4, None)], "race_id int, runner_id int, official_rating int")
    got = {r.runner_id: r.percentile_in_field for r in field.versus_field(rows, "official_rating").collect()}
    assert got[1] == got[2] == 1 / 3 and abs(got[3] - 2.5 / 3) < 1e-12 and got[4] is None


def test_one_missing_price_voids_the_race(spark):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, None), (2, 3, 2.0), (2, 4, 4.0)], "race_id int, runner_id int, sp_decimal double")
    got = {r.runner_id: r.p_market for r in field.market_normalised(rows).collect()}
    assert got[1] is None and got[2] is None and abs(got[3] - 2 / 3) < 1e-12


def test_place_bands_never_fall(spark):
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate([0.9, 0.5, 0.1, 0.0])], "race_id int, runner_id int, model_score double")
    for r in field.place_probabilities(rows).collect():
        bands = [r[f"p_top{k}"] for k in range(2, 7)]
        assert bands == sorted(bands) and max(bands) <= 0.999


def test_trailing_window_is_strict_and_inclusive_at_its_start(spark):
    rows = runs(spark, [1, 2, 1]).withColumn("race_ts", F.when(F.col("runner_id") == 0, F.lit(DAY)).otherwise(F.lit(DAY + dt.timedelta(days=14))))
    got = {r.runner_id: r for r in rolling.strike_rates(rows, "trainer_id").collect()}
    assert [got[i].runs_14d for i in range(3)] == [0, 1, 1] and abs(got[1].strike_rate_14d - 1.4 / 5) < 1e-12


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, DAY + dt.timedelta(hours=h)) for h in (1, 5, 9)], "k int, ts timestamp")
    right = spark.createDataFrame([(1, DAY + dt.timedelta(hours=5), "a"), (1, DAY + dt.timedelta(hours=8), None), (2, DAY, "z")], "k int, at timestamp, v string")
    got = [(r.ts.hour, r.v_as_of) for r in asof.as_of_join(left, right, "k", "ts", "at", "v").orderBy("ts").collect()]
    assert got == [(1, None), (5, "a"), (9, None)]


def test_calibration_keeps_empty_buckets_and_closes_the_last(spark):
    rows = spark.createDataFrame([(1.0, 1), (0.05, 0)], "p double, y int")
    got = {r.bucket: r.n for r in evaluation.calibration(rows, "p", "y").collect()}
    assert got == {i: int(i in (0, 9)) for i in range(10)}


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "p double, y int")
    assert evaluation.roc_auc(rows, "p", "y").first().auc == 3.5 / 4
    assert evaluation.roc_auc(rows.filter("y = 1"), "p", "y").first().auc is None


def test_settlement(spark):
    each = lambda won, placed: one(spark, scalars.settle_each_way(F.lit(won), F.lit(placed), F.lit(6.0), F.lit(0.2)))
    assert abs(each(True, True) - 6.0) < 1e-12 and each(False, True) == 0.0 and each(False, False) == -2.0


def test_names_and_islands(spark):
    assert one(spark, quality.normalize_name(F.lit("  Étoile  d'Or, St. 日 "))) == "etoile dor st"
    rows = spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "g int, at int, k string")
    assert [r.island for r in quality.islands(rows, "g", ["at"], "k").orderBy("at").collect()] == [1, 1, 2, 2, 3]


def test_empty_tables(spark):
    rows = runs(spark, [1]).filter("false")
    assert history.current_form(history.with_history(rows)).count() == 0
    assert rolling.draw_bias(rows).count() == 0
    assert quality.missing_days(rows).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    ticks = [(1, "b", DAY + dt.timedelta(minutes=m), 2.0 + m, m) for m in (1, 30, 70, 90, 600)]
    schema = "runner_id long, bookmaker string, tick_ts timestamp, price double, event_id long"
    batch = spark.createDataFrame(ticks, schema)
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run_to_parquet(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    done = spark.read.parquet(str(tmp_path / "out"))
    want = windowed_prices(batch).filter(F.col("window_start") < F.lit(DAY + dt.timedelta(hours=7)))  # the last window is still open
    key = ["window_start", "runner_id"]
    assert [tuple(r) for r in done.orderBy(key).collect()] == [tuple(r) for r in want.orderBy(key).collect()]


def careers(spark, seed, n=400):
    """Runs of a few horses, many on one day, one horse without a name, places and goings missing."""
    rnd = random.Random(seed)
    rows = [(i, i // 3, rnd.choice([None, 1, 2, 3, 4]), f"2024-{rnd.randint(1, 3):02d}-{rnd.randint(1, 28):02d}", rnd.choice([None, 1, 2, 3, 4, 7]), rnd.choice([1, 8, 9]), rnd.choice(["York", "Ayr", None]), rnd.choice([5.0, 6.5, 6.25, 8.0, None]), rnd.choice(["Good", "Soft", None]), rnd.choice(["FLAT", "JUMPS"])) for i in range(n)]
    df = spark.createDataFrame(rows, "runner_id long, race_id long, horse_id long, day string, finishing_position int, field_size int, course string, distance_f double, going string, flat_jumps string")
    full = df.withColumns({"race_ts": F.col("day").cast("timestamp"), **{c: F.lit(None).cast("int") for c in ("race_class", "official_rating", "trainer_id")}, "headgear": F.lit(None).cast("string"), "sp_decimal": F.lit(None).cast("double")})
    return full.withColumn("finishing_position", F.when(F.col("finishing_position") <= F.col("field_size"), F.col("finishing_position")))


@pytest.mark.parametrize("seed", [1, 2])
def test_bounded_frames_equal_the_whole_past(spark, seed):
    rows = careers(spark, seed)
    whole = history.with_history(rows)
    for bounded, over_arrays in ((history.recent_form, history.current_form), (history.records, history.course_distance_going)):
        got, want = bounded(rows).toPandas().sort_values("runner_id"), over_arrays(whole).toPandas().sort_values("runner_id")
        assert got.columns.tolist() == want.columns.tolist() and len(got) == 400
        for c in got.columns:
            a, b = got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy()
            assert np.allclose(a, b, atol=1e-12, equal_nan=True), c


def test_totals_by_day_equal_windows(spark):
    rows = careers(spark, 3).withColumn("race_ts", F.col("race_ts") + F.make_dt_interval(F.lit(0), (F.col("runner_id") % 5).cast("int")))
    sets = {"a": ["horse_id", "course"], "b": ["flat_jumps"]}
    sums = {"runs": F.lit(1).cast("long"), "first": rolling.hits(F.col("finishing_position") == 1)}
    got = {tuple(r) for r in rolling.totals(rows, sets, sums, ["runner_id", "course"]).collect()}
    window = {f"{k}_{n}": rolling.within(c, ks, None) for k, ks in sets.items() for n, c in sums.items()}
    want = {tuple(r) for r in rows.select("runner_id", "course", *[c.alias(k) for k, c in window.items()]).collect()}
    assert got == want and len(got) == 400
