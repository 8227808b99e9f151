"""Merges, results, provenance and joined tables: what is written, what stays, and what happens after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from furlong.operators import merge, provenance, results, wide_rows
from furlong.operators.mapping import MappingError
from furlong.sources.shared import Files

KEY, PART = ["day", "id"], ["day"]
SCHEMA = "day string, id long, a int, b string"


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-") and f"{os.sep}{merge.JOURNAL}" not in d}


def rows(spark, path):
    return sorted((tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).select("day", "id", "a", "b").collect()), key=str)


def test_merge_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    assert merge.merge_into(path, make([("d1", 1, 1, "x"), ("d1", 2, 2, "y"), ("d2", 3, 3, "z")]), "a", KEY, PART)
    before = files(path)
    assert merge.merge_into(path, make([("d1", 1, None, "new"), ("d1", 9, 9, None), ("d3", 4, 4, "w")]), "b", KEY, PART)
    after = files(path)
    want = sorted([("d1", 1, 1, "new"), ("d1", 2, 2, "y"), ("d1", 9, 9, None), ("d2", 3, 3, "z"), ("d3", 4, 4, "w")], key=str)
    assert rows(spark, path) == want
    d2 = lambda found: {k: v for k, v in found.items() if "day=d2" in k}
    assert d2(before) == d2(after) and d2(before)
    assert not {k for k in before if "day=d1" in k} & set(after)
    assert not merge.merge_into(path, make([("d2", 3, 0, "no")]), "b", KEY, PART)
    assert files(path) == after and rows(spark, path) == want
    assert Files(spark, path).names(merge.JOURNAL) == ["a.done", "b.done"]


@pytest.mark.parametrize("lost", ["before", "between", "after"])
def test_a_merge_ends_well_after_a_failure(spark, tmp_path, monkeypatch, lost):
    """The job is lost while it writes, before it puts in place, or before it marks the batch as done."""
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    merge.merge_into(path, make([("d1", 1, 1, "x"), ("d2", 3, 3, "z")]), "a", KEY, PART)
    late, put = make([("d1", 1, 5, None), ("d2", 8, 8, "v")]), merge._put_in_place
    bad = late.withColumn("a", F.when(F.col("id") == 8, F.raise_error("lost").cast("int")).otherwise(F.col("a")))
    if lost == "before":
        with pytest.raises(Exception, match="lost"):
            merge.merge_into(path, bad, "b", KEY, PART)
    elif lost == "between":
        monkeypatch.setattr(merge, "_put_in_place", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            merge.merge_into(path, late, "b", KEY, PART)
        monkeypatch.setattr(merge, "_put_in_place", put)
    else:
        write = Files.write
        monkeypatch.setattr(Files, "write", lambda self, name, text: (_ for _ in ()).throw(RuntimeError("lost")) if name.endswith(".done") else write(self, name, text))
        with pytest.raises(RuntimeError):
            merge.merge_into(path, late, "b", KEY, PART)
        monkeypatch.setattr(Files, "write", write)
    assert merge.merge_into(path, make([("d3", 7, 7, "n")]), "c", KEY, PART)  # finishes what was ready
    assert merge.merge_into(path, late, "b", KEY, PART) == (lost == "before")
    assert rows(spark, path) == sorted([("d1", 1, 5, "x"), ("d2", 3, 3, "z"), ("d2", 8, 8, "v"), ("d3", 7, 7, "n")], key=str)


def test_merges_of_repeated_null_and_replaced_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, SCHEMA)
    merge.merge_into(path, make([("d1", 1, 1, "x"), ("d1", 1, 3, "y"), ("d1", 1, None, "w")]), "a", KEY, PART, order="a")
    assert rows(spark, path) == [("d1", 1, 3, "y")]
    with pytest.raises(ValueError, match="has no day or no id"):
        merge.merge_into(path, make([("d1", None, 1, "x")]), "b", KEY, PART)
    merge.merge_into(path, make([]), "c", KEY, PART)
    assert rows(spark, path) == [("d1", 1, 3, "y")]
    merge.merge_into(path, make([("d1", 1, 7, None), ("d1", 1, 8, "q")]), "d", KEY, PART, replace=True)
    assert rows(spark, path) == [("d1", 1, 7, None), ("d1", 1, 8, "q")]


def test_results_leave_out_what_says_nothing(spark, tmp_path):
    known = spark.createDataFrame([(i, 1, None, p, 3, 0.2) for i, p in ((1, 4.0), (2, None), (3, 2.0), (4, None))], "runner_id long, race_id long, race_ts timestamp, current_price double, places int, place_fraction double").withColumn("race_ts", F.lit("2024-05-06").cast("timestamp"))
    submitted = spark.createDataFrame([(1, 1, None, None, None), (2, None, "  ", None, None), (3, 3, "", 6.0, None), (4, None, "PU", None, 9.0), (5, 1, None, 2.0, None)], "runner_id long, finishing_position int, finish_status string, starting_price double, closing_price double")
    out = results.settled(submitted, known)
    got = {r.runner_id: (r.finishing_position, r.finish_status, r.starting_price, r.place_outcome, r.pl_win, r.race_month) for r in out.collect()}
    assert got == {1: (1, None, 4.0, True, 3.0, "2024-05"), 3: (3, None, 6.0, True, -1.0, "2024-05"), 4: (None, "PU", None, False, None, "2024-05")}
    path = str(tmp_path / "r")
    assert results.write_results(path, out, "x") and not results.write_results(path, out, "x")
    assert [(r.race_id, r.race_status) for r in spark.read.parquet(f"{path}/races").collect()] == [(1, "RESULTED")]


def test_entries_of_one_payload_fold(spark, tmp_path):
    rows = spark.createDataFrame([(1, "p", "2024-01-01", "x"), (1, "p", "2024-01-03", "x"), (1, "p", "2024-01-02", "y"), (1, None, "2024-01-02", "y"), (2, "q", "2024-01-01", None)], "race_id long, provider string, at string, going string")
    log = provenance.entries(rows, "Race", "race_id", F.col("provider"), F.col("at"), ["race_id", "going"])
    path = str(tmp_path / "log")
    assert provenance.record(path, log, "b1") == 5 and provenance.record(path, log.limit(1), "b1") == 5
    held = spark.read.parquet(path)
    got = sorted((r.entity_id, r.provider, str(r.first_seen)[:10], str(r.last_seen)[:10], r.times, r.versions, r.current) for r in provenance.folded(held).collect() if r.provider)
    assert got == [("1", "p", "2024-01-01", "2024-01-03", 2, 2, True), ("1", "p", "2024-01-02", "2024-01-02", 1, 2, False), ("2", "q", "2024-01-01", "2024-01-01", 1, 1, True)]
    ids = spark.createDataFrame([(1,), (2,), (3,), (1,)], "race_id long")
    assert {r.race_id: r.providers for r in provenance.providers(ids, held).collect()} == {1: ["p"], 2: ["q"], 3: [provenance.LEGACY]}
    assert provenance.providers_of_set(ids, held).first()[0] == ["p", "q"]
    assert provenance.providers_of_set(ids.filter("race_id = 3"), held).first()[0] == [provenance.LEGACY] and provenance.providers_of_set(ids.filter("false"), held).first()[0] == []
    assert [(r.entity_id, r.payloads) for r in provenance.changed(held).collect()] == [("1", 2)]
    assert len({r.entry_key for r in held.collect()}) == 4


@pytest.fixture
def dataset(spark):
    races = spark.range(3000).select((F.col("id") % 50).alias("course_no"), F.concat(F.lit("R"), "id").alias("ref"), (F.col("id") % 900).cast("string").alias("no"), F.lit("York").alias("course"))
    runners = spark.range(12_000).select(F.concat(F.lit(" R"), (F.col("id") / 4).cast("long")).alias("race"), (F.col("id") % 50).alias("jockey_no"), F.concat(F.lit("h"), "id").alias("horse"), F.col("id").alias("n"))
    return races, runners


@pytest.mark.parametrize("k", [64, 1024, 1 << 14])
def test_the_key_is_found_among_decoys(dataset, k):
    races, runners = dataset
    pair = wide_rows.join_key(races, runners, k=k)
    assert (pair.race_column, pair.runner_column) == ("ref", "race") and pair.contained == 1 and pair.unique > 0.85
    assert wide_rows.joined(races, runners, pair).count() == 12_000


def test_sketches_measure_containment(spark):
    a, b = wide_rows.collected(wide_rows.sketches(spark.range(20_000).toDF("x"))), wide_rows.collected(wide_rows.sketches(spark.range(10_000, 40_000).toDF("y")))
    assert abs(wide_rows.contained(a["x"], b["y"]) - 0.5) < 0.06 and abs(wide_rows.contained(b["y"], a["x"]) - 1 / 3) < 0.06
    assert abs(wide_rows.distinct_of(a["x"]) / 20_000 - 1) < 0.1


def test_joins_that_would_be_guesses_are_refused(spark, dataset):
    races, runners = dataset
    with pytest.raises(MappingError, match="named in one table only"):
        wide_rows.join_key(races, runners, {"ref": "race_id"}, {"horse": "horse_name"})
    with pytest.raises(MappingError, match="share no value"):
        wide_rows.join_key(races, runners, {"ref": "race_id"}, {"horse": "race_id"})
    assert wide_rows.join_key(races, runners, {"ref": "race_id"}, {"race": "race_id"}).contained == 1
    with pytest.raises(MappingError, match="no columns that join"):
        wide_rows.join_key(races.drop("ref"), runners)
    with pytest.raises(MappingError, match="several columns"):
        wide_rows.join_key(races.withColumn("twin", F.col("ref")), runners)
    with pytest.raises(MappingError, match="no one race-level"):
        wide_rows.wide_rows({"a": races, "b": races})
    assert wide_rows.wide_rows({"a": races}) is races


def test_no_runner_is_doubled(spark):
    races = spark.createDataFrame([(1.0, "b", "York"), (1.0, "a", "York"), (2.0, "c", "Ayr"), (None, "d", "Ayr")], "id double, name string, course string")
    runners = spark.createDataFrame([("1", "x", "n"), ("2", "y", None), (None, "z", "n"), ("", "w", "n"), ("3", "v", "n")], "race string, horse string, name string")
    out = wide_rows.joined(races, runners, wide_rows.Pair("id", "race", 1, 1))
    assert sorted(tuple(r) for r in out.select("race", "horse", "name_runner", "name_race").collect()) == [("1", "x", "n", "a"), ("2", "y", None, "c")]
