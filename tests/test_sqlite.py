"""SQLite databases as source and sink: against plain reads, with filters, odd cells, and failures."""

import os
import sqlite3
from contextlib import closing
from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from furlong.sources import sqlite

SF = "/root/testdata/sf0.001"


@pytest.fixture
def db(tmp_path):
    path = str(tmp_path / "a.db")
    with closing(sqlite3.connect(path)) as con:
        con.execute('create table t (id integer primary key, name text collate nocase, price real, ok boolean, at datetime, day date, raw blob, "odd ""name" integer, any_)')
        rows = [(i, None if i % 7 == 0 else f"Név{i % 5}", i / 4, i % 2, f"2024-01-{i % 28 + 1:02d}T10:00:00.250+00:00", f"2024-02-{i % 28 + 1:02d}", b"x" * (i % 3), i * 10, f"v{i}") for i in range(1, 101) if i % 10]
        con.executemany("insert into t values (?,?,?,?,?,?,?,?,?)", rows)
        con.execute("create table w (k text primary key, v integer) without rowid")
        con.executemany("insert into w values (?, ?)", [(f"k{i}", i) for i in range(9)])
        con.execute("create view big as select * from t where price > 10")
        con.execute("create table none (a integer)")
        con.execute("create table bad (n integer, t datetime)")
        con.executemany("insert into bad values (?, ?)", [(1, 1_700_000_000_000), ("x", "2024-05-06"), (2, "soon")])
        con.commit()
    return path, rows


def plain(path, sql):
    with closing(sqlite3.connect(path)) as con:
        return sorted(con.execute(sql).fetchall(), key=str)


def test_four_tasks_equal_a_plain_read(spark, db):
    path, rows = db
    got = sqlite.scan(spark, path, "t", partitions=4)
    assert dict(got.dtypes) == {"id": "bigint", "name": "string", "price": "double", "ok": "boolean", "at": "timestamp", "day": "date", "raw": "binary", 'odd "name': "bigint", "any_": "string"}
    assert got.rdd.getNumPartitions() == 4
    back = sorted(got.collect())
    assert [tuple(r)[:3] + (int(r.ok), bytes(r.raw), r["odd \"name"], r.any_) for r in back] == [(r[0], r[1], r[2], r[3], r[6], r[7], r[8]) for r in rows]
    assert {(r.at.replace(tzinfo=None), r.day) for r in got.filter("id = 3").collect()} == {(datetime(2024, 1, 4, 10, 0, 0, 250_000), date(2024, 2, 4))}
    sizes = [n for (n,) in got.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 4 and max(sizes) <= 25


def test_only_named_columns_leave_the_database(spark, db):
    path, _ = db
    got = sqlite.scan(spark, path, "t", ["price", "id"], partitions=2)
    assert got.columns == ["price", "id"] and sorted(map(tuple, got.collect())) == sorted(plain(path, "select price, id from t"))
    assert sqlite.SqliteReader({"path": path, "table": "t"}, got.schema).schema.names == ["price", "id"]


CONDITIONS = [
    [("id", ">", 50)], [("id", "in", [3, 5, 70])], [("name", "=", "Név1")], [("name", "=", "NÉV1")], [("name", ">", "Név2")], [("name", "startswith", "Név")], [("name", "startswith", "név")], [("name", "is", None)],
    [("name", "is not", None), ("price", "<=", 7.25)], [("name", "<=>", "Név3")], [("ok", "=", True)], [("at", ">", "2024-01-10 00:00:00")], [("price", "=", 2)], [("price", ">", float("nan"))], [("price", "<", float("inf"))],
    [("name", "in", ["Név1", "x\0"])], [("name", "<", "O"), ("id", ">=", 90), ("id", "<", 99)], [('odd "name', ">=", 700)],
]


@pytest.mark.parametrize("where", CONDITIONS)
def test_conditions_give_what_spark_gives(spark, db, where):
    path, _ = db
    held = sqlite.scan(spark, path, "t", partitions=3)
    apart = spark.createDataFrame(held.collect(), held.schema)
    for t in where:
        apart = apart.filter(sqlite.as_column(*t))
    assert sorted(r.id for r in sqlite.scan(spark, path, "t", ["id"], where).collect()) == sorted(r.id for r in apart.collect())


def test_conditions_are_evaluated_by_the_database(spark, db):
    """Rows that a condition leaves out never leave SQLite, uses of one frame don't disturb each other, and the plan shows condition and columns."""
    path, _ = db
    where = [("id", ">", 90), ("name", "startswith", "N"), ("at", ">", "2024-01-01")]
    out = sqlite.scan(spark, path, "t", ["price"], where)
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "ReadSchema: struct<id:bigint,name:string,price:double,at:timestamp>" in plan and "(id" in plan.split("Condition")[1]
    reader = sqlite.SqliteReader({"path": path, "table": "t", "where": sqlite.json.dumps(where)}, sqlite.table_schema(path, "t"))
    rows = [r for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert reader.where == ['"id" > ?', 'substr("name", 1, ?) = ? collate binary'] and sorted(r["id"] for r in rows) == [92, 93, 94, 95, 96, 97, 99]
    whole = sqlite.scan(spark, path, "t", partitions=2)
    few = sqlite.scan(spark, path, "t", where=[("id", "<", 3)])
    assert whole.filter("id = 3").count() == 1 and whole.count() == 90 and few.union(whole.filter("id > 98")).union(few).count() == 5
    with pytest.raises(ValueError, match="no condition"):
        sqlite.scan(spark, path, "t", where=[("id", "like", "x")])
    with pytest.raises(ValueError, match="has no absent"):
        sqlite.scan(spark, path, "t", ["absent"])


def test_tables_without_rowid_views_and_empty_ones(spark, db):
    path, _ = db
    assert sqlite.table_names(path) == ["bad", "big", "none", "t", "w"]
    assert {(r.k, r.v) for r in sqlite.scan(spark, path, "w").collect()} == {(f"k{i}", i) for i in range(9)}
    assert sqlite.scan(spark, path, "big").count() == len(plain(path, "select * from big"))
    assert sqlite.scan(spark, path, "none").collect() == []
    with pytest.raises(Exception, match="no table"):
        sqlite.scan(spark, path, "absent")
    with pytest.raises(Exception, match="no database"):
        sqlite.scan(spark, os.path.dirname(path) + "/absent", "t")


def test_cells_that_do_not_fit(spark, db):
    path, _ = db
    with pytest.raises(Exception, match="is no"):
        sqlite.scan(spark, path, "bad").collect()
    got = sorted(((r.n, r.t and r.t.replace(tzinfo=None)) for r in sqlite.scan(spark, path, "bad", permissive=True).collect()), key=str)
    assert got == sorted([(1, datetime.fromtimestamp(1_700_000_000, UTC).replace(tzinfo=None)), (None, datetime(2024, 5, 6)), (2, None)], key=str)


def test_written_databases_read_alike(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("late", F.col("o_orderkey") % 3 == 0).withColumn("raw", F.lit(b"\x00\xff"))
    folder = str(tmp_path / "out")
    sqlite.save(orders.repartition(3), folder, "orders")
    assert len(sqlite.databases(folder)) == 3
    got = sqlite.scan(spark, folder, "orders", orders.columns)
    key = lambda df: sorted(map(str, df.select([F.col(c).cast("string") for c in orders.columns]).collect()))
    assert key(got) == key(orders.withColumn("o_orderdate", F.col("o_orderdate").cast(got.schema["o_orderdate"].dataType)))
    sqlite.save(orders.limit(5), folder, "orders")
    assert sqlite.scan(spark, folder, "orders").count() == orders.count() + 5
    sqlite.save(orders.limit(7), folder, "orders", "overwrite")
    assert sqlite.scan(spark, folder, "orders").count() == 7 and sorted(n for n in os.listdir(folder) if n.endswith(".sqlite")) == sorted(map(os.path.basename, sqlite.databases(folder)))
    sqlite.save(orders.filter("false"), folder, "orders", "overwrite")
    assert sqlite.scan(spark, folder, "orders").collect() == []


def test_a_failed_write_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    sqlite.save(spark.range(10), folder, "t")
    broken = spark.range(0, 100, 1, 4).withColumn("id", F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        sqlite.save(broken, folder, "t")
    assert sorted(r.id for r in sqlite.scan(spark, folder, "t").collect()) == list(range(10))


def test_racing_data_is_read_once(spark, tmp_path):
    path, folder = str(tmp_path / "racing.db"), str(tmp_path / "held")
    with closing(sqlite3.connect(path)) as con:
        con.execute("create table Race (id text, date datetime, racecourse text, distanceFurlongs real, going text, flatJumps text, raceClass integer, numberOfRunners integer)")
        con.execute("create table Runner (id text, raceId text, horseId text, trainerName text, jockeyName text, draw integer, weightLbsTotal integer, officialRating integer, headgear text, nonRunner boolean)")
        con.execute("create table ResultEntry (runnerId text, finishingPosition integer)")
        con.executemany("insert into Race values (?, '2024-03-01T00:00:00.000+00:00', 'York', 8, 'Good', 'FLAT', 2, ?)", [("r1", 8), ("r2", 14), ("r3", 15), ("r4", None)])
        con.executemany("insert into Runner values (?, ?, 'h', 't', 'j', 1, 120, 80, null, 0)", [(f"u{i}", f"r{i}") for i in range(1, 6)])
        con.execute("insert into ResultEntry values ('u2', 3)")
        con.commit()
    data = sqlite.RacingData(spark, path, folder)
    runs = {r.id: (r.fieldSizeBand, r.finishingPosition) for r in data.global_runs.collect()}
    assert runs == {"u1": ("SMALL", None), "u2": ("MEDIUM", 3), "u3": ("LARGE", None), "u4": ("LARGE", None)}
    assert data.global_runs.columns == sqlite.RUN_COLUMNS and data.races is data.races
    os.remove(path)
    again = sqlite.RacingData(spark, path, folder)
    assert again.runners.count() == 5 and again.table("global_runs").count() == 4
    again.refresh("races")
    with pytest.raises(Exception, match="no database"):
        again.races
    with pytest.raises(AttributeError):
        again.weather
