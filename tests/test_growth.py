"""What must not grow with the input, or be done once only: cells of training rows, shuffles in plans, searches by value."""

import random

import numpy as np
from pyspark.sql import functions as F

from furlong.operators import models


def test_cells_stop_growing_and_teach_the_same(spark):
    rnd = random.Random(3)
    rows = [(x := rnd.randrange(200) / 7, z := float(rnd.random() < 0.01), int(rnd.random() < 0.1 + 0.02 * x + 0.2 * z)) for _ in range(3000)]
    train = spark.createDataFrame(rows, "x double, z double, y int")
    bins = models.binning(train, ["x", "z"])
    assert [len(s) for s in bins.getSplitsArray()] == [33, 3]  # a rare value keeps its bin
    one, four = (models.cells(t, bins, ["y"]) for t in (train, train.unionByName(train).unionByName(train).unionByName(train)))
    assert one.count() == four.count() <= 128 and one.agg(F.sum("__rows")).first()[0] * 4 == four.agg(F.sum("__rows")).first()[0] == 12000
    want, got = models.boosting(train, ["x", "z"], "y", 10), models.boosting_of_cells(one, bins, "y", 10)
    p = [models.predicted(m, train, "p").orderBy("x", "z", "y").toPandas()["p"] for m in (want, got)]
    assert np.corrcoef(*p)[0, 1] > 0.95 and np.abs(p[0] - p[1]).mean() < 0.03


def test_what_follows_from_a_value_is_worked_out_once_for_it(spark):
    from furlong.functions.betting import fractional
    from furlong.operators.frames import by_value

    rows = spark.createDataFrame([(1, 2.5), (2, None), (3, 2.5), (4, 4.0)], "k int, price double")
    got = {r["k"]: r["f"] for r in by_value(rows, "price", {"f": fractional(F.col("price"))}).collect()}
    assert got == {1: "3/2", 2: None, 3: "3/2", 4: "3/1"}


def test_samples_of_columns_pass_once_and_are_not_shuffled_whole(spark):
    from furlong.operators.mapping import profile

    rows = spark.range(1000).selectExpr("id as k", "if(id % 3 = 0, null, concat('v', id)) as a", "cast(null as string) as b")
    out = profile(rows, "k")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["column_name"]: (r["rows"], r["present_pct"], r["samples"]) for r in out.collect()} == {"k": (1000, 100.0, ["0", "1", "2"]), "a": (1000, 66.6, ["v1", "v2", "v4"]), "b": (1000, 0.0, [])}


def test_filled_points_are_dealt_out_once(spark):
    from furlong.operators.sectionals import filled, summaries

    points = spark.createDataFrame([(1, 0, 1.0, 10.0, None), (1, 3, 1.0, 13.0, None)], "runner_id int, segment_index int, distance_f double, seconds double, clock double")
    out = filled(points)
    assert [(r["segment_index"], r["seconds"], r["filled"]) for r in out.orderBy("segment_index").collect()] == [(0, 10.0, False), (1, 11.0, True), (2, 12.0, True), (3, 13.0, False)]
    assert "Union" not in summaries(out)._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_is_taken_from_a_document_in_one_pass(spark):
    from furlong.sources import providers

    good, bad = providers.documents(spark.createDataFrame([('{"selection_id": 7, "market_time": "2024-01-05T10:00:00", "back": "x"}',), ("[1]",), ("{oops",)], "value string"))
    out = providers.exchange_points(good)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("variant_get") == 1 and bad.count() == 2
    assert [(r["runner"], r["price"], r["errors"]) for r in out.collect()] == [("7", 0.0, ["back is no double"])]


def test_a_merge_shuffles_once_and_keeps_what_a_null_leaves(spark):
    from furlong.operators.merge import latest_over

    held = spark.createDataFrame([(1, 1, "a", 1.0), (1, 2, "b", 2.0)], "month int, k int, x string, y double")
    new = spark.createDataFrame([(1, 2, None, 3.0), (1, 3, "c", None), (1, 3, "d", None)], "month int, k int, x string, y double")
    out = latest_over(held, new, ["month", "k"], ["month"], None)
    assert out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a", 1.0), (1, 2, "b", 3.0), (1, 3, "d", None)]


def test_lines_are_dealt_into_more_parts_as_they_grow(spark):
    from furlong.sources import racing

    few, many = (racing.parts(spark, "/root/testdata/sf0.001", each=n) for n in (10**9, 100))
    assert few == spark.sparkContext.defaultParallelism and many > 10 * few


def test_joined_tables_are_computed_once_and_read_from_store(spark, monkeypatch):
    from furlong.operators import wide_rows
    from furlong.plans.registry import QUERIES

    given, join = {}, wide_rows.wide_rows
    monkeypatch.setattr(wide_rows, "wide_rows", lambda tables: given.update(tables) or join(tables))
    out = QUERIES["joined_tables"](spark, "/root/testdata/sf0.001")
    read = [f for t in (out, *given.values()) for f in t.inputFiles()]
    assert len(given) == 2 and read and not [f for f in read if "/testdata/" in f]


def test_a_sketch_keeps_the_smallest_hashes_over_batches(spark):
    import pyarrow as pa

    from furlong.operators import wide_rows

    rnd = random.Random(5)
    values = [[rnd.choice([None, rnd.randrange(-1000, 1000)]) for _ in range(50)] for _ in range(20)] + [[None] * 50]
    few = [[rnd.randrange(3)] * 50 for _ in values]
    batches = (pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(f, pa.int64())], names=["many", "few"]) for v, f in zip(values, few, strict=True))
    got = {b.column(0)[0].as_py(): b.column(1).to_pylist() for b in wide_rows._smallest(16)(batches)}
    assert got == {"many": sorted({x for v in values for x in v if x is not None})[:16], "few": [0, 1, 2]}
    cells = spark.createDataFrame([("7.00",), (" -7.0 ",), ("7.05",), ("1.0.0",), (".0",), ("a.0",), (" ",), (None,), ("12",)], "c string")
    assert [r[0] for r in cells.select(wide_rows.cell_text(F.col("c"))).collect()] == ["7", "-7", "7.05", "1.0.0", ".0", "a.0", None, None, "12"]
    assert spark.range(1).select(wide_rows.cell_text(F.lit(3.0)), wide_rows.cell_text(F.lit(3))).first()[:] == ("3", "3")


def test_trees_of_all_labels_share_a_job_a_level(spark):
    from furlong.operators import rounds

    rnd = random.Random(7)
    rows = [(x := rnd.randrange(8), z := rnd.randrange(4), int(rnd.random() < 0.1 + 0.1 * x), int(rnd.random() < 0.2 + 0.2 * z), rnd.randrange(1, 4)) for _ in range(2000)]
    held = spark.createDataFrame(rows, "x int, z int, a int, b int, n int")
    cells = models.Bucketizer(splitsArray=[[-np.inf, *[i + 0.5 for i in range(7)], np.inf], [-np.inf, 0.5, 1.5, 2.5, np.inf]], inputCols=["x", "z"], outputCols=["x__bin", "z__bin"], handleInvalid="keep")
    table = cells.transform(held).withColumnRenamed("n", "__rows").cache()
    table.count()
    group = f"trees-{rnd.random()}"
    spark.sparkContext.setJobGroup(group, "trees")
    grown = {t: models.boosted_cells(table, cells, ["a", "b"], t) for t in (3, 13)}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 16 * 4 + 2 * 20  # before, five or more a tree and label
    out = models.predicted(grown[13]["b"], models.predicted(grown[13]["a"], held, "p"), "q").toPandas()
    for label, p, by in (("a", "p", "x"), ("b", "q", "z")):  # near the shares of rows with the label
        shares = out.assign(hit=out[label] * out.n).groupby(by)[["hit", "n"]].sum()
        assert (abs(out.groupby(by)[p].mean() - shares.hit / shares.n) < 0.12).all() and out[p].corr(out[by]) > 0.9
    # a tree's first node by hand, on all rows
    one = rounds.Tree.empty(4)
    shape = rounds.Shape(2, 9, 1, columns=1.0)
    sums = np.zeros((2, 9, 2))
    for x, z, a, _, n in rows:
        for j, v in enumerate((x, z)):
            sums[j, v] += (n, n * (2 * a - 1))
    assert rounds._grow(one, shape, 0, sums, np.random.default_rng(1))
    gains = []
    for j in range(2):
        for cut in range(8):
            sides = [(sum(r[4] for r in s), sum(r[4] * (2 * r[2] - 1) for r in s)) for s in ([r for r in rows if r[j] <= cut], [r for r in rows if r[j] > cut])]
            gains.append((sum(t * t / n for n, t in sides) if all(n >= 20 for n, _ in sides) else -1.0, -j, -cut))
    best = max(gains)
    assert (one.feature[1], one.cut[1]) == (-best[1], -best[2])


def test_the_feature_table_is_dealt_out_once_for_each_key(spark):
    from furlong.plans.training import training_rows

    plan = training_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line.split("Exchange hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    for key in ("trainer_id", "jockey_id", "distance_band", "horse_id"):  # before, a shuffle of whole rows for each of nine windows
        assert sum(key in d for d in dealt) == 1, key


def test_columns_put_away_come_back_as_they_were(spark):
    from furlong.operators.features import packed

    rows = spark.createDataFrame([(1, 2, 3.5, "a", None), (2, None, None, None, 2**40)], "k long, i int, d double, s string, l long")
    slim, back = packed(rows, "__x", ["i", "d", "s", "l"])
    assert slim.columns == ["k", "__x"]
    out = slim.select("k", *[c.alias(n) for n, c in back.items()]).select(rows.columns)
    assert out.dtypes == rows.dtypes and sorted(map(tuple, out.collect())) == sorted(map(tuple, rows.collect()))


def test_runs_of_all_horses_leave_nothing_else_behind(spark):
    import os

    from furlong.plans import storage
    from furlong.sources.shared import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    out = storage.sqlite_global_runs(spark, "/root/testdata/sf0.001")
    assert out.count() > 5000
    new = {n.rsplit("-", 1)[0] for n in set(os.listdir(shared_dir(spark))) - before}
    assert new == {"racing-held"}
    held = next(os.path.join(shared_dir(spark), n) for n in set(os.listdir(shared_dir(spark))) - before)
    assert os.listdir(held) == ["global_runs"]
