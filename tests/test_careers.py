"""Totals and offsets along careers against whole pasts, and what they sort and shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import careers as random_careers

from furlong.operators import careers, history
from furlong.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(spark, seed):
    k = lambda n, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.xxhash64("runner_id", F.lit(n + seed)) % len(xs) + len(xs)).cast("int") % len(xs) + 1)
    return random_careers(spark, seed).withColumns({"race_class": k(1, 1, 2, 3, None), "official_rating": k(2, 50, 55, 71, None), "trainer_id": k(3, 1, 2, None).cast("long"), "headgear": k(4, "h1", "h2", None), "pace_comment": k(5, "c", None), "position_3f": k(6, 1, 4, 7, None), "position_2f": k(7, 2, 3, 8), "position_1f": k(8, 1, 5, 6)})


def assert_equal(got, want):
    got, want = got.toPandas().sort_values("runner_id"), want.toPandas().sort_values("runner_id")
    assert got.columns.tolist() == want.columns.tolist() and len(got) == len(want) == 400
    for c in got.columns:
        assert np.allclose(got[c].astype(float).to_numpy(), want[c].astype(float).to_numpy(), atol=1e-9, equal_nan=True), c


@pytest.mark.parametrize("name", ["form_slopes", "class_record", "going_similarity", "headgear_trainer", "course_distance_going"])
def test_equal_to_whole_pasts(spark, name):
    rows = rows_of(spark, 5)
    assert_equal(getattr(careers, name)(rows), getattr(history, name)(history.with_history(rows)))


def test_pace_equals_whole_pasts_and_runs_without_a_horse_see_none(spark):
    rows = rows_of(spark, 6)
    got = careers.pace(rows)
    named, nameless = rows.filter("horse_id is not null").select("runner_id"), rows.filter("horse_id is null").select("runner_id")
    want = {r["runner_id"]: r for r in history.pace(rows).join(named, "runner_id").collect()}
    for r in got.join(named, "runner_id").collect():
        for k, v in want[r["runner_id"]].asDict().items():
            assert (r[k] is None) == (v is None) and (v is None or abs(r[k] - v) < 1e-9), k
    assert {(r.pace_features_available, r.avg_early_position_percentile) for r in got.join(nameless, "runner_id").collect()} == {(0, None)}
    assert want


def nodes(plan):
    yield plan
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        yield from nodes(plan.initialPlan())
    for i in range(plan.children().size()):
        yield from nodes(plan.children().apply(i))


@pytest.mark.parametrize("name", ["runner_explained", "course_distance_going", "badges", "model_confidence", "evidence_density", "pace_history", "training_dataset"])
def test_no_pasts_are_sorted_or_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan()
    moved = [n for n in nodes(plan) if n.getClass().getSimpleName() in ("SortExec", "ShuffleExchangeExec", "SortMergeJoinExec")]
    assert moved
    for n in moved:
        assert not [a for a in (n.output().apply(i) for i in range(n.output().size())) if a.dataType().typeName() == "array"], n.nodeName()


def test_an_explained_runner_is_computed_from_its_lines_once(spark):
    for name in ("runner_explained", "badges", "model_confidence"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
        assert sum("l_linenumber" in n.toString() for n in nodes(plan) if n.children().size() == 0) == 1, name


@pytest.mark.parametrize(("name", "most"), [("pace_history", 0), ("form_slopes", 0), ("headgear_trainer_change", 0), ("training_dataset", 30)])
def test_few_lambdas(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan()
    found = [n.expressions().apply(i).toString() for n in nodes(plan) for i in range(n.expressions().size())]
    assert found and sum(e.count("lambdafunction(") for e in found) <= most
