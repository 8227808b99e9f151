"""Results: settled outcomes in a table of their own, observations, and the state of their races.

Nothing of an outcome goes into the runners, so that it can't be taken for something known before the race.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.functions.betting import blank_to_null, settle_runner
from furlong.operators.merge import JOURNAL, merge_into
from furlong.sources.shared import Files, stored

#: Any of these makes an outcome.
OUTCOME = ["finishing_position", "finish_status", "starting_price"]
MONTH = "race_month"


def has_outcome(columns: list[str] = OUTCOME) -> Column:
    return reduce(Column.__or__, [F.col(c).isNotNull() for c in columns])


def with_month(rows: DataFrame, at: str = "race_ts") -> DataFrame:
    return rows.withColumn(MONTH, F.date_format(at, "yyyy-MM"))


def settled(submitted: DataFrame, runners: DataFrame) -> DataFrame:
    """The confirmed result of each submitted row that says anything.

    ``submitted`` has runner_id, finishing_position, finish_status, starting_price, closing_price; ``runners`` has runner_id, race_id, race_ts, the
    last price known before the race (current_price, which stands in for a missing starting price), places and place_fraction.
    Rows of no known runner are left out.
    """
    rows = submitted.select("runner_id", "finishing_position", blank_to_null(F.col("finish_status")).alias("finish_status"), F.col("starting_price").alias("sp"), "closing_price")
    rows = rows.join(runners.select("runner_id", "race_id", "race_ts", "current_price", "places", "place_fraction"), "runner_id")
    rows = rows.withColumn("starting_price", F.coalesce("sp", "current_price")).filter(has_outcome())
    profit = settle_runner(F.col("finishing_position"), F.col("starting_price"), F.col("places"), F.col("place_fraction"))
    out = rows.select("runner_id", "race_id", "race_ts", "finishing_position", "finish_status", "starting_price", "closing_price", *[c.alias(k) for k, c in profit.items()], F.lit("CONFIRMED").alias("result_status"))
    return with_month(out)


def write_results(path: str, outcomes: DataFrame, batch: str) -> bool:
    """Merges settled outcomes into the results at ``path/results`` and marks their races as resulted at ``path/races``; false if the batch is done."""
    if all(Files(outcomes.sparkSession, f"{path}/{t}").exists(f"{JOURNAL}/{batch}.done") for t in ("results", "races")):
        return False
    outcomes = stored(outcomes, "outcomes")  # several readers
    fresh = merge_into(f"{path}/results", outcomes, batch, [MONTH, "runner_id"], [MONTH])
    races = outcomes.groupBy(MONTH, "race_id").agg(F.lit("RESULTED").alias("race_status"), F.lit("CONFIRMED").alias("result_status"))
    return merge_into(f"{path}/races", races, batch, [MONTH, "race_id"], [MONTH]) or fresh


def write_observations(path: str, observed: DataFrame, tags: list[str], batch: str) -> bool:
    """Puts the tags and notes of runners (race_month, runner_id, tags, note) in place of what was noted before; unknown tags and blank notes are left out."""
    known = F.filter(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), lambda t: t.isin(tags))
    noted = F.concat(F.transform(known, lambda t: F.struct(t.alias("tag"), F.lit(None).cast("string").alias("note"))), F.array(F.struct(F.lit(None).cast("string").alias("tag"), blank_to_null(F.col("note")).alias("note"))))
    rows = observed.select(MONTH, "runner_id", F.explode(noted).alias("o")).select(MONTH, "runner_id", "o.tag", "o.note")
    # a runner without tag or note keeps an empty row, which says that its former ones are gone
    full = rows.filter("tag is not null or note is not null")
    none = observed.select(MONTH, "runner_id").distinct().join(full.select(MONTH, "runner_id").distinct(), [MONTH, "runner_id"], "left_anti")
    return merge_into(f"{path}/observations", full.unionByName(none, allowMissingColumns=True), batch, [MONTH, "runner_id"], [MONTH], replace=True)
