"""Every registered racing query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from furlong.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.integer, np.floating)):
        return float(v) + 0.0
    return str(v)


def rows(df):
    return sorted(zip(*[[plain(v) for v in df[c].tolist()] for c in sorted(df.columns)], strict=True), key=str)


#: Learned models have no SQL; test_models.py holds them against brute force.
LEARNED = {"win_models", "place_model_bands", "served_predictions"}


def test_every_query_has_sql_but_learned_models():
    assert set(QUERIES) - set(ORACLE_SQL) == LEARNED


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)
