"""Every query against its SQL, over the smallest shared tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from filingmill.plans.registry import ORACLE_SQL, QUERIES, flagship

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(frame: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or (not isinstance(x, (list, tuple)) and pd.isna(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted(repr([plain(x) for x in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0
