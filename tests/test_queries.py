"""Every registered query of the sketch operators against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(row):
    return tuple(round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    want = db.execute(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in want.description)
    at = [[c[0] for c in want.description].index(c) for c in columns]
    assert sorted((plain(r) for r in got.select(*columns).collect()), key=str) == sorted((plain([r[k] for k in at]) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
