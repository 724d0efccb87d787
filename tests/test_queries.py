"""Each registered query of the library against its SQL, in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from usagelake.plans import queries, sessions

QUERIES, ORACLES = {**queries.QUERIES, **sessions.QUERIES}, {**queries.ORACLES, **sessions.ORACLES}

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.sql(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert found == wanted


def test_session_windows_hold_all_events(spark):
    from pyspark.sql import functions as F

    assert QUERIES["session_windows"](spark, SF).agg(F.sum("events")).first()[0] == 1000
