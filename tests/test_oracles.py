"""Every query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

from tabwright.plans import catalogue
from tools.check import TABLES, normalise


@pytest.fixture(scope="module")
def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_twin(spark, folder, database, name):
    df = catalogue.QUERIES[name](spark, folder)
    result = database.execute(catalogue.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert normalise(df.columns, [tuple(r) for r in df.collect()]) == normalise(names, result.fetchall())


def test_every_twin_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
