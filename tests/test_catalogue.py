"""Every registered core query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from pressdelta.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def _rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(tuple, df[columns].astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.ORACLES:
        assert _rows(got) == _rows(con.execute(catalogue.ORACLES[name]).df())
    else:
        assert len(got) > 0
