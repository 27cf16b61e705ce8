"""Every query against its SQL in DuckDB, on the smallest tables, where these are there."""

import os

import duckdb
import pytest

from veilsift.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or v != v else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, db, name):
    mine, sql = QUERIES[name](spark, DATA).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert rows(mine) == rows(sql)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
