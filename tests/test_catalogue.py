"""Each query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from traceloom.plans.catalogue import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    show = lambda v: "" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(got)
        return
    expected = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got, sorted(got.columns)) == rows(expected, sorted(got.columns))
