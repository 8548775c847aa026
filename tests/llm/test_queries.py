"""The registered queries with SQL counterparts, on the smallest tables."""

import os

import pandas as pd
import pytest

from wordloom.llm import queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def rows(frame, columns):
    plain = lambda v: None if not isinstance(v, str) and pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted(repr(tuple(plain(v) for v in row)) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = connection.sql(queries.oracle_sql()[name]).df()
    columns = sorted(expected.columns)
    assert rows(queries.queries()[name](spark, SF).toPandas(), columns) == rows(expected, columns)
