"""Every registered query that has SQL, held against DuckDB on the smallest tables."""

from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from millrace import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    link = duckdb.connect()
    for t in TABLES:
        link.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return link


def plain(frame):
    def text(x):
        return "~" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, Number) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) & set(catalog.ORACLE_SQL)))
def test_query(spark, duck, name):
    assert plain(entry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(catalog.ORACLE_SQL[name]).df())
