"""The queries of program facts, and of what comes before and after the analysis, against their SQL at the smallest scale."""

import re
from pathlib import Path

import duckdb
import pytest

from factloom.plans import inference, outputs, programs, registry

FOLDER = "/root/testdata/sf0.001"
NAMES = [name for module in (programs, outputs, inference) for name in re.findall(r'@query\("(\w+)"', Path(module.__file__).read_text())]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in registry.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_rows_of_its_sql(spark, tables, name):
    df, out = registry.QUERIES[name](spark, FOLDER), tables.execute(registry.ORACLES[name])
    columns = [d[0] for d in out.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, out.fetchall()))
