"""Every registered enrichment query against its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pytest

from ledgerloom import registry

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, float) else str(v)  # noqa: E731  times print alike at any resolution
    return sorted((tuple(clean(v) for v in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, con, name):
    got = registry.queries()[name](spark, DATA).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert rows(got) == rows(want)
