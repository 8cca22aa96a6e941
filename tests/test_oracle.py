"""Every query of the core that has SQL gives the rows of that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SF

from textloom.plans import catalog


def canon(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return str([canon(x) for x in v])
    return v


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    found = duck.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(canon(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(canon(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == expected


@pytest.mark.parametrize("name", ["gen2_unique_best", "mor8_exact", "join1_meanings", "win14_phrases", "p4_builds"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_flagship():
    assert catalog.FLAGSHIP in catalog.QUERIES
