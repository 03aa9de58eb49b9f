"""Every registered measurement query against its SQL, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from inkgauge.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "documents labels pages embeddings conversations benchmark events".split()


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no tables")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=str)
    rel = con.sql(plans.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert ours == theirs
