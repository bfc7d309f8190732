"""Every core query against its SQL on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from codeloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(registry.ORACLE[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    theirs = sorted((tuple(row[i] for i in at) for row in cursor.fetchall()), key=str)
    assert ours == theirs
