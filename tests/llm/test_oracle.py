"""Every query of the subpackage that SQL can express against its SQL, on the smallest test tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from codeloom.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    cursor = con.execute(queries.ORACLE[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert ours == sorted((tuple(row[i] for i in at) for row in cursor.fetchall()), key=str)
