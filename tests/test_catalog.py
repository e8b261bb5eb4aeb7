"""Every registered query against DuckDB on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from quillspark.plans import catalog

FOLDER = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def _value(x):
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x.isoformat()[:19] if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(FOLDER))
    found = duck.execute(catalog.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    ours = sorted(str([_value(r[c]) for c in order]) for r in df.collect())
    theirs = sorted(str([_value(r[columns.index(c)]) for c in order]) for r in found.fetchall())
    assert ours == theirs
