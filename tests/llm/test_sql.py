"""Queries of this subpackage against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark.llm import registry

FOLDER = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    df = registry.queries()[name](spark, str(FOLDER))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(str, found.fetchall()))
