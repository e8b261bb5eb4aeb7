"""What only larger tables show."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.plans import catalog


def both(spark, folder, name, **tables):
    """Sorted rows of a query and of its SQL over the tables, which are written first."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(str, map(tuple, catalog.QUERIES[name](spark, str(folder)).collect()))), sorted(map(str, con.execute(catalog.SQL[name]).fetchall()))


@pytest.mark.parametrize("size", [1, 43, 50, 999])
def test_an_act_is_found_whatever_its_size(spark, tmp_path, size):
    got, want = both(spark, tmp_path, "act_lookup", part=spark.createDataFrame([(9, 3), (10, size)], "p_partkey long, p_size int"))
    assert got == want == [f"(10, {size})"]


def test_numbers_of_acts_are_not_read_as_years(spark, tmp_path):
    documents = spark.range(1190, 2050).select(F.col("id").alias("doc_id"), F.lit("One two").alias("text"), F.lit("en").alias("lang"), F.lit("src1").alias("source"))
    got, want = both(spark, tmp_path, "years_of_texts", documents=documents)
    assert got == want
