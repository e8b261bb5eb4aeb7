"""What the plans must look like, whatever the size."""

import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import lookup, vectors
from quillspark.plans import catalog, flows

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["filter_types_and_years", "filter_one_act_beats_others", "amendments_to", "left_join_with_stub"])
def test_filters_and_columns_reach_the_scan(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert "ReadSchema" in text
    assert not re.search(r"ReadSchema: struct<[^>]*(?:o_totalprice|l_comment|n_chars:bigint,text)", text)
    if name in ("filter_one_act_beats_others", "amendments_to"):
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo", text)


#: Flows run whole when they are called; what they return is a table that they have written.
_FLOWS = {n for n, f in catalog.QUERIES.items() if f.__module__ == flows.__name__}


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in _FLOWS | {"page_title_and_links"}))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, FOLDER))


def test_top_k_sorts_only_the_best_of_each_task(spark):
    rows = spark.createDataFrame([(n, [float(n), 1.0]) for n in range(50)], "id long, dense array<float>")
    text = plan(vectors.dense_top_k(rows, [1.0, 0.0], 5))
    assert "TakeOrderedAndProject" in text
    assert "Exchange" not in text


def test_sparse_scores_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    assert "Exchange" not in plan(vectors.sparse_scores(rows, "b"))


def test_a_page_is_cut_before_it_is_placed(spark):
    rows = spark.range(100).withColumn("v", F.col("id") % 7)
    page = lookup.page(rows, [F.desc("v"), F.col("id")], 5, 10)
    got = page.orderBy("position").collect()
    assert [r.position for r in got] == [11, 12, 13, 14, 15]
    assert {r.total for r in got} == {100}
    assert "TakeOrderedAndProject" in plan(page)


def test_latest_is_limited_before_the_shuffle(spark):
    from quillspark.operators.ingest import latest

    rows = spark.range(100).withColumn("k", F.col("id") % 3)
    assert "WindowGroupLimit" in plan(latest(rows, "k", "id"))


def test_weights_of_terms_are_shuffled_once(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, text string")
    assert "Exchange" not in plan(vectors.bm25_weights(rows))
    text = plan(vectors.bm25_weights(rows, idf=True))
    assert "SortMergeJoin" not in text
    assert text.count("Exchange hashpartitioning") <= 2  # the weights, and counts of documents
