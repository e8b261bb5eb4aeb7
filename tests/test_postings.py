"""The stored index gives the rows of a scan, and reads less."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillspark.operators import postings, vectors

WORDS = [f"w{n}" for n in range(60)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(n, " ".join(rng.choice(WORDS[:: 1 + n // 500]) for _ in range(rng.randrange(1, 40)))) for n in range(3000)]
    rows += [(3001, None), (3002, ""), (3003, "w7 " * 50), (3004, "w7 " * 50), (3005, "rare w7")]
    return spark.createDataFrame(rows, "id long, text string").repartition(4).cache()


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    postings.build(corpus, path, segment=16)
    return postings.opened(spark, path, segment=16)


def rows(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize("query", ["w7", "w1 w2 w3", "rare w7", "w59 w59 w0", "absent", "absent w4", "", "w7 " * 20])
@pytest.mark.parametrize(("k", "offset"), [(10, 0), (40, 7), (5000, 0), (0, 0)])
def test_rows_of_a_scan(spark, corpus, index, query, k, offset):
    got = rows(index.top_k(query, k, offset=offset))
    want = rows(vectors.sparse_top_k(corpus, query, k, offset=offset)) if query else []
    assert got == want


def test_a_filter_comes_before_the_cut(spark, corpus, index):
    odd = corpus.where("id % 2 = 1")
    assert rows(index.top_k("w1 w7", 12, allowed=odd)) == rows(vectors.sparse_top_k(odd, "w1 w7", 12))


def test_segments_below_the_bound_are_not_scored(spark, index):
    told = {}
    index.top_k("w7", 5, told=told).collect()
    assert told["scored"] < told["segments"] / 3


def test_a_query_reads_the_folders_of_its_terms_only(spark, index):
    found = index.blocks(["w7", "w8"])
    files = {f for f in found.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert 1 <= len({f.split("folder=")[1].split("/")[0] for f in files}) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"folder=(\d+)", plan)) <= {str(postings._folder(t, postings.FOLDERS)) for t in ("w7", "w8")}
    narrow = postings.bounds(found, {"w7": 1.0, "w8": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "postings" not in narrow.split("ReadSchema")[1]


def test_no_block_is_larger_than_a_segment(spark, index):
    assert spark.read.parquet(f"{index.path}/blocks").agg(F.max(F.size("postings"))).first()[0] <= 16


def test_an_empty_table(spark, corpus, tmp_path):
    postings.build(corpus.where("text is null"), str(tmp_path / "none"))
    assert postings.opened(spark, str(tmp_path / "none")).top_k("w1 w2", 5).count() == 0


def test_postings_meet_their_segments_without_a_join(corpus, tmp_path, monkeypatch):
    def join(*_, **__):
        raise AssertionError("a join of all postings")

    monkeypatch.setattr(type(corpus), "join", join)
    postings.build(corpus, str(tmp_path / "index"), segment=16)
