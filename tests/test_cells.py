"""The cells give the rows of a scan, and leave out what can't be near."""

import numpy as np
import pytest

from quillspark.operators import cells, vectors

RNG = np.random.default_rng(3)
CENTRES = RNG.normal(size=(12, 16)) * 3
CLUSTERED = [CENTRES[n % 12] + RNG.normal(size=16) * 0.2 for n in range(1500)]
SPREAD = list(RNG.normal(size=(800, 16)))
ODD = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15]


def frame(spark, found):
    return spark.createDataFrame([(n, None if v is None else [float(np.float32(x)) for x in v], n % 3) for n, v in enumerate(found)], "id long, dense array<float>, third int")


@pytest.fixture(scope="module", params=["clustered", "spread", "equal"])
def stored(request, spark, tmp_path_factory):
    found = {"clustered": CLUSTERED, "spread": SPREAD, "equal": [CENTRES[0]] * 50}[request.param] + [None, [0.0] * 16]
    df, path = frame(spark, found).cache(), str(tmp_path_factory.mktemp("cells"))
    cells.build(df, path)
    return request.param, df, cells.opened(spark, path)


def rows(df):
    return [(r.id, round(r.score, 9)) for r in df.collect()]


@pytest.mark.parametrize(("k", "offset"), [(10, 0), (25, 6), (4000, 0)])
def test_rows_of_a_scan(spark, stored, k, offset):
    _, df, index = stored
    for query in (CENTRES[0], -CENTRES[3], RNG.normal(size=16), CLUSTERED[7] * 100, np.zeros(16)):
        assert rows(index.top_k(list(map(float, query)), k, offset=offset)) == rows(vectors.dense_top_k(df, list(map(float, query)), k, offset=offset))


def test_a_filter_comes_before_the_cut(spark, stored):
    _, df, index = stored
    some, query = df.where("third = 1"), list(map(float, CENTRES[2]))
    assert rows(index.top_k(query, 9, allowed=some)) == rows(vectors.dense_top_k(some, query, 9))


def test_what_is_read(spark, stored):
    """Clusters are left out whole; where nothing is clustered, cells are read and the codes leave rows out."""
    name, _, index = stored
    told = {}
    index.top_k(list(map(float, CLUSTERED[5])), 10, told=told)
    if name == "clustered":
        assert told["read"] <= told["cells"] / 3 and told["in_full"] < 0.2 * told["rows"]
    if name == "spread":
        assert told["read"] > told["cells"] / 2 and told["in_full"] < 0.3 * told["rows"]


def test_odd_vectors_and_empty_tables(spark, tmp_path):
    df = frame(spark, ODD + CLUSTERED[:20])
    cells.build(df, str(tmp_path / "odd"))
    got = rows(cells.opened(spark, str(tmp_path / "odd")).top_k(list(map(float, CENTRES[0])), 100))
    assert len(got) == 25 and sum(s == 0 for _, s in got) == len(ODD)
    cells.build(df.limit(0), str(tmp_path / "none"))
    assert cells.opened(spark, str(tmp_path / "none")).top_k([1.0] * 16, 3).count() == 0


def test_only_the_folders_of_open_cells_are_read(spark, stored):
    _, _, index = stored
    two = [r for r in index.cells if r.cell != cells.NOWHERE][:2]
    plan = index.rows(two)._jdf.queryExecution().executedPlan().toString()
    assert index.rows(two).count() == sum(r.n for r in two)
    assert "CartesianProduct" not in plan
