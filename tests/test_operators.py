from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.operators import filters, fusion, ingest, lookup, models, search, vectors
from quillspark.sources import files, listing, sinks, web
from quillspark.streaming import ratelimit


def scores(spark, pairs):
    return spark.createDataFrame(pairs, "id long, score double")


def as_dict(df):
    return {r.id: round(r.score, 6) for r in df.collect()}


def test_fusion_does_not_depend_on_the_order_of_lists(spark):
    a, b = scores(spark, [(1, 0.9), (2, 0.5), (3, 0.1)]), scores(spark, [(3, 7.0), (4, 2.0)])
    for fuse in (fusion.dbsf, fusion.rrf):
        assert as_dict(fuse(a, b)) == as_dict(fuse(b, a))


def test_fusion_of_one_candidate_equal_scores_and_empty_lists(spark):
    one, same, none = scores(spark, [(1, 3.0)]), scores(spark, [(1, 2.0), (2, 2.0)]), scores(spark, [])
    assert as_dict(fusion.dbsf(one)) == {1: 0.5}
    assert as_dict(fusion.dbsf(same)) == {1: 0.5, 2: 0.5}
    assert as_dict(fusion.dbsf(one, none)) == {1: 0.5}
    assert as_dict(fusion.rrf(same)) == {1: round(1 / 61, 6), 2: round(1 / 62, 6)}


def test_cosine_of_zero_is_zero(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, dense array<float>")
    assert as_dict(vectors.dense_top_k(rows, [1.0, 1.0], 5)) == {1: 0.0, 2: round(0.5**0.5, 6)}
    assert as_dict(vectors.dense_top_k(rows, [0.0, 0.0], 5)) == {1: 0.0, 2: 0.0}


def test_filter_comes_before_search(spark):
    rows = spark.createDataFrame([(n, [float(n), 1.0], n % 2) for n in range(20)], "id long, dense array<float>, odd int")
    got = as_dict(vectors.dense_top_k(rows, [1.0, 0.0], 5, where=F.col("odd") == 1))
    assert len(got) == 5
    assert all(k % 2 for k in got)


def test_blank_query_only_filters(spark):
    rows = spark.createDataFrame([(n, "a b") for n in range(6)], "id long, text string")
    assert search.hybrid(rows, "  ", None, 3).count() == 3


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 3)], "id long, v string, seq long")
    once = ingest.upsert(old, new, "id", "seq")
    twice = ingest.upsert(once, new, "id", "seq")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "c", 1), (3, "d", 3)]


def test_snapshot_upsert_and_export(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2001, 1), ("b", 2002, 2)], "id string, legislation_year int, seq long")
    path = str(tmp_path / "acts")
    sinks.upsert_snapshot(spark, path, rows, "id", "seq", "00000000")
    again = sinks.upsert_snapshot(spark, path, rows.limit(1), "id", "seq", "00000001")
    assert again.count() == 2
    sinks.export(rows, str(tmp_path / "out"), date(2024, 1, 2))
    latest = spark.read.parquet(str(tmp_path / "out/latest"))
    assert latest.where("legislation_year = 2001").count() == 1
    told = sinks.manifest(spark, {"acts": str(tmp_path / "out/latest")}, date(2024, 1, 2)).first()[0]
    assert '"records":2' in told


def test_filters(spark):
    rows = spark.createDataFrame([("a", "ukpga", 2000), ("b", "wsi", None)], "legislation_id string, legislation_type string, legislation_year int")
    assert rows.where(filters.provisions("b", ["ukpga"], None, 1999)).count() == 1
    assert rows.where(filters.provisions(category="primary", first=1999)).count() == 1
    assert rows.where(filters.must([])).count() == 2
    assert rows.where(filters.bulk(["ukpga", "wsi"], 0)).count() == 2
    with pytest.raises(ValueError, match="no types"):
        filters.category_types("euretained")


def test_lookup_limits_before_it_sorts(spark):
    rows = spark.createDataFrame([(n, "x", 100 - n, "t") for n in range(30)], "id long, legislation_id string, number int, text string")
    got = [r.number for r in lookup.sections_of(rows, "x", 5).collect()]
    assert got == sorted(got)
    assert got != [71, 72, 73, 74, 75]


def test_years_in_tiers(spark):
    rows = spark.createDataFrame([("g", "http://www.legislation.gov.uk/id/ukla/Vict/44/1", "", None), ("g", "[UNCLEAR: x]", "", None), ("h", "[UNCLEAR: y]", "may be cited as the A Act 1891", None)], "act string, id string, text string, year int")
    assert sorted(r.year for r in ingest.recover_years(rows, "id", "text", "act").collect()) == [1881, 1881, 1891]


def test_models_fail_softly(spark):
    rows = spark.createDataFrame([("a",), ("bad",)], "t string")

    def call(text):
        if text == "bad":
            raise RuntimeError("no")
        return text.upper()

    got = rows.select(models.generate(call, F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [("A", None), (None, "no")]

    def broken(texts):
        raise RuntimeError("no")

    assert rows.select(models.embed(broken, F.col("t"), 3)).first()[0] == [0.0, 0.0, 0.0]


def test_fixed_windows_open_at_the_first_hit(spark):
    start = datetime(2024, 1, 1)
    hits = [(1, start + timedelta(seconds=s), n) for n, s in enumerate([0, 10, 59, 60, 61, 200])] + [(2, start, 9)]
    rows = spark.createDataFrame(hits, "who long, at timestamp, n long")
    got = {r.n: r.hits for r in ratelimit.batch_counts(rows, "who", "at", "n", 60).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 2, 5: 1, 9: 1}


def test_rate_limit_decision(spark):
    rows = spark.createDataFrame([(601, 700, "/x"), (601, 700, "/healthcheck"), (600, 700, "/x")], "m int, h int, p string")
    got = [tuple(r[0]) for r in rows.select(ratelimit.decide(F.col("m"), F.col("h"), F.col("p"))).collect()]
    assert got == [(429, 0, 9300), (200, 0, 9300), (200, 0, 9300)]


def test_counts_on_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, start + timedelta(seconds=s)) for s in (0, 30, 90)], "who long, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = ratelimit.stream_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "who", "at", 60)
    query = stream.writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.hits for r in spark.table("counts").collect()) == [1, 1, 2]


def fetch(task, page):
    return [f"/{task['type']}/{task['year']}/{page}"], page == 2


def test_listing_source(spark):
    spark.dataSource.register(listing.Listing)
    got = spark.read.format("listing").option("tasks", '[{"type": "ukpga", "year": 2001}, {"type": "asp", "year": 2002}]').option("fetch", "tests.test_operators:fetch").load()
    assert sorted(r.url for r in got.collect()) == ["/asp/2002/1", "/asp/2002/2", "/ukpga/2001/1", "/ukpga/2001/2"]
    assert listing.court_years([2003, 2002]) == [2002, 2003]
    with pytest.raises(ValueError, match="consecutive"):
        listing.court_years([2001, 2003])


def test_file_sources(spark, tmp_path):
    (tmp_path / "2001").mkdir()
    (tmp_path / "2001/ukpga-2001-7.xml").write_text("<a>x</a>")
    (tmp_path / "2001/asp-2001-8.xml").write_text("<a>y</a>")
    got = files.xml_files(spark, str(tmp_path), [2001], ["asp"]).first()
    assert (got.year, got.type, got.number, got.text) == (2001, "asp", 8, "<a>y</a>")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]


def test_listed_pages(spark):
    page = '<a href="/ukpga/2001/7/contents">x</a><a href="/ukpga/2001/8/contents/made">y</a><a href="/asp/1">z</a><a class="n" href="/next?page=2">Next page</a>'
    rows = spark.createDataFrame([(page,)], "html string")
    assert sorted(r.link for r in web.listed_acts(rows, "html", "ukpga").collect()) == ["/ukpga/2001/7", "/ukpga/2001/8"]
    assert rows.select(web.next_page("html")).first()[0] == "/next?page=2"


def test_a_stored_page_reads_one_row_group(spark, tmp_path, monkeypatch):
    """A fetch opens one file and reads no more of it when there are more pages."""
    import pyarrow.parquet as pq

    from quillspark.sources import listing

    read = []
    real = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda self, n, columns: read.append((out := real(self, n, columns=columns)).num_rows) or out)
    for n in (2000, 20000):
        rows = spark.range(n).select(F.concat(F.lit("/p?page="), F.col("id").cast("string")).alias("url"), F.concat(F.col("id").cast("string"), F.repeat(F.lit(" word"), 2000)).alias("html"))
        path = f"{tmp_path}/{n}"
        listing.store_pages(rows.repartition(12), path)
        options = {"pages": f"file://{path}"}
        assert [listing.stored_page(f"/p?page={k}", options).split()[0] for k in (0, 7, n - 1)] == ["0", "7", str(n - 1)]
        assert listing.stored_page("/q", options) is listing.stored_page("", options) is listing.stored_page(f"/p?page={n}", options) is None
        read.clear()
        assert all(listing.stored_page(f"/p?page={k}", options).split()[0] == str(k) for k in (0, 7, n - 1))
        assert len(read) == 3
        assert max(read) <= listing.GROUP
