"""Queries that write tables and files and read them again: sinks, logs, snapshots, listings."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import ingest
from quillspark.plans.catalog import query, t
from quillspark.session import scratch
from quillspark.sources import files, listing, sinks


def _folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/stored-{uuid.uuid4().hex}"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by Spark's own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


@query("SELECT folder, year(o_orderdate)::INT AS year, count(*) AS n FROM orders, (VALUES ('latest'), ('archive')) AS f(folder) GROUP BY ALL")
def exported_years(spark, d):
    path = _folder(spark)
    sinks.export(t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), path, date(2024, 1, 2), "year")
    parts = [spark.read.parquet(f"{path}/{f}").select(F.lit(name).alias("folder"), "year") for name, f in (("latest", "latest"), ("archive", "archive/2024-01-02"))]
    return parts[0].union(parts[1]).groupBy("folder", "year").agg(F.count("*").alias("n"))


@query("SELECT day, year(o_orderdate)::INT AS year, count(*) AS n FROM orders, (VALUES ('2024-01-04'), ('2024-01-31')) AS f(day) GROUP BY ALL")
def archives_kept(spark, d):
    """Exports of three days, of which the oldest is past its time and deleted."""
    path, rows = _folder(spark), t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    for day in (date(2024, 1, 3), date(2024, 1, 4), date(2024, 1, 31)):
        sinks.export(rows, path, day, "year")
    sinks.delete_expired(spark, path, date(2024, 2, 1))
    held = spark.read.schema("o_orderkey long, year int").parquet(f"{path}/archive/*/*")
    day = F.regexp_extract(F.input_file_name(), "archive/([^/]*)/", 1)
    return held.select(day.alias("day"), F.regexp_extract(F.input_file_name(), r"year=(\d+)", 1).cast("int").alias("year")).groupBy("day", "year").agg(F.count("*").alias("n"))


@query("SELECT collection, records FROM (SELECT 'customer' AS collection, count(*) AS records FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'total', (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation))")
def stored_manifest(spark, d):
    made = sinks.manifest(spark, {n: f"{d}/{n}.parquet" for n in ("customer", "nation")}, date(2024, 1, 2))
    listed = made.select(F.from_json("manifest", "day string, collections array<struct<collection: string, records: bigint, files: bigint>>").alias("m"))
    return listed.select(F.inline("m.collections")).select("collection", "records")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def snapshot_upserts(spark, d):
    path, x = _folder(spark), t(spark, d, "events").withColumn("user", F.col("user_id").cast("string"))
    sinks.upsert_snapshot(spark, path, x.where("event_id % 2 = 0"), "user", "event_id", "00000000")
    return sinks.upsert_snapshot(spark, path, x.where("event_id % 2 = 1"), "user", "event_id", "00000001").select("user_id", "event_id")


@query("SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def search_exports(spark, d):
    path, x = _folder(spark), t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("seg"))
    sinks.search_export(x, f"{path}/csv", "csv")
    sinks.search_export(x, f"{path}/json", "json")
    schema = "c_custkey long, c_name string, seg string"
    return spark.read.schema(schema).csv(f"{path}/csv", header=True).union(spark.read.schema(schema).json(f"{path}/json"))


@query("SELECT doc_id FROM documents WHERE lang <> 'fr' AND doc_id % 3 > 0")
def logged_urls(spark, d):
    """Successes of a log of which one kind has been cleared: what a later run leaves out."""
    path = _folder(spark)
    log = t(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, "success").otherwise("failure").alias("status"), F.col("lang").alias("doc_type"), F.lit(2024).alias("year"), F.col("source").alias("type_value"))
    sinks.log(log, path)
    sinks.clear_log(spark, path, "fr")
    done = spark.read.schema("doc_id long, status string, doc_type string").json(path).where("status = 'success'")
    return t(spark, d, "documents").select("doc_id").join(done.select("doc_id"), "doc_id", "left_semi")


@query("SELECT doc_id FROM documents WHERE doc_id % 4 > 0")
def unprocessed_urls(spark, d):
    x = t(spark, d, "documents").select("doc_id", F.concat(F.lit("u/"), F.col("doc_id").cast("string")).alias("url"))
    return ingest.new_only(x, x.where("doc_id % 4 = 0"), "url", "url").select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_partkey % 5 > 0")
def pdfs_to_do(spark, d):
    x = t(spark, d, "part").select("p_partkey", F.lower("p_type").alias("legislation_type"), F.col("p_partkey").cast("string").alias("identifier"))
    key = F.concat_ws("/", "legislation_type", "identifier")
    return ingest.new_only(x, x.where("p_partkey % 5 = 0").select(key.alias("done")), key, "done").select("p_partkey")


@query("SELECT doc_id, lang FROM documents")
def json_lines_read(spark, d):
    """Records of JSON lines, with blank and broken lines between them."""
    path, x = _folder(spark), t(spark, d, "documents")
    lines = x.select(F.to_json(F.struct("doc_id", "lang")).alias("value"))
    lines.union(x.select(F.when(F.col("doc_id") % 2 == 0, "").otherwise("{broken").alias("value"))).write.text(path)
    return files.json_lines(spark, path, "doc_id long, lang string").where("doc_id is not null")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND n_chars > 500")
def scanned_table(spark, d):
    return files.scan(spark, f"{d}/documents.parquet", (F.col("lang") == "de") & (F.col("n_chars") > 500), ["doc_id", "source"])


@query("SELECT * FROM (VALUES ('asp-2001-8.xml', 2001, 'asp', 8, '<a>y</a>'), ('asp-2002-1.xml', 2002, 'asp', 1, '<b/>')) AS t(file, year, type, number, text)")
def local_files(spark, d):
    path = _folder(spark)
    for name, text in (("2001/ukpga-2001-7.xml", "<a>x</a>"), ("2001/asp-2001-8.xml", "<a>y</a>"), ("2002/asp-2002-1.xml", "<b/>"), ("2003/asp-2003-1.xml", "<c/>")):
        _put(spark, f"{path}/{name}", text)
    return files.xml_files(spark, path, [2001, 2002], ["asp"])


@query("SELECT * FROM (VALUES ('http://x/1.pdf', 'ukpga', '1/2'), ('http://x/2.pdf', 'uksi', NULL)) AS t(pdf_url, legislation_type, identifier)")
def pdf_list(spark, d):
    path = f"{_folder(spark)}/list.csv"
    _put(spark, path, "pdf_url,legislation_type,identifier\nhttp://x/1.pdf,ukpga,1/2\nhttp://x/2.pdf,uksi,\n")
    return files.pdf_list(spark, path)


def pages_of(task: dict, page: int) -> tuple[list[str], bool]:
    """Three pages of two addresses for each task; stands for the network."""
    return [f"/{task['type']}/{task['year']}/{page}/{n}" for n in (1, 2)], page == 3


@query("SELECT '/' || type || '/' || year || '/' || page || '/' || n AS url, page::INT AS page FROM (VALUES ('ukpga', 1990), ('asp', 2001)) AS t(type, year), range(1, 4) AS p(page), range(1, 3) AS q(n)")
def paged_listing(spark, d) -> DataFrame:
    spark.dataSource.register(listing.Listing)
    tasks = '[{"type": "ukpga", "year": 1990}, {"type": "asp", "year": 2001}]'
    return spark.read.format("listing").option("tasks", tasks).option("fetch", "quillspark.plans.stored:pages_of").load().select("url", "page")


@query("SELECT year::INT AS year, mode FROM (SELECT unnest([2024, 2023]) AS year, 'daily' AS mode UNION ALL SELECT unnest(range(1963, 2025)), 'full' UNION ALL SELECT unnest([1999, 2001]), 'some')")
def years_of_modes(spark, d):
    rows = [(y, mode) for mode in ("daily", "full", "some") for y in ingest.modes([2001, 1999, 2001], mode, 2024)]
    return spark.createDataFrame(rows, "year int, mode string")
