"""Writers: upserts of snapshots, partitioned export with a manifest, logs."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.uri import uuid5
from quillspark.operators import ingest


def upsert_snapshot(spark: SparkSession, path: str, new: DataFrame, key: str, sequence: str, version: str) -> DataFrame:
    """Merge new rows into the newest snapshot under ``path`` and write the next one.

    The old snapshot stays, so a failed run leaves what was read; running the
    same rows again gives the same snapshot.
    """
    rows = new.withColumn("point_id", uuid5(key))
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current={version}")
    if held.getFileSystem(spark._jsc.hadoopConfiguration()).exists(held):
        rows = ingest.upsert(spark.read.parquet(f"{path}/current={version}"), rows, key, sequence)
    else:
        rows = ingest.latest(rows, key, sequence)
    following = f"{int(version) + 1:08d}"
    rows.write.mode("overwrite").parquet(f"{path}/current={following}")
    return spark.read.parquet(f"{path}/current={following}")


def export(rows: DataFrame, path: str, day: date, by: str | None = "legislation_year") -> None:
    """Parquet under ``latest`` and ``archive/day``, split by year where a column is given.

    Nothing is shuffled: every task writes its own rows of each year, so a large
    year is not one task.  The archive is a copy of what ``latest`` then holds,
    so the rows are computed once.
    """

    def put(some: DataFrame, folder: str) -> None:
        writer = some.write.mode("overwrite").option("compression", "snappy")
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{folder}")

    put(rows, "latest")
    put(rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/latest"), f"archive/{day.isoformat()}")


def manifest(spark: SparkSession, collections: dict[str, str], day: date) -> DataFrame:
    """One JSON row: records and files of each collection and in total."""
    parts = [spark.read.parquet(p).groupBy(F.lit(n).alias("collection")).agg(F.count("*").alias("records"), F.count_distinct("_metadata.file_path").alias("files")) for n, p in collections.items()]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    total = rows.agg(F.sum("records").alias("records"), F.sum("files").alias("files")).select(F.lit("total").alias("collection"), "records", "files")
    listed = rows.unionByName(total).agg(F.array_sort(F.collect_list(F.struct("collection", "records", "files"))).alias("collections"))  # a row a collection
    return listed.select(F.to_json(F.struct(F.lit(day.isoformat()).alias("day"), "collections")).alias("manifest"))


def expired(days: DataFrame, column: str, today: date, weeks: int = 4) -> DataFrame:
    """Archives older than the time of retention."""
    return days.where(F.col(column) < F.lit(today - timedelta(weeks=weeks)))


def delete_expired(spark: SparkSession, path: str, today: date, weeks: int = 4) -> list[str]:
    """Delete archives under ``path/archive`` older than the time of retention; gives their days.  Folders that are no day stay."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/archive")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for status in system.listStatus(place) if system.exists(place) else []:
        name = status.getPath().getName()
        try:
            old = date.fromisoformat(name) < today - timedelta(weeks=weeks)
        except ValueError:
            continue
        if old:
            system.delete(status.getPath(), True)
            gone.append(name)
    return sorted(gone)


def log(records: DataFrame, path: str) -> None:
    """Append success and failure records, by kind of document, year and type."""
    records.write.mode("append").partitionBy("doc_type", "year", "type_value").json(path)


def clear_log(spark: SparkSession, path: str, doc_type: str) -> None:
    """Empty the log of one kind of document."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/doc_type={doc_type}")
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def search_export(rows: DataFrame, path: str, form: str = "csv") -> None:
    """Results as CSV or JSON; arrays and structs become JSON text in CSV."""
    if form == "csv":
        rows = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes))
        rows.write.mode("overwrite").csv(path, header=True)
    elif form == "json":
        rows.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"no such form: {form!r}")
