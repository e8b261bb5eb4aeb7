"""File sources: XML, CSV, JSON lines, and stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PDF_LIST = "pdf_url string, legislation_type string, identifier string"


def xml_files(spark: SparkSession, root: str, years: Sequence[int] | None = None, types: Sequence[str] | None = None) -> DataFrame:
    """``text, file, year, type, number`` of ``root/year/type-…-number.xml``; years and types prune the listing."""
    paths = [f"{root}/{y}/*.xml" for y in years] if years else [f"{root}/*/*.xml"]
    files = spark.read.text(paths, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    year, number = F.regexp_extract("path", r"/(\d{4})/[^/]*$", 1), F.regexp_extract(name, r"(\d+)\.xml$", 1)
    out = files.select("text", name.alias("file"), F.when(year != "", year.cast("int")).alias("year"), F.regexp_extract(name, r"^([a-z]+)", 1).alias("type"), F.when(number != "", number.cast("int")).alias("number"))
    return out.where(F.col("type").isin(list(types))) if types else out


def file_order(year: str = "year", number: str = "number") -> list[Column]:
    """Files without a number first, then the newest."""
    return [F.desc_nulls_first(year), F.desc_nulls_first(number)]


def pdf_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PDF_LIST)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank and broken lines are left out."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def scan(spark: SparkSession, path: str, where: Column | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A stored table: filters and columns reach the Parquet reader."""
    rows = spark.read.parquet(path)
    rows = rows if where is None else rows.where(where)
    return rows.select(*columns) if columns else rows


def split_by_year(types: Sequence[str], years: Sequence[int], modern: int = 1963) -> list[tuple[str, int, bool]]:
    """(type, year, modern) tasks of a listing, modern years first: each is a partition of the listing source."""
    return sorted(((t, y, y >= modern) for y in years for t in types), key=lambda x: not x[2])
