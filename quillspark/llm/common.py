"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Small tables up to this number of rows are joined by a broadcast (some 8 to 40 bytes a row), larger ones by a shuffle.
BROADCAST_IDS = 500_000
#: Rows and bytes of the Arrow batches that go to Python workers, one setting for all operators.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20

#: Input files and written paths of the last run of each step, and the paths of steps that are running.
_steps: dict[tuple[str, int], tuple[set[str], list[str]]] = {}
_open: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir``.  Only where it is unset (local tests)
    is a temporary folder of this machine used; it goes when the driver ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, so that a lost executor costs one read and not the
    whole computation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def dropped(*tables: DataFrame | None) -> None:
    """Delete tables that ``written`` gave, once everything that reads them is written itself."""
    for df in tables:
        if (path := getattr(df, "_written_to", None)) is not None:
            _delete(df.sparkSession, path)
            for paths in _open:
                if path in paths:
                    paths.remove(path)


def _modified(spark: SparkSession, path: str) -> int:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()


@contextmanager
def step(spark: SparkSession, chain: str, number: int, reads: DataFrame) -> Iterator[None]:
    """Step ``number`` of a chain; the tables that the step before had written for itself go first.

    They go only if ``reads`` is a written result of that step: its files are
    newer than those tables, and are neither those nor what that step read.
    """
    files = set(reads.inputFiles())
    read, paths = _steps.pop((chain, number - 1), (set(), []))
    inside = [p.rpartition("/")[2] for p in paths]
    if paths and files and not files & read and not any(name in file for file in files for name in inside):
        if _modified(spark, min(files)) >= max(_modified(spark, p) for p in paths):
            for path in paths:
                _delete(spark, path)
    _open.append([])
    try:
        yield
    finally:
        _steps[chain, number] = files, _open.pop()


def few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A written table, marked for a broadcast if its rows are few."""
    return F.broadcast(df) if df.count() <= most else df


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers by rows and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_of(column: str = "text") -> Column:
    """The text as a string, with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
