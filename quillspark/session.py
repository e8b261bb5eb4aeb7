"""Sessions: a local one for tests, and the package on every executor."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for a context.

    Spark's own file server hands it out, so no folder has to be shared.
    """
    context = spark.sparkContext
    if getattr(context, "_quillspark_sent", False):
        return spark
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="quillspark-"))
    atexit.register(shutil.rmtree, folder, True)
    for source in package.rglob("*.py"):
        target = folder / "tree" / package.name / source.relative_to(package)
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copyfile(source, target)
    context.addPyFile(shutil.make_archive(str(folder / "quillspark"), "zip", folder / "tree"))
    context._quillspark_sent = True
    return spark


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, in local tests, one of this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, folder, True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def made_once(spark: SparkSession, source: str, kind: str, build) -> str:
    """The folder of what ``build(path)`` makes of the files at ``source``; made once in an application for files of the same names, sizes and times."""
    place = spark._jvm.org.apache.hadoop.fs.Path(source)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [place] if system.getFileStatus(place).isFile() else [f.getPath() for f in system.listStatus(place)]
    states = sorted(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}" for s in map(system.getFileStatus, found))
    path = f"{scratch(spark)}/{spark.sparkContext.applicationId}/{kind}-{hashlib.sha256(chr(10).join(states).encode()).hexdigest()[:24]}"
    if not exists(spark, f"{path}/_BUILT"):
        build(path)
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_BUILT")
        done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done).close()
    return path


def local(name: str = "quillspark", cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
