"""A table in buckets by a hash of its key, with versions.

A version is a manifest: for each bucket the folder that holds its rows.  New
rows change only the buckets of their keys; these are merged and written as
folders of the next version, and every other bucket keeps its files.  A
manifest comes into being by a rename that fails where there is one already, so
of two writers of a version one has to try again, and no row is lost.  A batch
that a manifest names has been written; writing it again changes nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators import ingest

#: Batches that a manifest remembers.
BATCHES = 1000


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Table:
    """Rows of distinct ``key``, of which the one with the highest ``sequence`` counts."""

    spark: SparkSession
    path: str
    key: str
    sequence: str
    buckets: int = 64

    def _place(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        place, system = self._place("manifest")
        names = [s.getPath().getName() for s in system.listStatus(place)] if system.exists(place) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``version, schema, folders, batches`` of a version, the newest by default; of no version where there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "folders": {}, "batches": []}
        place, system = self._place(f"manifest/{version}.json")
        stream = system.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, held: dict) -> int:
        jvm = self.spark._jvm
        place, system = self._place(f"manifest/.{uuid.uuid4().hex}")
        stream = system.create(place)
        stream.write(bytearray(json.dumps(held).encode()))
        stream.close()
        target, _ = self._place(f"manifest/{held['version']}.json")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(system.makeQualified(place), system.makeQualified(target), none)
        except Exception as problem:
            system.delete(place, False)
            if "FileAlreadyExists" in str(problem):
                raise Conflict(f"version {held['version']} of {self.path} has been made") from None
            raise
        return held["version"]

    def _rows(self, held: dict, buckets: set[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}" for bucket, folder in held["folders"].items() if buckets is None or int(bucket) in buckets]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default."""
        held = self.manifest(version)
        if held["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        return self._rows(held)

    def lookup(self, *keys) -> DataFrame:
        """Rows of some keys, from their buckets alone."""
        held = self.manifest()
        if held["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        kind = StructType.fromJson(held["schema"])[self.key].dataType.simpleString()
        asked = self.spark.createDataFrame([(k,) for k in keys], f"k {kind}").select(self._bucket("k"))
        return self._rows(held, {r[0] for r in asked.collect()}).where(F.col(self.key).isin(*keys))

    def _bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(column or self.key), F.lit(self.buckets)).cast("int").alias("__bucket")

    def upsert(self, new: DataFrame, batch: str | None = None) -> int:
        """Rows replace those of the same key and a sequence not above theirs; gives the version that holds them.

        Rows with a null key are left out.  A ``batch`` that has been written is
        not written again.
        """
        held = self.manifest()
        if batch is not None and batch in held["batches"]:
            return held["version"]
        placed = new.where(F.col(self.key).isNotNull()).withColumn("__bucket", self._bucket())
        touched = {r[0] for r in placed.select("__bucket").distinct().collect()}  # at most the table's buckets
        if held["schema"] is not None:
            old = self._rows(held, touched).withColumn("__bucket", self._bucket())
            placed = placed.withColumn("__new", F.lit(1)).unionByName(old.withColumn("__new", F.lit(0)))
        else:
            placed = placed.withColumn("__new", F.lit(1))
        # one shuffle: a bucket is one task, which is what is merged and what is written
        last = Window.partitionBy("__bucket", self.key).orderBy(F.desc_nulls_last(self.sequence), F.desc("__new"))
        merged = placed.repartition("__bucket").withColumn("__nth", F.row_number().over(last)).where("__nth = 1")
        return self._replace(held, merged.select("__bucket", *new.columns), touched, new.schema, batch)

    def patch(self, patches: DataFrame, *columns: str) -> int:
        """Set some columns by key; null in a patch leaves what was, keys that are absent are left out."""
        held = self.manifest()
        if held["schema"] is None:
            raise ValueError(f"no table at {self.path}")
        touched = {r[0] for r in patches.select(self._bucket()).distinct().collect()}
        old = self._rows(held, touched)
        once = patches.groupBy(self.key).agg(*(F.max(c).alias(c) for c in columns))
        made = ingest.patch(old, once, self.key, *columns).withColumn("__bucket", self._bucket()).repartition("__bucket")
        return self._replace(held, made, touched, old.schema, None)

    def recreate(self, rows: DataFrame) -> int:
        """Drop all rows and begin anew with these; older versions stay until ``vacuum``."""
        held = self.manifest()
        one = ingest.latest(rows.where(F.col(self.key).isNotNull()), self.key, self.sequence)
        return self._replace(held | {"folders": {}, "batches": []}, one.withColumn("__bucket", self._bucket()).repartition("__bucket"), set(range(self.buckets)), rows.schema, None)

    def _replace(self, held: dict, rows: DataFrame, touched: set[int], schema: StructType, batch: str | None) -> int:
        version = held["version"] + 1
        folder = f"data/{version}-{uuid.uuid4().hex[:8]}"
        rows.write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        place, system = self._place(folder)
        made = {n.partition("=")[2] for s in system.listStatus(place) if (n := s.getPath().getName()).startswith("__bucket=")}
        folders = {b: f for b, f in held["folders"].items() if int(b) not in touched} | {b: f"{folder}/__bucket={b}" for b in made}
        batches = [*held["batches"], *([batch] if batch is not None else [])][-BATCHES:]
        return self._commit({"version": version, "schema": json.loads(schema.json()), "folders": folders, "batches": batches})

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all versions but the newest ``keep``, and folders that none of those names; gives what was deleted."""
        every = self.versions()
        kept = every[-keep:] if keep else []
        named = {f.split("/")[1] for v in kept for f in self.manifest(v)["folders"].values()}
        gone = [f"manifest/{v}.json" for v in every if v not in kept]
        place, system = self._place("data")
        gone += [f"data/{n}" for s in (system.listStatus(place) if system.exists(place) else []) if (n := s.getPath().getName()) not in named]
        for name in gone:
            system.delete(self._place(name)[0], True)
        return gone
