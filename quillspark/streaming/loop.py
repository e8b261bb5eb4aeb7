"""The document loop on a stream of arriving files.

Each batch is cut to the asked years and types, freed of what the log has as
done, parsed once, upserted and logged.  What a batch parsed is a folder of its
number, so is its log, and the table remembers the batches that it holds: a
batch that is run again after a failure at any point changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark import shred
from quillspark.functions.uri import uuid5
from quillspark.operators import ingest
from quillspark.session import exists
from quillspark.sources.table import Table

LOG = "url string, uuid string, status string, error string, type string, year int"


@dataclass(frozen=True)
class Loop:
    """``parse`` gives records of ``schema`` from a text, their ``table.key`` among them; ``path`` holds logs and what batches parsed."""

    table: Table
    path: str
    parse: Callable[[str], list[dict]]
    schema: str
    types: Sequence[str] | None = None
    years: Sequence[int] | None = None
    limit: int | None = None

    def log(self, but: int | None = None) -> DataFrame:
        """What has been done, without a batch's own records."""
        spark = self.table.spark
        if not exists(spark, f"{self.path}/log"):
            return spark.createDataFrame([], f"{LOG}, batch int")
        found = spark.read.schema(f"{LOG}, batch int").parquet(f"{self.path}/log")
        return found if but is None else found.where(F.col("batch") != but)

    def batch(self, rows: DataFrame, number: int) -> None:
        """One batch of ``url, type, year, text``.  Of several rows of an address one of the largest text is read."""

        def todo() -> DataFrame:
            asked = rows.where("url is not null")
            asked = asked if self.types is None else asked.where(F.col("type").isin(list(self.types)))
            asked = asked if self.years is None else asked.where(F.col("year").isin(list(self.years)))
            log = self.log(but=number).where("status = 'success'")
            left = ingest.new_only(ingest.latest(asked, "url", "text"), log, "url", "url")
            return left if self.limit is None else left.orderBy(F.desc("year"), "type", "url").limit(max(self.limit - log.count(), 0))

        self._done(rows.sparkSession, todo, number)

    def again(self, asked: DataFrame, fetch: Callable[[DataFrame], DataFrame], number: int) -> None:
        """Documents of ``url, type, year`` are fetched and read anew, whatever the log says; what ``fetch`` (``url, html``) does not give is left as it is."""

        def todo() -> DataFrame:
            once = asked.where("url is not null").dropDuplicates(["url"])
            return once.join(fetch(once.select("url")).select("url", F.col("html").alias("text")), "url").where("text is not null")

        self._done(self.table.spark, todo, number)

    def _done(self, spark: SparkSession, todo: Callable[[], DataFrame], number: int) -> None:
        """Parse, upsert and log; each step is a folder or a version of the batch's number, so doing it again changes nothing."""
        staged = f"{self.path}/parsed/batch={number}"
        if not exists(spark, f"{staged}/_SUCCESS"):
            todo().select("url", "type", "year", shred.records(self.parse, self.schema, "text").alias("r")).write.mode("overwrite").parquet(staged)
        parsed = spark.read.parquet(staged)
        self.table.upsert(parsed.where("r.error is null").select(F.inline("r.rows")), batch=f"{self.path}#{number}")
        outcome = ingest.outcome(F.col("r.error"), F.lit(False))["status"]
        logged = parsed.select("url", uuid5("url").alias("uuid"), outcome.alias("status"), F.col("r.error").alias("error"), "type", F.col("year").cast("int").alias("year"))
        logged.write.mode("overwrite").parquet(f"{self.path}/log/batch={number}")

    def start(self, arriving: DataFrame) -> StreamingQuery:
        """All that has arrived, in batches, and then the end."""
        return arriving.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
