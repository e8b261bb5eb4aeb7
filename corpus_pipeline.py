"""From raw documents to packed training windows.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)``,
works on all that the stage before kept, and returns the columns of
``documents``, the last one packed pieces.  What a stage returns is written as
Parquet and read again as the next one's ``docs``; when a stage begins, the
tables that the stage before had written for itself are deleted.

Defined results, for all stages: a null text is the empty text, is not toxic,
stays in the near copies and holds no personal data; rows with a null id stay;
repeated rows are scored and packed each, and of equal rows the near copies keep
one; other columns are carried along, whatever their names; empty tables give
empty results.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard, packing, pii, toxicity
from quillspark.llm.common import dropped, few, step, table, text_of, written
from quillspark.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(function: Stage) -> Stage:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        number = [stage for _, stage in STAGES].index(run_stage)
        with step(spark, "pipeline", number, docs):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine does not reject; it learns from labelled rows of ``docs``."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the one of smallest id.

    Rows are told apart by their id and the digest of their text, so of several
    rows of the smallest id in a group the one of smallest digest stays, and of
    equal ones any.  Documents without words, and rows with a null id, stay.
    """
    digest = F.md5(text_of())
    found = jaccard.near_duplicates(docs, mark=digest).where("n_shingles > 0 and component_id is not null")
    found = written(found.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("component_id").alias("__name")), "found")
    gone = found.where("__id <> __name").select("__id", "__mark")
    named = found.where("__id = __name").groupBy("__id").agg(F.min("__mark").alias("__least"), F.count("*").alias("__rows")).where("__rows > 1")
    named = written(named, "named")
    repeated = found.join(few(named), "__id").where("__id = __name and __mark <> __least").select("__id", "__mark")
    gone = few(written(gone.union(repeated).distinct(), "gone"))
    columns = [F.col(c) for c in docs.columns]
    keyed = docs.select(*columns, docs["doc_id"].cast("long").alias("__id"), digest.alias("__mark"))
    kept = keyed.join(gone, ["__id", "__mark"], "left_anti")
    if not named.isEmpty():  # equal rows of one id
        once = kept.join(few(named), "__id", "left_semi").dropDuplicates(["__id", "__mark"])
        kept = kept.join(few(named), "__id", "left_anti").unionByName(once)
    return kept.select(*docs.columns)


@_stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; ``n_chars`` follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in out.columns else out


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("personal data", redact_pii), ("packing", pack_windows)]
#: SQL can't express training a machine or greedy packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
            dropped(before)
            before = docs
    return docs
