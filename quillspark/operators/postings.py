"""A stored inverted index of BM25 weights, and exact top-k that skips blocks.

Documents are put in order by their heaviest term and cut into segments of
``SEGMENT``; a block holds the postings of one term in one segment, with the
highest weight among them.  Blocks lie in folders by a hash of the term, so a
query reads the folders of its terms only.  The highest weights bound what any
document of a segment can score.  The segments of highest bound are scored
first; once ``k`` documents are known, a segment whose bound is below the k-th
score is never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import vectors
from quillspark.session import exists

#: Documents of a segment, folders of the index, and segments scored before the bound is known.
SEGMENT, FOLDERS, FIRST = 64, 64, 8
#: Bounds are sums of doubles in another order than scores.
_SLACK = 1e-9


def _folder(term: str, folders: int) -> int:
    return zlib.crc32(term.encode()) % folders


def build(rows: DataFrame, path: str, *, id_col: str = "id", text_col: str = "text", segment: int = SEGMENT, folders: int = FOLDERS, k1: float = vectors.K1, b: float = vectors.B, average: float = vectors.AVERAGE) -> None:
    """Write the index of ``rows`` under ``path``.

    Ids are distinct.  Null and empty texts have no postings and are never
    found.  Shuffles: documents with their weights by their order, and blocks by
    ranges of terms; no group is larger than a segment or a text.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    vectors.weighed(rows, id_col, text_col, k1, b, average).write.mode("overwrite").parquet(f"{path}/documents")
    order = ("top", F.desc("most"), "id")
    ordered = spark.read.parquet(f"{path}/documents").repartitionByRange(*order).sortWithinPartitions(*order)
    # rows of a partition are numbered one after another, so a segment lies in one partition
    placed = ordered.withColumn("segment", F.floor(F.monotonically_increasing_id() / segment))
    made = placed.select("id", "segment", "terms", "weights").mapInArrow(_blocks(folders), f"folder int, term string, segment long, most double, postings array<struct<id: {kind}, weight: double>>")
    made.write.mode("overwrite").parquet(f"{path}/staged")
    # a common term is many segments: ranges split it
    blocks = spark.read.parquet(f"{path}/staged").repartitionByRange("folder", "term", "segment")
    blocks.sortWithinPartitions("folder", "term", "segment").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")


def _blocks(folders: int):
    """Blocks of segments whose documents follow one another: postings of a term by id, with their highest weight."""

    def of(segment: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, _, terms, weights = (c.combine_chunks() for c in pa.Table.from_batches(held).combine_chunks().columns)
        flat = pa.table({"term": terms.flatten(), "id": ids.take(pc.list_parent_indices(terms)), "weight": weights.flatten()})
        ordered = flat.sort_by([("term", "ascending"), ("id", "ascending")]).combine_chunks()
        term, owner, weight = (c.combine_chunks() for c in ordered.columns)
        runs = pc.run_end_encode(term)
        starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
        postings = pa.ListArray.from_arrays(pa.array([*starts, len(term)], pa.int32()), pa.StructArray.from_arrays([owner, weight], ["id", "weight"]))
        named = pa.array([_folder(t, folders) for t in runs.values.to_pylist()], pa.int32())
        most = pa.array(np.maximum.reduceat(weight.to_numpy(zero_copy_only=False), starts), pa.float64())
        return pa.RecordBatch.from_arrays([named, runs.values, pa.array(np.full(len(starts), segment), pa.int64()), most, postings], ["folder", "term", "segment", "most", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            segments, first = batch.column(1).to_pylist(), 0
            while first < len(segments):
                last = bisect_right(segments, segments[first])
                if held and segments[first] != at:
                    yield of(at, held)
                    held = []
                at = segments[first]
                held.append(batch.slice(first, last - first))
                first = last
        if held:
            yield of(at, held)

    return run


@dataclass(frozen=True)
class Index:
    """An index that ``build`` has written: its folder, the type of its ids, and how it was built."""

    spark: SparkSession
    path: str
    kind: str
    segment: int = SEGMENT
    folders: int = FOLDERS
    first: int = FIRST

    def blocks(self, terms: Iterable[str]) -> DataFrame:
        """Blocks of the terms, from their folders alone."""
        names = sorted({f"{self.path}/blocks/folder={_folder(t, self.folders)}" for t in terms})
        held = [n for n in names if exists(self.spark, n)]
        schema = f"term string, segment long, most double, postings array<struct<id: {self.kind}, weight: double>>"
        stored = self.spark.read.schema(schema).parquet(*held) if held else self.spark.createDataFrame([], schema)
        return stored.where(F.col("term").isin(list(terms)))

    def top_k(self, query: str, k: int, *, offset: int = 0, allowed: DataFrame | None = None, told: dict | None = None, **how) -> DataFrame:
        """``id, score`` of the k best after ``offset``, by score and id: the rows of ``vectors.sparse_top_k``.

        ``allowed`` holds the ids that pass a filter.  ``told``, if given, gets
        the number of segments that hold a term and of those that were scored.
        A query without words finds nothing.
        """
        terms, want = vectors.term_weights(query, **how), k + offset
        schema = f"id {self.kind}, score double"
        if not terms or not want:
            return self.spark.createDataFrame([], schema)
        found = self.blocks(terms)
        bounded = bounds(found, terms)
        # the segments of highest bound: their number is the caller's, not the table's
        ahead = max(self.first, -(-4 * want // self.segment))
        best = bounded.orderBy(F.desc("bound"), "segment").limit(ahead).collect()
        chosen = [r.segment for r in best]
        scored = _scores(found.where(F.col("segment").isin(chosen)), terms, allowed)
        known = scored.orderBy(F.desc("score"), "id").limit(want).collect()
        least = known[-1].score * (1 - _SLACK) if len(known) == want else 0.0  # scores are above 0
        rest = bounded.where((F.col("bound") >= least) & ~F.col("segment").isin(chosen))
        more = len(best) == ahead and best[-1].bound >= least
        if told is not None:
            told |= {"segments": bounded.count(), "scored": len(best) + (rest.count() if more else 0)}
        if not more:
            return self.spark.createDataFrame([tuple(r) for r in known[offset:]], schema)
        have = self.spark.createDataFrame([tuple(r) for r in known], schema)
        others = _scores(found.join(rest.select("segment"), "segment", "left_semi"), terms, allowed)
        return have.unionByName(others).orderBy(F.desc("score"), "id").offset(offset).limit(k)


def opened(spark: SparkSession, path: str, **how) -> Index:
    return Index(spark, path, spark.read.parquet(f"{path}/documents").schema["id"].dataType.simpleString(), **how)


def bounds(found: DataFrame, terms: dict[str, float]) -> DataFrame:
    """``segment, bound``: the most that a document of the segment can score."""
    return found.groupBy("segment").agg(F.sum(_weight(terms) * F.col("most")).alias("bound"))


def _weight(terms: dict[str, float]) -> Column:
    return F.coalesce(*(F.when(F.col("term") == t, F.lit(w)) for t, w in terms.items()))


def _scores(found: DataFrame, terms: dict[str, float], allowed: DataFrame | None) -> DataFrame:
    """Exact scores of the blocks' documents; a document's blocks are all in ``found``.  Parts are added in the query's order."""
    posted = found.select("term", F.explode("postings").alias("p")).select("term", "p.id", "p.weight")
    if allowed is not None:
        posted = posted.join(allowed.select("id"), "id", "left_semi")
    parts = [F.coalesce(F.max(F.when(F.col("term") == t, F.lit(w) * F.col("weight"))), F.lit(0.0)) for t, w in terms.items()]
    return posted.groupBy("id").agg(reduce(lambda x, y: x + y, parts).alias("score"))
