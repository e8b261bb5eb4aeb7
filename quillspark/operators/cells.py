"""A stored index of vectors in cells, and exact nearest neighbours by cosine.

Vectors are scaled to length one and go to the nearest of some centres; a cell
keeps its centre and its radius.  By the triangle inequality a vector ``x`` of a
cell with centre ``c`` is no nearer to the query ``q`` than ``|q - c| - radius``,
nor than ``||q - c| - |x - c||``, so cells and then rows are left out as soon as
``k`` neighbours are known.  What remains is first scored by int8 codes, each
stored with the length of its rounding error, which bounds how far the product
of the codes can be from the cosine; only vectors that this bound allows are
scored in full.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import vectors

#: Vectors from which centres are learnt, rounds of that, and the most centres.
SAMPLE, ROUNDS, CELLS = 20_000, 8, 1024
#: The cell of vectors without a direction: null, zero, not finite, or of another dimension.
NOWHERE = -1
_SLACK = 1e-9
_STORED = "id {}, vector array<float>, distance double, codes binary, step double, error double, cell int"


def _directions(column: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and whether there is one."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    known = column.is_valid().to_numpy(zero_copy_only=False) & (sizes == dimensions)
    out = np.zeros((len(column), dimensions))
    if known.any():
        flat = column.filter(pa.array(known)).flatten()
        out[known] = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(all="ignore"):
        known &= np.isfinite(out).all(1)
        out[~known] = 0
        most = np.abs(out).max(1, initial=0)
        known &= most > 0
        out[known] /= most[known, None]
        out[known] /= np.linalg.norm(out[known], axis=1)[:, None]
    return out, known


def _centres(points: np.ndarray, cells: int) -> np.ndarray:
    """Centres by Lloyd's rounds; the first ones are spread over the sample."""
    centres = np.unique(points, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(cells, len(centres))).astype(int)]
    for _ in range(ROUNDS):
        nearest = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        count = np.bincount(nearest, minlength=len(centres))
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def build(rows: DataFrame, path: str, *, id_col: str = "id", vector_col: str = "dense", dimensions: int | None = None, cells: int | None = None) -> None:
    """Write the index of ``rows`` under ``path``.

    Centres are learnt from at most ``SAMPLE`` vectors of smallest hash and only
    shape the cells; every row is in the index.  One shuffle, by cell and
    distance, so a crowded cell is many tasks.
    """
    spark = rows.sparkSession
    chosen = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(vector_col).cast("array<float>").alias("vector"))
    total, first = (c := chosen.agg(F.count("*").alias("n"), F.mode(F.when(F.size("v") > 0, F.size("v"))).alias("d")).first()).n, c.d
    dimensions = dimensions or first or 1
    sample = chosen.where(F.size("v") == dimensions).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    points, known = _directions(sample if isinstance(sample, pa.Array) else pa.array([], pa.list_(pa.float64())), dimensions)
    points = points[known] if known.any() else np.zeros((1, dimensions))
    centres = _centres(points, cells or min(CELLS, int(np.ceil(np.sqrt(max(total, 1))))))
    kind = chosen.schema["id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(1) / 2
        for batch in batches:
            unit, known = _directions(batch.column(1), dimensions)
            cell = (unit @ centres.T - half).argmax(1)
            distance = np.linalg.norm(unit - centres[cell], axis=1)
            step = np.maximum(np.abs(unit).max(1), 1e-300) / 127
            codes = np.rint(unit / step[:, None]).astype(np.int8)
            error = np.linalg.norm(unit - codes * step[:, None], axis=1)
            cell = np.where(known, cell, NOWHERE).astype(np.int32)
            columns = [batch.column(0), batch.column(2), pa.array(cell), pa.array(distance), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(step), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "cell", "distance", "codes", "step", "error"])

    placed = chosen.select("id", "v", "vector").mapInArrow(place, f"id {kind}, vector array<float>, cell int, distance double, codes binary, step double, error double")
    dealt = placed.repartitionByRange("cell", "distance").sortWithinPartitions("cell", "distance")
    dealt.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    sizes = spark.read.schema(_STORED.format(kind)).parquet(f"{path}/vectors").groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n"))
    places = spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, centre array<double>")
    sizes.join(F.broadcast(places), "cell", "left").withColumn("id", F.lit(None).cast(kind)).coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")  # a row a cell


@dataclass(frozen=True)
class Index:
    """An index that ``build`` has written: its folder, the type of its ids, and its cells, at most ``CELLS`` and one."""

    spark: SparkSession
    path: str
    kind: str
    cells: Sequence[Row]

    def rows(self, chosen: Sequence[Row], allowed: DataFrame | None = None) -> DataFrame:
        """Rows of the cells, from their folders alone; vectors without a direction are null."""
        schema = _STORED.format(self.kind)
        paths = [f"{self.path}/vectors/cell={r.cell}" for r in chosen]
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/vectors").parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        found = found if allowed is None else found.join(allowed.select("id"), "id", "left_semi")
        return found.withColumn("dense", F.when(F.col("cell") != NOWHERE, F.col("vector")))

    def top_k(self, query: Sequence[float], k: int, *, offset: int = 0, allowed: DataFrame | None = None, told: dict | None = None) -> DataFrame:
        """``id, score``: the k nearest by cosine after ``offset``, ties by id: the rows of ``vectors.dense_top_k``.

        ``allowed`` holds the ids that pass a filter.  ``told``, if given, gets
        the number of cells and of those read, and the numbers of rows and of
        those scored in full.  Vectors without a direction score 0, as all do
        for such a query.
        """
        want, size = k + offset, float(np.linalg.norm(np.asarray(query, float)))
        if not size or not want or not self.cells:
            return vectors.dense_top_k(self.rows(self.cells, allowed), query, k, offset=offset)
        unit = np.asarray(query, float) / size
        away = {r.cell: float(np.linalg.norm(unit - np.array(r.centre))) for r in self.cells if r.cell != NOWHERE}
        nearest = sorted((r for r in self.cells if r.cell in away), key=lambda r: (away[r.cell] - r.radius, r.cell))
        enough = np.cumsum([0, *(r.n for r in nearest)])[:-1] < want
        first = [r for r, x in zip(nearest, enough, strict=True) if x]
        got = vectors.dense_top_k(self.rows(first, allowed), query, want).collect()
        least = got[-1].score if len(got) == want else -1.0
        reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + _SLACK
        open_ = [r for r in nearest[len(first) :] if away[r.cell] - r.radius <= reach]
        more = [self._likely(open_, away, unit, least, reach, allowed)] if open_ else []
        if least <= 0 and len(self.cells) > len(away):
            more.append(self.rows([r for r in self.cells if r.cell == NOWHERE], allowed).select("id", "dense"))
        if told is not None:
            told |= {"cells": len(nearest), "read": len(first) + len(open_), "rows": sum(r.n for r in self.cells), "in_full": sum(r.n for r in first) + sum(x.count() for x in more)}
        schema = f"id {self.kind}, score double"
        if not more:
            return self.spark.createDataFrame([tuple(r) for r in got[offset:]], schema)
        have = self.spark.createDataFrame([tuple(r) for r in got], schema)
        others = vectors.dense_scores(reduce(DataFrame.unionByName, more), query)
        return have.unionByName(others).orderBy(F.desc("score"), "id").offset(offset).limit(k)

    def _likely(self, chosen: Sequence[Row], away: dict[int, float], unit: np.ndarray, least: float, reach: float, allowed: DataFrame | None) -> DataFrame:
        """Rows of the cells that their distance and their codes allow to score ``least``."""
        off = F.element_at(F.create_map(*(x for r in chosen for x in (F.lit(r.cell), F.lit(away[r.cell])))), F.col("cell"))
        ring = self.rows(chosen, allowed).where(F.abs(F.col("distance") - off) <= reach)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int8).reshape(batch.num_rows, -1)
                    bound = (codes @ unit) * batch.column(3).to_numpy() + batch.column(4).to_numpy()
                    batch = batch.filter(pa.array(bound >= least - _SLACK))
                yield batch.select([0, 1])

        return ring.select("id", "dense", "codes", "step", "error").mapInArrow(run, f"id {self.kind}, dense array<float>")


def opened(spark: SparkSession, path: str) -> Index:
    stored = spark.read.parquet(f"{path}/cells")
    return Index(spark, path, stored.schema["id"].dataType.simpleString(), stored.select("cell", "centre", "radius", "n").collect())
