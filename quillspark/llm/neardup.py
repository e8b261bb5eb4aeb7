"""Near-duplicate vectors by quantised tile products.

Every vector is scaled to length one and quantised to int8 with its own step;
the length of what quantisation loses is kept with it.  Two blocks of vectors
meet in a tile: the int8 product plus the two loss bounds and a bound of what
float32 itself may lose (it grows with the dimension) is an upper bound of the
cosine, and only pairs whose bound reaches the threshold are computed in double
precision.  A tile gives link counts and a spanning forest of its links, never a
list of all pairs.

Equal vectors are one before that.  All vectors are compared with all others,
so work grows with the square of the distinct vectors; each is sent to as many
tiles as there are blocks, in the precision that it came in.

Defined results: vectors that are null, empty, zero or hold null, infinite or
NaN components link with nothing; vectors of different length do not link;
equal vectors link with each other; rows of one id are vertices of their own, by
their vector, and a component is named by its smallest id; a null id is kept
with a null component; other columns are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, few, small_batches, table, written
from .components import components

#: Vectors of a block, about; two blocks are what one task holds.
BLOCK_ROWS = 8192
_STRIP = 1024


def _prepare(vectors: DataFrame) -> DataFrame:
    """``id, key, v``: digest and bytes of each usable vector (float32 as such, else float64), else nulls."""
    kind = "<f4" if vectors.schema["v"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raw = [], []
            for x in batch.column(1).to_pylist():
                v = np.array([np.nan if y is None else y for y in x or ()], kind) + 0  # one zero
                good = len(v) and np.isfinite(v).all() and v.any()
                keys.append(hashlib.blake2b(v.tobytes(), digest_size=16).digest() if good else None)
                raw.append(v.tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "v"])

    return vectors.mapInArrow(run, "id long, key binary, v binary")


def _quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their steps, and bounds of what rounding lost of each unit vector."""
    unit = v / np.linalg.norm(v / np.abs(v).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(v).max(1, keepdims=True)
    step = np.abs(unit).max(1) / 127
    q = np.rint(unit / step[:, None])
    lost = np.linalg.norm(unit - step[:, None] * q, axis=1) + 1e-9
    return q.astype(np.int8), step, lost


class _Forest:
    """Components of local numbers; every label is the smallest of its component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, x: np.ndarray, y: np.ndarray) -> None:
        while True:
            a, b = self.label[x], self.label[y]
            apart = a != b
            if not apart.any():
                return
            parent = np.arange(len(self.label))
            np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while not np.array_equal(up := parent[parent], parent):
                parent = up
            self.label = parent[self.label]


_VERTEX = pa.struct([("id", pa.int64()), ("key", pa.binary())])


def _tile(threshold: float, kind: str):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("id", "ascending"), ("key", "ascending")])  # a local number is smaller if the vertex is
        block, copies = (rows.column(c).to_numpy() for c in ("block", "copies"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), kind).reshape(rows.num_rows, -1).astype(np.float64)
        v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])  # by a power of two, which is exact: no square is too large or too small
        q, step, lost = _quantise(v)
        norm = np.linalg.norm(v, axis=1)
        # both vectors have length one, so float32 loses at most 2 ** -24 of about one in each of d additions; the rest is for steps and bounds
        slack = np.float32(max(1e-5, 2.0**-22 * v.shape[1]))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        count, forest = np.zeros(len(v), np.int64), _Forest(len(v))
        qr, sr, lr = q[right].astype(np.float32), step[right].astype(np.float32), lost[right].astype(np.float32)
        for k in range(0, len(left), _STRIP):
            part = left[k : k + _STRIP]
            bound = (q[part].astype(np.float32) @ qr.T) * step[part, None].astype(np.float32) * sr
            lp = lost[part, None].astype(np.float32)
            # |x.y - approximation| <= (1 + lx) ly + (1 + ly) lx + lx ly, and float32's own rounding
            bound += (1 + lp) * lr + (1 + lr) * lp + lp * lr + slack
            maybe = np.flatnonzero((bound >= threshold).ravel())
            for m in range(0, len(maybe), 1 << 15):
                x, y = np.divmod(maybe[m : m + (1 << 15)], len(right))
                x, y = part[x], right[y]
                if i == j:
                    x, y = x[x < y], y[x < y]
                cosine = np.einsum("ij,ij->i", v[x], v[y]) / (norm[x] * norm[y])
                x, y = x[cosine >= threshold], y[cosine >= threshold]
                np.add.at(count, x, copies[y])
                np.add.at(count, y, copies[x])
                forest.unite(x, y)
        linked = np.flatnonzero(count)
        inner = np.flatnonzero(forest.label != np.arange(len(v)))
        ids, keys = rows.column("id").combine_chunks(), rows.column("key").combine_chunks()

        def vertex(places: np.ndarray) -> pa.Array:
            at = pa.array(places)
            return pa.StructArray.from_arrays([ids.take(at), keys.take(at)], fields=list(_VERTEX))

        return pa.table({
            "a": pa.concat_arrays([vertex(linked), vertex(inner)]),
            "b": pa.concat_arrays([pa.nulls(len(linked), _VERTEX), vertex(forest.label[inner])]),
            "n": pa.concat_arrays([pa.array(count[linked]), pa.nulls(len(inner), pa.int64())]),
        })

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``id_col, n_links, component_id, kept``: one row per vector."""
    small_batches(vectors.sparkSession)
    given = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("v"))
    single = given.schema["v"].dataType.simpleString() == "array<float>"
    every = written(_prepare(given), "vectors")
    usable = every.where("key is not null and id is not null")
    # equal vectors have equal bytes, so any of them will do; a vertex is the smallest id with the digest
    reps = written(usable.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct")
    n_blocks = max(1, -(-reps.count() // block_rows))
    size = F.length("v")
    blocks = reps.select("id", "key", "copies", "v", size.alias("dim"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int").alias("block"))
    other = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("other")
    tiles = blocks.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    vertex = "struct<id:bigint,key:binary>"
    found = written(tiles.groupBy("dim", "i", "j").applyInArrow(_tile(threshold, "<f4" if single else "<f8"), f"a {vertex}, b {vertex}, n long"), "tiles")
    counts = found.where("b is null").groupBy("a.key").agg(F.sum("n").alias("links"))
    roots = components(found.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")), "vector-components")
    of_class = reps.drop("v").join(counts, "key", "left").join(roots.select("vertex.key", F.col("component.id").alias("root")), "key", "left")
    of_class = of_class.where("copies > 1 or links is not null").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "id").alias("root"))
    out = every.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(few(written(of_class, "linked")), "key", "left")
    dropped(found)
    root = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), (F.col("id") == root).alias("kept"))


def op2_near_duplicate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all ``embeddings`` at a cosine of 0.95."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) ELSE -1 END >= 0.95),
r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
l AS (SELECT a, min(b) AS low FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(l.low, e.vec_id)) AS component_id, e.vec_id <= coalesce(l.low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN l ON l.a = e.vec_id
"""
