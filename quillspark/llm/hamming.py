"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is cut into segments of about log2(n) bits for n rows, 16 at most; an index holds (segment, value) of all
distinct codes.  A query looks up, segment by segment, all values at distance
0, then 1, then 2 and so on.  Once radius r is done in all m segments, every
code within a distance of m * (r + 1) - 1 has been met, so a query ends when
its k-th verified distance is no larger.  Nothing is capped: the radius grows to
the width of a segment if it must, and then every code has been met.

Once k + 1 ids are known, hits farther than the last of them are dropped at once.
Equal codes are one row in the index, and equal query codes are searched once;
a code's ids beyond the k + 1 smallest can't be among the first k.

Defined results: a vector that is null, empty or holds null or NaN components
has no code, so it finds nothing and is not found; a query does not find its own
row; ties in distance go to the smaller id; with fewer than k other codes all
are returned; codes of another width are not found; other columns are not read,
whatever their names; a row with a null id neither asks nor is found; rows that
repeat an id and its code are one neighbour, but each of them that asks is
answered; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, table, written

#: Widest segment, and the bits that a segment's number is shifted by in a key.
SEGMENT = 16


def _packed(bits: Column, size: int, kind: str) -> Column:
    """Bits in groups of ``size``, each as a number."""
    groups = F.sequence(F.lit(0), F.ceil(F.size(bits) / size).cast("int") - 1)
    zero = F.lit(0).cast(kind)
    return F.transform(groups, lambda g: F.aggregate(F.slice(bits, g * size + 1, size), zero, lambda n, b: F.shiftleft(n, 1).bitwiseOR(b.cast(kind))))


def sign_code(vector: Column, size: int = 64, kind: str = "long") -> Column:
    """Signs of a vector in words of 64 bits, or in segments; null where there is no code."""
    good = F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(good, _packed(F.transform(vector, lambda x: (x > 0).cast("int")), size, kind))


def _distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _key(at: Column, value: Column) -> Column:
    return F.shiftleft(at, SEGMENT).bitwiseOR(value)


def top_k(rows: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None) -> DataFrame:
    """``query_id, rank, neighbour_id, distance`` for every row that ``is_query`` picks, against all rows."""
    is_query = F.col(id_col) % 50 == 0 if is_query is None else is_query
    vector = rows[vector_col]
    wide = max(4, min(SEGMENT, (max(rows.count(), 2) - 1).bit_length()))
    coded = rows.select(rows[id_col].cast("long").alias("id"), sign_code(vector).alias("code"), sign_code(vector, wide, "int").alias("segments"), F.size(vector).alias("width"), is_query.alias("asks"))
    coded = written(coded.where("code is not null and id is not null"), "codes")
    # the k + 1 smallest ids of each code; the limit works before the shuffle too
    first = Window.partitionBy("code", "width").orderBy("id")
    kept = coded.select("id", "code", "segments", "width").distinct().withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    codes = written(kept.groupBy("code", "segments", "width").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("n", F.size("ids")), "distinct-codes")
    index = codes.select("code", "width", "n", F.posexplode("segments").alias("at", "value")).select("code", "width", "n", _key(F.col("at"), F.col("value")).alias("key"))
    index = written(index, "segments")
    # values that occur at all: 2 ** wide at most for each segment; probes of others are not sent
    present = written(index.select("key", "width").distinct(), "present")
    if present.count() > BROADCAST_IDS:
        present = None
    tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = coded.where("asks").select(F.col("code").alias("asked"), "segments", "width").distinct()
    open_queries = written(asked.withColumn("most", F.col("width")), "open")
    kept_hits, answers = None, None
    for radius in range(wide + 1):
        masks = [sum(1 << b for b in chosen) for chosen in combinations(range(wide), radius)]
        # a few queries stand for very many probes: they are dealt out first, and probes are never broadcast
        probes = open_queries.repartition(tasks, "asked").select("asked", "width", "most", F.posexplode("segments").alias("at", "of"))
        near = F.transform(F.lit(masks), lambda m: _key(F.col("at"), m.bitwiseXOR(F.col("of"))))
        probes = probes.select("asked", "width", "most", F.explode(near).alias("key"))
        if radius and present is not None:
            probes = probes.join(F.broadcast(present), ["key", "width"], "left_semi")
        met = probes.hint("merge").join(index, ["key", "width"]).select("asked", "width", "most", "code", "n", _distance("asked", "code").alias("distance"))
        hits = met.where("distance <= most").drop("most")
        hits = (hits if kept_hits is None else hits.unionByName(kept_hits)).distinct()
        # in order of distance, codes are needed until k + 1 ids stand before; of the last distance all are
        closer = Window.partitionBy("asked", "width").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        ranked = hits.withColumn("before", F.coalesce(F.sum("n").over(closer), F.lit(0)))
        hits = written(ranked.where(F.col("before") < k + 1).drop("before"), "hits")
        sums = hits.groupBy("asked", "width").agg(F.sum("n").alias("found"), F.max("distance").alias("worst"))
        full = F.coalesce(F.col("found") >= k + 1, F.lit(False))
        sure = F.ceil(F.col("width") / wide) * (radius + 1) - 1
        ended = F.lit(True) if radius == wide else full & (F.col("worst") <= sure)
        state = open_queries.drop("most").join(sums, ["asked", "width"], "left")
        state = written(state.select("asked", "segments", "width", F.when(full, F.col("worst")).otherwise(F.col("width")).alias("most"), ended.alias("ended")), "state")
        done = hits.join(state.where("ended").select("asked", "width"), ["asked", "width"], "left_semi")
        answers = done if answers is None else answers.unionByName(done)
        open_queries = state.where("not ended").drop("ended")
        kept_hits = hits.join(open_queries.select("asked", "width"), ["asked", "width"], "left_semi")
        if open_queries.isEmpty():
            break
    # expand codes to ids, then equal queries
    found = answers.join(codes.select("code", "width", "ids"), ["code", "width"]).select("asked", "width", "distance", F.explode("ids").alias("neighbour_id"))
    by_code = Window.partitionBy("asked", "width").orderBy("distance", "neighbour_id")
    found = found.withColumn("nth", F.row_number().over(by_code)).where(F.col("nth") <= k + 1)
    lists = found.groupBy("asked", "width").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("found"))
    queries = coded.where("asks").select(F.col("id").alias("query_id"), F.col("code").alias("asked"), "width")
    own = F.filter("found", lambda x: x["neighbour_id"] != F.col("query_id"))
    out = queries.join(lists, ["asked", "width"]).select("query_id", F.posexplode(F.slice(own, 1, k)).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).cast("long").alias("rank"), F.col("hit.neighbour_id").alias("neighbour_id"), F.col("hit.distance").cast("long").alias("distance"))


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest sign codes of every fiftieth vector of ``embeddings``, against all."""
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH c AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
d AS (
  SELECT q.id AS query_id, r.id AS neighbour_id,
         CAST(list_sum(list_transform(list_zip(q.code, r.code), lambda z: abs(z[1] - z[2]))) AS BIGINT) AS distance
  FROM c q JOIN c r ON q.id <> r.id AND len(q.code) = len(r.code)
  WHERE q.id % 50 = 0),
n AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d)
SELECT query_id, rank, neighbour_id, distance FROM n WHERE rank <= 10
"""
