"""Connected components of a graph too large for one machine.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014) until every vertex points at the
smallest vertex of its component.  Each round is written to the shared folder,
so the plan stays short and a lost executor costs one round; a round goes when
its successor is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    near = edges.join(least, "src").where("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return near.union(least.select("src", F.col("low").alias("dst"))).distinct()


def components(edges: DataFrame, label: str = "components", most_rounds: int = 60) -> DataFrame:
    """``vertex, component``: for every vertex of ``edges (src, dst)`` but the
    roots themselves, the smallest vertex that it reaches.

    Vertices are of any type that has an order.  Null ends and loops are left
    out; repeated edges count once; no edges give an empty table.  Vertices that
    are absent are their own component.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct()
    before, old = None, None
    for _ in range(most_rounds):
        edges = written(_small(_large(edges)), label)
        dropped(old)
        old = edges
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("src").alias("vertex"), F.col("dst").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
