"""Fusion of ranked lists ``id, score``.

Lists are candidates of a bounded number that a top-k has put in one place, so
their statistics are windows over them and no list is computed twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _list():
    """All rows of a candidate list."""
    return Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _spread(scores: DataFrame) -> DataFrame:
    """Scores as places between mean - 3 sigma (0) and mean + 3 sigma (1); 0.5 where nothing spreads."""
    stats = scores.select("id", "score", F.avg("score").over(_list()).alias("m"), F.stddev_samp("score").over(_list()).alias("s"))
    place = (F.col("score") - (F.col("m") - 3 * F.col("s"))) / (6 * F.col("s"))
    fit = F.when(F.coalesce(F.col("s"), F.lit(0.0)) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))).otherwise(0.5)
    return stats.select("id", fit.alias("score"))


def _sum(lists: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, lists).groupBy("id").agg(F.sum("score").alias("score"))


def dbsf(*lists: DataFrame) -> DataFrame:
    """Distribution-based score fusion."""
    return _sum([_spread(x) for x in lists])


def ranked(scores: DataFrame, score: str = "score") -> DataFrame:
    """With ``rank`` from 1; ties by id.  For candidate lists, which are of a bounded number."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def rrf(*lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank)."""
    return _sum([ranked(x).select("id", (1.0 / (F.lit(k) + F.col("rank"))).alias("score")) for x in lists])


def top(scores: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").offset(offset).limit(n)


def by_max(scores: DataFrame) -> DataFrame:
    """Scores as shares of the highest; of 1 where that is not above 0."""
    high = F.max("score").over(_list())
    return scores.select("id", (F.col("score") / F.when(high > 0, high).otherwise(1.0)).alias("score"))


def percent(score: Column) -> Column:
    return F.round(100 * score, 2)
