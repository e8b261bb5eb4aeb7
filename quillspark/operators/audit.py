"""Counts, coverage, progress and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(year: Column, starts: Sequence[int]) -> Column:
    """Label of the period that a year is in; null for no year."""
    out = F.when(year.isNull(), None)
    for first, after in zip(starts, [*starts[1:], None], strict=True):
        label = f"{first}+" if after is None else f"{first}-{after - 1}"
        out = out.when((year >= first) & (F.lit(True) if after is None else year < after), label)
    return out.otherwise(f"before {starts[0]}")


def coverage(rows: DataFrame, source: str, kinds: Sequence[str]) -> DataFrame:
    """Total, by provenance, and the rest."""
    return rows.agg(F.count("*").alias("total"), *(F.count_if(F.col(source) == k).alias(f"n_{k}") for k in kinds), F.count_if(F.col(source).isNull()).alias("n_none"))


def histogram(rows: DataFrame, year: Column, starts: Sequence[int], source: str, kinds: Sequence[str]) -> DataFrame:
    """Rows by period and provenance."""
    return rows.withColumn("period", buckets(year, starts)).groupBy("period").agg(F.count("*").alias("total"), *(F.count_if(F.col(source) == k).alias(f"n_{k}") for k in kinds))


def counts_of(named: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in named.items()))


def formatted(n: Column) -> Column:
    return F.format_number(n, 0)


def tracker_stats(log: DataFrame, *keys: str, status: str = "status") -> DataFrame:
    return log.groupBy(*keys).agg(F.count_if(F.col(status) == "success").alias("successes"), F.count_if(F.col(status) == "failure").alias("failures"), F.count("*").alias("total"))


#: Prices of a million tokens: in, out, cached.
PRICES = (0.15, 0.60, 0.075)


def progress(results: DataFrame, kind: str, *, success: str = "success", seconds: str = "seconds", tokens: Sequence[str] = ("input_tokens", "output_tokens", "cached_tokens")) -> DataFrame:
    """Success rate, token sums, average seconds and cost by kind."""
    sums = [F.sum(c) for c in tokens]
    cost = reduce(lambda a, b: a + b, (s * p for s, p in zip(sums, PRICES, strict=True))) / 1_000_000
    return results.groupBy(kind).agg(F.count("*").alias("n"), F.round(F.avg(F.col(success).cast("int")), 6).alias("success_rate"), *(s.alias(c) for s, c in zip(sums, tokens, strict=True)), F.round(F.avg(seconds), 6).alias("avg_seconds"), F.round(cost, 6).alias("cost"))


def lengths(rows: DataFrame, text: str) -> DataFrame:
    n = F.length(text)
    return rows.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.floor(F.sum(n) / F.count(n)).cast("long").alias("mean"))


def latency(rows: DataFrame, name: str, value: str) -> DataFrame:
    """Mean, median, ends, sample deviation (0 of one) by name, and the rank by median.

    The median is exact: values are counted first, and a running sum over the
    counts finds the middle, so no group is held in memory.
    """
    v = F.col(value)
    base = rows.groupBy(name).agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias("deviation"), F.count(v).alias("__n"))
    counts = rows.where(v.isNotNull()).groupBy(name, v.alias("__v")).agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(name).orderBy("__v"))
    placed = counts.withColumn("__upto", upto).join(base.select(name, "__n"), name)
    low, high = F.floor((F.col("__n") + 1) / 2), F.floor(F.col("__n") / 2) + 1

    def holds(place: Column) -> Column:
        return F.max(F.when((F.col("__upto") >= place) & (F.col("__upto") - F.col("__c") < place), F.col("__v")))

    middle = placed.groupBy(name).agg(F.round((holds(low) + holds(high)) / 2, 6).alias("median"))
    out = base.join(middle, name, "left").drop("__n")
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("median"), name)).cast("long"))  # a row a name


def histogram_of(rows: DataFrame, attributes: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Counters and a histogram by attributes: rows, the sum of the values, and how many are at most each bound."""
    upto = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds]
    return rows.groupBy(*attributes).agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total"), *upto)


def changed_fields(rows: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """How many rows change in each field; null-safe."""
    return rows.agg(*(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(name) for name, (a, b) in pairs.items()))


def merge_chunks(chunks: DataFrame, key: str, order: str, lists: Sequence[str], sums: Sequence[str], first: Sequence[str], last: Sequence[str], good: Column | None = None) -> DataFrame:
    """One record of its chunks: lists joined in order, numbers summed, the first and the last value of others; bad chunks are left out."""
    rows = chunks if good is None else chunks.where(good)
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(c).alias("v")))), lambda x: x["v"])).alias(c) for c in lists]
    return rows.groupBy(key).agg(*joined, *(F.sum(c).alias(c) for c in sums), *(F.min_by(c, order).alias(c) for c in first), *(F.max_by(c, order).alias(c) for c in last))


def numbering_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Whether the distinct numbers of each group are 1 to n."""
    return rows.groupBy(key).agg(F.count_distinct(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).withColumn("complete", (F.col("low") == 1) & (F.col("high") == F.col("n")))


def manifest(rows: DataFrame, collection: str, size: Column) -> DataFrame:
    """Records and bytes of each collection and in total: the total sums the collections, not the rows again."""
    each = rows.groupBy(F.col(collection).alias("collection")).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"))
    return each.unionByName(each.agg(F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).select(F.lit("total").alias("collection"), "records", "bytes"))


def changes_by_act(edges: DataFrame, acts: Column, changed: str = "changed_url", affecting: str = "affecting_url") -> DataFrame:
    """``act, changed_by, affecting``: edges of each act in all spellings of its address; ``acts`` is an array of both normalised ends."""
    ends = edges.select(F.posexplode(acts).alias("side", "act")).where("act is not null")
    return ends.groupBy("act").agg(F.count_if(F.col("side") == 0).alias("changed_by"), F.count_if(F.col("side") == 1).alias("affecting"))


def notes_by_act(notes: DataFrame, act: str = "legislation_id") -> DataFrame:
    return notes.groupBy(act).agg(F.count("*").alias("notes"))


def reference_totals(act_refs: str, paragraph_refs: str) -> Column:
    """References of an act and of all its paragraphs."""
    return F.size(act_refs) + F.size(F.flatten(paragraph_refs))


#: Binary logarithm of the registers of a counting sketch, and its relative error at one standard deviation.
SKETCH, SKETCH_ERROR = 12, 1.04 / 2**6


def sketches(rows: DataFrame, day: str, collection: str, key: str) -> DataFrame:
    """``day, collection, sketch``: of the distinct keys of a day; null keys don't count.  Sketches merge, so only new rows are ever read."""
    return rows.groupBy(F.col(day).alias("day"), F.col(collection).alias("collection")).agg(F.hll_sketch_agg(key, SKETCH).alias("sketch"))


def merged(*stored: DataFrame) -> DataFrame:
    """Sketches of the same day and collection as one."""
    return reduce(DataFrame.unionByName, stored).groupBy("day", "collection").agg(F.hll_union_agg("sketch").alias("sketch"))


def estimated(stored: DataFrame, *by: str) -> DataFrame:
    """``by, n``: about how many distinct keys all stored sketches of a group have seen, each key once."""
    return stored.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
