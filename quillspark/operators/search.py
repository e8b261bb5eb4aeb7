"""Searches composed of filters, candidate lists and fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.uri import uuid5
from quillspark.operators import cells, filters, fusion, postings, vectors

POOL, PER_ACT, TITLES, BOOST = 200, 10, 20, 0.3


def hybrid(rows: DataFrame, text: str, vector: Sequence[float] | None, size: int, *, offset: int = 0, where: Column | None = None, how: str = "dbsf", vectors_of: DataFrame | None = None, dense_limit: int | None = None, sparse_limit: int | None = None, id_col: str = "id", text_col: str = "text", vector_col: str = "dense", k: int = 60, posted: postings.Index | None = None, celled: cells.Index | None = None) -> DataFrame:
    """``id, score``: dense and sparse candidates of the filtered rows, fused.

    Without a vector the sparse list alone is the result; a blank query only
    filters, in the order of the keys' UUIDs.  ``vectors_of`` holds the vectors
    where they are a table of their own with the filter's columns.  ``posted``
    and ``celled`` are stored indexes of the texts and of the vectors,
    which are then asked instead of the tables; a filter gives them its ids.
    """
    ids = None if where is None else rows.where(where).select(F.col(id_col).alias("id"))
    rows = rows if where is None else rows.where(where)
    if not text.strip():
        return rows.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).orderBy(uuid5(F.col("id").cast("string"))).offset(offset).limit(size)
    want = size + offset

    def sparse_list(n: int, after: int = 0) -> DataFrame:
        if posted is not None:
            return posted.top_k(text, n, offset=after, allowed=ids)
        return vectors.sparse_top_k(rows, text, n, offset=after, id_col=id_col, text_col=text_col)

    if vector is None:
        return sparse_list(size, offset)
    if how == "rrf":
        dense_n, sparse_n = dense_limit or want, sparse_limit or want
    else:
        dense_n, sparse_n = dense_limit or max(30, 3 * want), sparse_limit or max(8, int(0.8 * want))
    if celled is not None:
        dense = celled.top_k(vector, dense_n, allowed=ids)
    else:
        dense = vectors.dense_top_k(rows if vectors_of is None else vectors_of, vector, dense_n, id_col=id_col, vector_col=vector_col)
    sparse = sparse_list(sparse_n)
    fused = fusion.rrf(dense, sparse, k=k) if how == "rrf" else fusion.dbsf(dense, sparse)
    return fusion.top(fused, size, offset)


def act_search(sections: DataFrame, titles: DataFrame, acts: DataFrame, *, size: int = 10, offset: int = 0, per_act: int = PER_ACT, boost: float = BOOST) -> DataFrame:
    """Acts of a page with their best sections.

    sections: ``id, score, act, number, kind, title, type, year`` of the pool;
    titles: ``id, score`` of acts by their titles; acts: ``id`` and metadata.

    Acts come in the order in which their first section ranks, then title-only
    acts by title; the boost does not reorder acts.  An act without a row of its
    own gets one made of its best section (``status`` stub); a title-only act
    shows one entry of kind title_match.
    """
    placed = sections.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    titled = titles.select(F.col("id").alias("t_act"), F.col("score").alias("t_score")).withColumn("t_place", F.row_number().over(Window.orderBy(F.desc("t_score"), "t_act")))
    met = placed.join(titled, placed.act == titled.t_act, "full_outer").withColumn("act", F.coalesce("act", "t_act"))
    score = F.when(F.col("place").isNull(), F.col("t_score")).when(F.col("t_score").isNotNull(), F.least(F.lit(1.0), F.col("score") + boost * F.col("t_score"))).otherwise(F.col("score"))
    met = met.withColumn("score", score)
    best = met.withColumn("nth", F.row_number().over(Window.partitionBy("act").orderBy(F.desc("score"), "place"))).where(F.col("nth") <= per_act)
    entry = F.struct(
        F.col("nth"), F.when(F.col("place").isNull(), "").otherwise(F.coalesce(F.col("number").cast("string"), F.lit(""))).alias("number"),
        F.when(F.col("place").isNull(), "title_match").otherwise(F.col("kind")).alias("provision_type"), F.round("score", 6).alias("score"),
    )
    grouped = best.groupBy("act").agg(
        F.array_sort(F.collect_list(entry)).alias("sections"), F.min("place").alias("first"), F.min("t_place").alias("by_title"),
        *(F.min_by(c, "nth").alias(f"stub_{c}") for c in ("title", "type", "year")),
    )
    ordered = grouped.withColumn("position", F.row_number().over(Window.orderBy(F.asc_nulls_last("first"), F.asc_nulls_last("by_title"), "act"))).withColumn("total", F.count("*").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    page = ordered.where(F.col("position").between(offset + 1, offset + size))
    known = acts.select(F.col("id").alias("act"), *(F.col(c).alias(f"own_{c}") for c in ("title", "type", "year")), F.lit(True).alias("known"))
    out = page.join(known, "act", "left")
    return out.select(F.col("position").cast("long").alias("position"), "act", *(F.when(F.col("known"), F.col(f"own_{c}")).otherwise(F.col(f"stub_{c}")).alias(c) for c in ("title", "type", "year")), F.when(F.col("known"), "").otherwise("stub").alias("status"), "sections", "total")


def section_search(sections: DataFrame, text: str, vector: Sequence[float] | None, size: int = 10, offset: int = 0, **request) -> DataFrame:
    """Provisions by text and vector, or by text alone, or only filtered; ``request`` is that of ``filters.provisions``."""
    return hybrid(sections, text, vector, size, offset=offset, where=filters.provisions(**request))


def title_search(acts: DataFrame, text: str, vector: Sequence[float] | None, size: int = TITLES, **request) -> DataFrame:
    """Acts by their titles, scores as shares of the best."""
    found = hybrid(acts, text, vector, size, where=filters.acts(**request), dense_limit=max(30, 3 * size), sparse_limit=max(8, int(0.8 * size)))
    return fusion.by_max(found)


def case_search(cases: DataFrame, text: str, vector: Sequence[float] | None, size: int = 20, offset: int = 0, *, id_col: str = "id", text_col: str = "text", vector_col: str = "dense", vectors_of: DataFrame | None = None, **request) -> DataFrame:
    """Judgments, their sections or their summaries by reciprocal rank; ``on_page`` and ``total`` count the page and all that pass the filter."""
    where = filters.cases(**request)
    page = hybrid(cases, text, vector, size, offset=offset, where=where, how="rrf", id_col=id_col, text_col=text_col, vector_col=vector_col, vectors_of=vectors_of)
    counts = cases.where(where).agg(F.count("*").alias("total"))  # of the filter's columns only
    return page.withColumn("on_page", F.count("*").over(Window.partitionBy())).join(F.broadcast(counts))


def note_search(notes: DataFrame, text: str, vector: Sequence[float] | None, size: int = 20, **request) -> DataFrame:
    """Explanatory notes by reciprocal rank; lists as long as the page, no offset."""
    return hybrid(notes, text, vector, size, where=filters.notes(**request), how="rrf", dense_limit=size, sparse_limit=size)


def bulk_search(rows: DataFrame, text: str, vector: Sequence[float] | None, size: int = 100, **request) -> DataFrame:
    """Fused by distribution, scores in hundredths of the best."""
    found = hybrid(rows, text, vector, size, where=filters.bulk(**request))
    return fusion.by_max(found).select("id", fusion.percent(F.col("score")).alias("score"))


def in_order(results: DataFrame, how: str, *, year: str = "year", title: str = "title") -> DataFrame:
    """Results by date or title (in the order of a dictionary); anything else leaves them as they rank."""
    orders = {"date-desc": [F.desc(year)], "date-asc": [F.asc(year)], "title-asc": [F.asc(F.collate(title, "UNICODE"))], "title-desc": [F.desc(F.collate(title, "UNICODE"))]}
    return results.orderBy(*orders[how]) if how in orders else results


def act_lookup(acts: DataFrame, kind: str, year: int, number: int) -> DataFrame:
    """The act of a type, year and number; nothing for a year or number that can't be."""
    valid = filters.valid_lookup(F.lit(year), F.lit(number))
    return acts.where(valid & (F.col("type") == kind) & (F.col("year") == year) & (F.col("number") == number)).limit(1)
