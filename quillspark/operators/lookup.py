"""Lookups, ordered texts and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.uri import normalise_uri, parent_section, uuid5

#: Texts of one act in one row are bounded by this many provisions.
MOST_PROVISIONS = 1000
NO_TEXT = "No text was found for this act."


def page_by_key(rows: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """The first n rows in the order of their UUID keys: the order of a scan without a sort."""
    return rows.orderBy(uuid5(F.col(id_col).cast("string")), id_col).limit(n)


def sections_of(rows: DataFrame, act, n: int = 10, *, act_col: str = "legislation_id", number_col: str = "number", id_col: str = "id") -> DataFrame:
    """n sections of an act: limited first, in key order, then by number, null as 0."""
    return page_by_key(rows.where(F.col(act_col) == act), n, id_col).orderBy(F.coalesce(number_col, F.lit(0)), id_col)


def joined_text(order: list[Column], text: Column, between: str) -> Column:
    """Aggregate: the group's texts in order, joined."""
    row = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), text.alias("text"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), between)


def page(rows: DataFrame, order: list[Column], size: int, offset: int = 0) -> DataFrame:
    """A page of ordered rows with ``position`` and the ``total`` of all.

    Every task keeps its own first rows, so only a page is sorted in one place.
    """
    first = rows.orderBy(*order).limit(offset + size)
    placed = first.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return placed.where(F.col("position") > offset).join(F.broadcast(rows.agg(F.count("*").alias("total"))))


def full_text(provisions: DataFrame, *, most: int = MOST_PROVISIONS, act_col: str = "legislation_id", kind_col: str = "provision_type", number_col: str = "number", text_col: str = "text", id_col: str = "id") -> DataFrame:
    """``act, full_text``: sections before schedules, each by number, the first ``most`` of an act.

    The limit is set before the shuffle too, so no act is an unbounded group.
    """
    order = [F.when(F.col(kind_col) == "section", 0).otherwise(1), F.coalesce(number_col, F.lit(0)), F.col(id_col)]
    place = F.row_number().over(Window.partitionBy(act_col).orderBy(*order))
    chosen = provisions.withColumn("__place", place).where(F.col("__place") <= most)
    out = chosen.groupBy(act_col).agg(joined_text(order, F.col(text_col), "\n\n").alias("full_text"))
    return out.withColumn("full_text", F.when(F.trim("full_text") == "", NO_TEXT).otherwise(F.col("full_text")))


def acts_with_text(acts: DataFrame, provisions: DataFrame, key: str, **how) -> DataFrame:
    """Acts with their full text; one without provisions says so."""
    texts = full_text(provisions, act_col=key, **how)
    return acts.join(texts, key, "left").withColumn("full_text", F.coalesce("full_text", F.lit(NO_TEXT)))


def edges_of(edges: DataFrame, act, made: bool = False, n: int | None = 100, *, changed: str = "changed_url", affecting: str = "affecting_url", id_col: str = "id") -> DataFrame:
    """Amendments to an act or provision, or those that it made: the first n in key order, or all without an order."""
    found = edges.where(F.col(affecting if made else changed) == act)
    return found if n is None else page_by_key(found, n, id_col)


def citing_edges(edges: DataFrame, reference, key: str, references: str) -> DataFrame:
    """Keys whose references, an edge a row, hold one value: the filter reaches the scan."""
    return edges.where(F.col(references) == reference).select(key).distinct()


def without(rows: DataFrame, *columns: str) -> DataFrame:
    """All columns but some."""
    return rows.drop(*columns)


def citing(rows: DataFrame, reference, references: str) -> DataFrame:
    """Rows whose references hold one value."""
    return rows.where(F.array_contains(references, reference))


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys asked for that no row has."""
    return wanted.select(key).distinct().join(found, key, "left_anti")


def point_lookup(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows with the given keys; a few keys are broadcast by size, many are shuffled."""
    return rows.join(ids.select(key), key, "left_semi")


def texts_of_edges(edges: DataFrame, provisions: DataFrame, url: str, *, uri: str = "uri", text: str = "text", most: int = 8000, mark: str = "... [truncated]") -> DataFrame:
    """Edges with ``provision_text`` of the section that a URL lies in, under any spelling of it; cut with a mark, null where no section has a text."""
    section = lambda c: F.coalesce(parent_section(normalise_uri(c)), normalise_uri(c))
    held = provisions.where(F.length(F.trim(text)) > 0).select(section(uri).alias("__k"), F.col(text).alias("__t")).groupBy("__k").agg(F.min("__t").alias("__t"))
    cut = F.when(F.length("__t") > most, F.concat(F.substring("__t", 1, most), F.lit(mark))).otherwise(F.col("__t"))
    return edges.withColumn("__k", section(url)).join(held, "__k", "left").withColumn("provision_text", cut).drop("__k", "__t")
