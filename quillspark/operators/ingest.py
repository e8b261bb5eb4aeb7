"""Incremental ingest: upserts, anti-joins, staleness, year recovery."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.regnal import year_of


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key.  The rank limit works before the shuffle, so a hot key costs a row a task."""
    last = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in order))
    return rows.withColumn("__nth", F.row_number().over(last)).where("__nth = 1").drop("__nth")


def upsert(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """New rows replace old ones of the same key; doing it again changes nothing."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return latest(both, key, "__new", sequence).drop("__new")


def new_only(rows: DataFrame, done: DataFrame, key: str | Column, done_key: str) -> DataFrame:
    """Rows whose key has not been done."""
    made = rows.withColumn("__k", F.col(key) if isinstance(key, str) else key)
    return made.join(done.select(F.col(done_key).alias("__k")), "__k", "left_anti").drop("__k")


def last_change(edges: DataFrame, target: str, year: str) -> DataFrame:
    """Latest year of a change to each act; zero and null don't count."""
    return edges.where(F.col(target).isNotNull() & (F.col(year) > 0)).groupBy(target).agg(F.max(year).alias("last_change"))


def staleness(changes: DataFrame, held: DataFrame, key: str, modified_year: str) -> DataFrame:
    """``state`` of each changed act: missing, stale or current."""
    met = changes.join(held.select(key, F.col(modified_year).alias("held_year"), F.lit(True).alias("held")), key, "left")
    state = F.when(F.col("held").isNull(), "missing").when(F.col("held_year").isNull() | (F.col("held_year") < F.col("last_change")), "stale").otherwise("current")
    return met.withColumn("state", state)


def to_refresh(changes: DataFrame, held: DataFrame, source: DataFrame, key: str, modified_year: str) -> DataFrame:
    """Documents of the source that an amendment has made missing or stale."""
    due = staleness(changes, held, key, modified_year).where("state <> 'current'")
    return source.join(due.select(key, "state"), key)


def patch(rows: DataFrame, patches: DataFrame, key: str, *columns: str) -> DataFrame:
    """Set some columns by key; the others stay, null in a patch leaves the old value."""
    given = patches.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    met = rows.join(given, key, "left")
    return met.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in rows.columns))


def spread_year(rows: DataFrame, group: str, year: str) -> DataFrame:
    """One known year of a group is given to all of its rows without one."""
    known = rows.where(F.col(year).isNotNull()).groupBy(group).agg(F.min(year).alias("__y"))
    return rows.join(known, group, "left").withColumn(year, F.coalesce(year, "__y")).drop("__y")


def recover_years(rows: DataFrame, identifier: str, text: str, group: str, year: str = "year", fallback=None) -> DataFrame:
    """Years in three tiers: the identifier, a pluggable column function, then the act's text; each act's year is spread."""
    found = F.coalesce(F.col(year), year_of(identifier))
    if fallback is not None:
        found = F.coalesce(found, fallback(F.col(identifier)))
    tier = rows.withColumn(year, F.coalesce(found, year_of(identifier, text)))
    return spread_year(tier, group, year)


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the rest; null counts as not valid."""
    good = F.coalesce(valid, F.lit(False))
    return rows.where(good), rows.where(~good)


def ingest_flow(raw: DataFrame, fallback: DataFrame, key: str, text: str, least: int = 100) -> DataFrame:
    """Records with enough text; for the others the fallback's record of that key, where there is one."""
    good, poor = quarantine(raw, F.length(F.trim(text)) >= least)
    return good.withColumn("origin", F.lit("xml")).unionByName(fallback.join(poor.select(key), key, "left_semi").withColumn("origin", F.lit("fallback")))


def outcome(error: Column, terminal: Column) -> Column:
    """Status of a document: a terminal failure is recorded as failed and marked, so that it is not tried again by hand."""
    return F.struct(F.when(error.isNull(), "success").otherwise("failure").alias("status"), (error.isNotNull() & F.coalesce(terminal, F.lit(False))).alias("terminal"))


def first_documents(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n documents over all years and types: every task keeps its own n."""
    return rows.orderBy(*order).limit(n)


def first_valid(folders: Sequence[str], read: Callable[[Sequence[str]], DataFrame], n: int, *, ahead: int = 1) -> tuple[DataFrame, int]:
    """The first n rows of folders in order, and how many folders were opened.

    ``read`` gives the valid rows of some folders.  Folders are opened ``ahead``
    at a time, then twice and four times as many, until n rows are valid; what
    follows is never listed or read.  The rows are those of the opened folders
    without those of the last steps that are not needed, in no order within a
    folder but that of ``read``.
    """
    opened, found, parts = 0, 0, []
    while opened < len(folders) and found < n:
        some = folders[opened : opened + ahead]
        opened, ahead = opened + len(some), ahead * 2
        for folder in some:
            if found < n:
                part = read([folder]).limit(n - found)
                found += part.count()
                parts.append(part)
    return (reduce(DataFrame.unionByName, parts) if parts else read(list(folders[:1])).limit(0)), opened


def modes(years: list[int], mode: str, this_year: int) -> list[int]:
    """Years of a daily or a full run, or those given."""
    return {"daily": [this_year, this_year - 1], "full": list(range(1963, this_year + 1))}.get(mode, sorted(set(years)))


def expand_years(spec: str) -> list[int]:
    """``1990-1993,2001`` as a sorted list without repeats; bad parts are errors."""
    out: set[int] = set()
    for piece in spec.replace(" ", ",").split(","):
        if not piece:
            continue
        first, _, last = piece.partition("-")
        if not first.isdecimal() or last and not last.isdecimal() or last and int(last) < int(first):
            raise ValueError(f"not a year or a range of years: {piece!r}")
        out.update(range(int(first), int(last or first) + 1))
    return sorted(out)
