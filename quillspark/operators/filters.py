"""Request filters as columns: each builder returns one ``Column`` for ``where``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.fixed import CATEGORIES, TYPES

FIRST_YEAR, LAST_YEAR = 1267, 2030


def must(conditions: Iterable[Column]) -> Column:
    """All of them; none is no filter."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def year_range(column: str, first: int | None = None, last: int | None = None) -> list[Column]:
    """Inclusive ends, each optional; a null year never matches an end."""
    return [F.col(column) >= first] * (first is not None) + [F.col(column) <= last] * (last is not None)


def any_of(column: str, values: Sequence | None) -> list[Column]:
    return [F.col(column).isin(list(values))] if values else []


def overlaps(column: str, values: Sequence) -> Column:
    """Whether an array column holds any of the values."""
    return F.arrays_overlap(F.col(column), F.array(*(F.lit(v) for v in values)))


def present(column: str, array: bool = False) -> Column:
    """Neither null nor, for arrays, empty."""
    return F.col(column).isNotNull() & (F.size(column) > 0) if array else F.col(column).isNotNull()


def category_types(category: str) -> list[str]:
    if category not in CATEGORIES:
        raise ValueError(f"no types are known of category {category!r}")
    return CATEGORIES[category]


def provisions(act: str | None = None, types: Sequence[str] | None = None, category: str | None = None, first: int | None = None, last: int | None = None, *, act_column: str = "legislation_id", type_column: str = "legislation_type", year_column: str = "legislation_year") -> Column:
    """Provisions of one act, which leaves out every other filter, or by type (before category) and year."""
    if act:
        return F.col(act_column) == act
    types = types or (category_types(category) if category else None)
    return must([*any_of(type_column, types), *year_range(year_column, first, last)])


def acts(types: Sequence[str] | None = None, category: str | None = None, first: int | None = None, last: int | None = None, *, type_column: str = "type", year_column: str = "year") -> Column:
    return provisions(None, types, category, first, last, type_column=type_column, year_column=year_column)


def cases(courts: Sequence[str] | None = None, divisions: Sequence[str] | None = None, first: int | None = None, last: int | None = None, *, court_column: str = "court", division_column: str = "division", year_column: str = "year") -> Column:
    return must([*any_of(court_column, courts), *any_of(division_column, divisions), *year_range(year_column, first, last)])


def notes(act: str | None = None, note_types: Sequence[str] | None = None, section_types: Sequence[str] | None = None) -> Column:
    return must([*([F.col("legislation_id") == act] if act else []), *any_of("note_type", note_types), *any_of("section_type", section_types)])


def bulk(types: Sequence[str] | None = None, first: int | None = None, last: int | None = None, *, type_column: str = "legislation_type", year_column: str = "legislation_year") -> Column:
    """As for provisions; several types mean any of them, and a year of 0 is no filter."""
    return must([*any_of(type_column, types), *year_range(year_column, first or None, last or None)])


def active_types(year: Column) -> Column:
    """Codes of the types that existed in a year, in the table's order."""
    known = F.array(*(F.struct(F.lit(code).alias("code"), F.lit(first).alias("first"), F.lit(last).alias("last")) for code, _, first, last in TYPES))
    return F.transform(F.filter(known, lambda t: year.between(t["first"], t["last"])), lambda t: t["code"])


def valid_lookup(year: Column, number: Column) -> Column:
    return year.between(FIRST_YEAR, LAST_YEAR) & (number > 0)


def enough_text(column: str, least: int = 100) -> Column:
    return F.length(F.trim(F.col(column))) >= least


def no_placeholder(*columns: str) -> Column:
    """None of the identifiers is a placeholder for a missing act."""
    return must(~F.coalesce(F.col(c).contains("/0000"), F.lit(False)) for c in columns)


def explainable(explanation: str = "ai_explanation", effect: str = "type_of_effect") -> Column:
    """Not explained yet, and no mere commencement."""
    return F.col(explanation).isNull() & ~F.coalesce(F.lower(effect).contains("coming into force"), F.lit(False))


def summary_text(column: str = "text", least: int = 500, most: int = 900_000) -> tuple[Column, Column, Column]:
    """Filter, text and the mark of a cut one."""
    return F.length(column) >= least, F.substring(column, 1, most), F.length(column) > most


def mentions(query: str, *columns: str) -> Column:
    """Whether any of the columns holds the query in any case; a query of under three letters is no filter."""
    if len(query) < 3:
        return F.lit(True)
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(query.lower()), F.lit(False)) for c in columns))
