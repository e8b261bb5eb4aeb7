"""Calendar years of acts cited by the year of a reign.

``year_of`` is what callers use: well-formed identifiers are read by column
expressions, and only the rest goes through Arrow.  There a text becomes tokens
(words, numbers, marks), and three questions are asked of them in turn: is a year
stated as such, does a number stand beside a sovereign, is there any year at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.fixed import REIGNS, SPELLINGS
from quillspark.functions.uri import part, whole

REIGN = {name: (first, last) for name, first, last in REIGNS}
FIRST_YEAR, LAST_YEAR, MOST_SESSIONS = 1200, 2026, 70
#: Marks that may stand between the parts of a citation.
_LOOSE = frozenset("-_.,&")
#: Words after which a year is that of an act or an instrument.
_DATED = ("act", "rules", "no", "order")
#: What an act says before its short title, and how far on its year may stand.
_TITLED, _NEAR = ("may be cited as", "short title"), 100


class Token(NamedTuple):
    kind: str  # word, number, mark
    text: str


def tokens(text: str) -> list[Token]:
    """Words of letters, numbers and single marks; white space only separates."""
    kinds = (("number", str.isdigit), ("word", str.isalpha))
    return [Token(next((k for k, test in kinds if test(x)), "mark"), x) for x in re.findall(r"[0-9]+|[^\W\d_]+|\S", text)]


def _split(name: str) -> tuple[str, str]:
    letters = name.rstrip("0123456789")
    return letters, name[len(letters) :]


def sovereign(name: str) -> tuple[str, int, int] | None:
    """Canonical name, accession and last year; None where a name leaves it open.

    A name with its number is known by the letters that the canonical one begins
    with, so ``George5`` is ``Geo5``.
    """
    key = name.strip(" .").lower()
    if key in SPELLINGS:
        found = SPELLINGS[key]
        return (found, *REIGN[found]) if found else None
    letters, number = _split(key)
    for canonical, ends in REIGN.items():
        short, own = _split(canonical.lower())
        if key == canonical.lower() or number and number == own and letters.startswith(short):
            return canonical, *ends
    return None


def session_year(first: int, last: int, session: int) -> int | None:
    """Year in which a session began; a year after the reign's end is still taken."""
    year = first + session - 1
    return year if first <= year <= last + 1 else None


def stated(found: list[Token]) -> int | None:
    """A year in brackets, after S.I., or alone between slashes."""
    depth, words = 0, ["", ""]
    places: dict[str, int] = {}
    for k, (kind, text) in enumerate(found):
        depth += (text == "(") - (text == ")")
        if kind == "number" and len(text) == 4 and FIRST_YEAR <= int(text) <= LAST_YEAR:
            sides = [found[k - 1].text if k else "/", found[k + 1].text if k + 1 < len(found) else "/"]
            if depth > 0:
                places.setdefault("bracket", int(text))
            elif words in (["s", "i"], ["", "si"]):
                places.setdefault("instrument", int(text))
            elif sides == ["/", "/"]:
                places.setdefault("segment", int(text))
        if kind == "word":
            words = [words[1], text.lower()]
            if words[1] == "si":
                words[0] = ""
    return next((places[k] for k in ("bracket", "instrument", "segment") if k in places), None)


def _named(found: list[Token]) -> Iterator[tuple[int, int, int, int]]:
    """First and last token, accession and last year of every sovereign; a number that belongs to the name is part of it."""
    for k, (kind, text) in enumerate(found):
        if kind != "word":
            continue
        after = k + 1
        while after < len(found) and found[after].text in _LOOSE - {"&", ","}:
            after += 1
        with_number = sovereign(text + found[after].text) if after < len(found) and found[after].kind == "number" else None
        if with_number:
            yield k, after, *with_number[1:]
        elif alone := sovereign(text):
            yield k, k, *alone[1:]


def _before(found: list[Token], at: int) -> int | None:
    """The session that stands before a token; of two that follow one another (``52 & 53``) the first."""

    def number(k: int) -> int:
        while k >= 0 and found[k].text in _LOOSE:
            k -= 1
        return k if k >= 0 and found[k].kind == "number" else -1

    if (last := number(at - 1)) < 0:
        return None
    first = number(last - 1)
    own = int(found[last].text)
    return own - 1 if first >= 0 and int(found[first].text) == own - 1 else own


def cited(found: list[Token]) -> int | None:
    """The year of the first sovereign with a session before it, or among the three numbers after it."""
    for first, last, accession, end in _named(found):
        sessions = [n for n in [_before(found, first)] if n is not None]
        sessions += [int(t.text) for t in found[last + 1 :] if t.kind == "number"][:3]
        for session in sessions:
            if 1 <= session <= MOST_SESSIONS and (year := session_year(accession, end, session)):
                return year
    return None


def _years(found: list[Token], last: int) -> Iterator[tuple[int, int]]:
    return ((k, int(t.text)) for k, t in enumerate(found) if t.kind == "number" and len(t.text) == 4 and FIRST_YEAR <= int(t.text) <= last)


def loose(found: list[Token]) -> int | None:
    """Any year; of several the first that follows a word such as Act."""
    years = list(_years(found, 2029))
    words = [t.text.lower() for t in found]
    after = (year for k, year in years if next((w for w in reversed(words[max(0, k - 2) : k]) if w not in _LOOSE), "") in _DATED)
    return next(after, None) or next((year for _, year in years), None)


def short_title(text: str) -> int | None:
    """The year of a short title in the act's own text, in the sentence that gives the title."""
    low = text.lower()
    for phrase in _TITLED:
        at = low.find(phrase)
        while at >= 0:
            rest = text[at + len(phrase) : at + len(phrase) + _NEAR].lstrip(" .\t\n—-")
            if year := next((y for _, y in _years(tokens(rest.partition(".")[0]), 1999)), None):
                return year
            at = low.find(phrase, at + 1)
    return None


def _standard(identifier: str) -> int | None:
    """A well-formed URI, as ``fast_year`` reads it."""
    parts = [*identifier.split("/"), ""]
    if len(parts) < 7:
        return None
    year = parts[5].strip()
    if year.lstrip("+-").isdecimal():
        return int(year)
    first = None if {"_", "."} & set(year) else next((first for name, first, _ in REIGNS if year.startswith(name)), None)
    session = parts[6].partition("-")[0]
    return first + int(session) if first and session.isdecimal() else first


def parse_year(identifier: str | None, text: str | None = None) -> int | None:
    """Calendar year of an act from its identifier, or else from its text.

    A well-formed identifier counts sessions from the accession (so session 44
    of Vict is 1881), all other forms from the year before (1880): both counts
    are in use for the data.
    """
    if not identifier:
        return None
    year = _standard(identifier)
    if year is None:
        found = tokens(identifier)
        year = next((y for ask in (stated, cited, loose) if (y := ask(found)) is not None), None)
    return short_title(text) if year is None and text else year


def _slow(identifier: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([parse_year(i, t) for i, t in zip(identifier, text, strict=True)], dtype="Int32")


def fast_year(identifier: Column) -> Column:
    """Well-formed identifiers only, as an expression; null for the rest."""
    fifth, session = part(identifier, 5), F.regexp_extract(part(identifier, 6), r"^([0-9]{1,4})(?:-|$)", 1)
    clean = ~fifth.rlike("[_.]")
    first = F.coalesce(*(F.when(clean & fifth.startswith(name), a) for name, a, _ in REIGNS))
    return F.coalesce(whole(fifth), first + F.when(session != "", session.cast("int")).otherwise(0))


def year_of(identifier: Column | str, text: Column | str | None = None) -> Column:
    """Calendar year; Python sees only what the expression can't read."""
    i = F.col(identifier) if isinstance(identifier, str) else identifier
    t = F.lit(None).cast("string") if text is None else F.col(text) if isinstance(text, str) else text
    quick = fast_year(i)
    slow = F.pandas_udf(_slow, "int")(F.when(quick.isNull(), i), F.when(quick.isNull(), t))
    return F.coalesce(quick, slow)


def identity_of(short: Column | str) -> Column:
    """``type, year, number`` of ``type/…/number``; regnal years are read, and 0 stands for what isn't known."""
    s = F.col(short) if isinstance(short, str) else short
    parts = F.split(s, "/", -1)
    plain = whole(F.get(parts, F.lit(1))).isNotNull() & whole(F.get(parts, F.lit(2))).isNotNull()
    numbers = F.filter(F.slice(parts, 2, 1 << 20), lambda x: F.trim(x).rlike("^[0-9]{1,9}$"))
    year = F.when(plain, whole(F.get(parts, F.lit(1)))).otherwise(year_of(F.concat(F.lit("http://www.legislation.gov.uk/id/"), s)))
    number = F.when(plain, whole(F.get(parts, F.lit(2)))).otherwise(F.try_element_at(numbers, F.lit(-1)).cast("int"))
    found = F.struct(F.get(parts, F.lit(0)).alias("type"), F.coalesce(year, F.lit(0)).alias("year"), F.coalesce(number, F.lit(0)).alias("number"))
    return F.when(F.size(parts) >= 3, found)
