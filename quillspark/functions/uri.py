"""URI and identifier functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.fixed import BASE_URI, PROVISIONS, SITE, TYPE_CODES

_URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"  # the standard UUID name space of URLs


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def whole(text: Column, least: str = "[+-]?[0-9]{1,9}") -> Column:
    """An integer if the trimmed text is one, else null."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(f"^{least}$"), trimmed.cast("int"))


def part(uri: Column | str, n: int) -> Column:
    """The n-th (from 0) segment between slashes, null beyond the end."""
    return F.get(F.split(_c(uri), "/", -1), F.lit(n))


def normalise_uri(uri: Column | str) -> Column:
    """One spelling for each act: http, with /id/, without a version at the end.

    Null and empty stay; a short form is only put after the base.
    """
    u = _c(uri)
    t = F.trim(u)
    http = F.when(t.startswith("https://"), F.concat(F.lit("http://"), F.substring(t, 9, 1 << 30))).otherwise(t)
    with_id = F.when(http.startswith(SITE) & ~http.contains("/id/"), F.concat(F.lit(BASE_URI), F.substring(http, len(SITE) + 1, 1 << 30))).otherwise(http)
    full = F.regexp_replace(with_id, r"/(?:enacted|made|created)(?:/.*)?$", "")
    short = F.concat(F.lit(BASE_URI), F.regexp_replace(t, r"^/+", ""))
    return F.when(u.isNull() | (u == ""), u).when(~t.startswith("http"), short).otherwise(full)


def needs_normalising(uri: Column | str) -> Column:
    return ~normalise_uri(uri).eqNullSafe(_c(uri))


def uuid5(name: Column | str, space: str = _URL_SPACE) -> Column:
    """Version 5 UUID of a name: a primary key that any run gives again."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(_c(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def section_number(uri: Column | str) -> Column:
    """The last segment as an integer, else null."""
    return whole(F.element_at(F.split(_c(uri), "/", -1), -1))


def legislation_type(uri: Column | str) -> Column:
    found = part(uri, 4)
    return F.when(found.isin(TYPE_CODES), found)


def legislation_number(uri: Column | str) -> Column:
    """Segment 6 if it is an integer, else the last one that is."""
    numbers = F.filter(F.split(_c(uri), "/", -1), lambda x: F.trim(x).rlike("^[0-9]{1,9}$"))
    return F.coalesce(whole(part(uri, 6)), F.try_element_at(numbers, F.lit(-1)).cast("int"))


def amendment_target(url: Column | str) -> Column:
    """What stands after /id/."""
    return F.try_element_at(F.split(_c(url), "/id/", -1), F.lit(2))


def parse_id(short: Column | str) -> Column:
    """``type/year/number`` as a struct, null if it is not of that form."""
    year, number = whole(part(short, 1)), whole(part(short, 2))
    good = (F.size(F.split(_c(short), "/", -1)) == 3) & year.isNotNull() & number.isNotNull()
    return F.when(good, F.struct(part(short, 0).alias("type"), year.alias("year"), number.alias("number")))


def pdf_id(url: Column | str) -> Column:
    """``type/year/number`` of a document's address."""
    found = F.regexp_extract(_c(url), r"legislation\.gov\.uk/([^/]+/[^/]+/[^/]+)", 1)
    return F.when(found != "", found)


def parent_section(uri: Column | str) -> Column:
    """A provision's URI cut after its number; null for what is no provision."""
    parts = F.split(_c(uri), "/", -1)
    return F.when((F.size(parts) >= 9) & F.get(parts, F.lit(7)).isin(PROVISIONS), F.array_join(F.slice(parts, 1, 9), "/"))


def case_court(url: Column | str) -> Column:
    """Court and division of a judgment's address."""
    pattern = r"^https://caselaw\.nationalarchives\.gov\.uk/([^/]+)(?:/([^/]+))?/\d{4}/\d+"
    court, division = (F.lower(F.regexp_extract(_c(url), pattern, k)) for k in (1, 2))
    return F.struct(F.when(court != "", court).alias("court"), F.when(division != "", division).alias("division"))


def log_year(url: Column | str) -> Column:
    """First four-digit segment, for the log's partition."""
    return whole(F.regexp_extract(_c(url), r"/(\d{4})/", 1))


def log_kind(url: Column | str) -> Column:
    """First segment of small letters."""
    found = F.regexp_extract(_c(url), r"/([a-z]+)/", 1)
    return F.when(found != "", found)


def data_url(link: Column | str) -> Column:
    """Address of an act's XML: without the contents page."""
    return F.concat(F.regexp_replace(F.regexp_replace(_c(link), r"/contents.*$", ""), r"/+$", ""), F.lit("/data.xml"))


def amendment_id(changed_url, changed_provision, affecting_url, affecting_provision, effect) -> Column:
    """Key of an amendment, from the addresses as they came."""

    def named(label: str, x) -> list[Column]:
        return [F.lit(label), F.coalesce(_c(x), F.lit("none"))]

    return F.concat_ws("-", F.lit("changed"), _c(changed_url), *named("prov", changed_provision), F.lit("affecting"), _c(affecting_url), *named("prov", affecting_provision), *named("type", effect))


def corrected(df, uri: str = "uri", year: str = "year", kind: str = "type", number: str = "number"):
    """Rows whose year, type or number differs from what the URI says, with the new values."""
    new_year = F.coalesce(whole(part(uri, 5)), F.col(year))
    new_kind, new_number = F.coalesce(legislation_type(uri), F.col(kind)), F.coalesce(legislation_number(uri), F.col(number))
    out = df.withColumns({"new_year": new_year, "new_type": new_kind, "new_number": new_number})
    changed = [~F.col(a).eqNullSafe(F.col(b)) for a, b in (("new_year", year), ("new_type", kind), ("new_number", number))]
    return out.where(changed[0] | changed[1] | changed[2])
