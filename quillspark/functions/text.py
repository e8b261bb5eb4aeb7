"""Text, date and label functions, as columns."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.fixed import AGENTS, COURT_NAMES, EXTENTS, NOTE_TYPES, TYPES


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _map(pairs) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def tidy(text) -> Column:
    """One space for white space; the three basic character references decoded."""
    flat = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.replace(F.replace(F.replace(flat, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def iso_date(text) -> Column:
    t = F.substring(F.trim(_c(text)), 1, 10)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def extents(code) -> Column:
    """Names of an extent code; an unknown one gives a list with the empty name."""
    known, c = _map(EXTENTS.items()), _c(code)
    each = F.transform(F.split(c, r"\+"), lambda x: F.try_element_at(known, x))
    whole = F.try_element_at(known, c)
    return F.when(whole.isNotNull(), F.array(whole)).when(F.forall(each, lambda x: x.isNotNull()), each).otherwise(F.array(F.lit("")))


def extent_text(code) -> Column:
    return F.array_join(extents(code), ", ")


def year_number(cell) -> Column:
    """Year and number of a table cell: ``2002 c. 1``, ``2017 No. 1283``, ``2024 asc 1``, with a no-break space between."""
    parts = F.split(_c(cell), " ", -1)
    head, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    number = F.when(tail.startswith("c. "), F.substring(tail, 4, 1 << 20)).when(tail.startswith("No. "), F.substring(tail, 5, 1 << 20)).when(tail.contains(" "), F.element_at(F.split(F.trim(tail), " +"), -1)).otherwise(tail)
    good = head.rlike(r"^\s*\d{1,9}\s*$") & tail.isNotNull()
    return F.struct(F.when(good, F.trim(head).cast("int")).alias("year"), F.when(good, number).alias("number"))


def type_name(code) -> Column:
    return F.coalesce(F.try_element_at(_map((t[0], t[1]) for t in TYPES), _c(code)), F.upper(_c(code)))


def embedding_text(*columns, between: str = "\n\n") -> Column:
    """What is embedded: title, description and text, without what is missing."""
    return F.concat_ws(between, *map(_c, columns))


def _act_named(legislation, year, number) -> Column:
    """``UK Public General Act 2002 No. 1`` of ``ukpga/2002/1``, its year and its number."""
    return F.concat(type_name(F.substring_index(_c(legislation), "/", 1)), F.lit(" "), _c(year).cast("string"), F.lit(" No. "), _c(number))


def _provision_named(provision, act: Column) -> Column:
    p = F.initcap(F.replace(_c(provision), F.lit("/"), F.lit(" ")))
    return F.when(F.coalesce(_c(provision), F.lit("")) == "", act).otherwise(F.concat(p, F.lit(" of "), act))


def amendment_text(side: Callable[[str], Column], effect, explanation) -> Column:
    """A sentence for an amendment; ``side("changed_legislation")`` and so on give its columns."""
    changed, affecting = (_provision_named(side(f"{x}_provision"), _act_named(*(side(f"{x}_{c}") for c in ("legislation", "year", "number")))) for x in ("changed", "affecting"))
    by = F.when(F.coalesce(side("affecting_legislation"), F.lit("")) != "", F.concat(F.lit("was amended by "), affecting))
    kind = F.when(F.coalesce(_c(effect), F.lit("")) != "", F.concat(F.lit("Type of amendment: "), _c(effect), F.lit(".")))
    told = F.when(F.coalesce(_c(explanation), F.lit("")) != "", F.concat(F.lit("Explanation: "), _c(explanation)))
    return F.concat_ws(" ", changed, by, kind, told)


def summary_embedding_text(name, cite, court, year, text) -> Column:
    """Lines of a judgment's summary, without what is missing."""
    cited = F.when(F.coalesce(_c(cite), F.lit("")) != "", F.concat(F.lit("Citation: "), _c(cite)))
    body = F.when(_c(text) != "", _c(text))
    return F.concat_ws("\n", F.concat(F.lit("Case: "), _c(name)), cited, F.concat(F.lit("Court: "), F.upper(_c(court))), F.concat(F.lit("Year: "), _c(year).cast("string")), body)


def prompt_context(title, year, number, enacted, pages) -> Column:
    """Lines of what is known of an act, without what is missing."""
    known = (("Title", title), ("Year", year), ("Chapter Number", number), ("Enactment Date", enacted))
    lines = [F.when(F.coalesce(_c(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{label}: "), _c(c).cast("string"))) for label, c in known]
    return F.concat_ws("\n", *lines, F.when(_c(pages) > 0, F.concat(F.lit("PDF Pages: "), _c(pages).cast("string"))))


def note_section(title) -> Column:
    """Kind and number of a provision that a heading begins with."""
    kind, number = (F.regexp_extract(_c(title), r"(?i)^(section|schedule|part) (\d+)(?!\d)", k) for k in (1, 2))
    return F.struct(F.when(kind != "", F.lower(kind)).alias("kind"), F.when(number != "", number.cast("int")).alias("number"))


def note_type(route) -> Column:
    """Type of the innermost heading that names one, by the first name in order of precedence."""
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in NOTE_TYPES))
    found = F.transform(F.reverse(_c(route)), lambda h: F.get(F.filter(known, lambda n: h.contains(n["k"])), F.lit(0))["v"])
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))


def note_lines(text) -> Column:
    """Lines without blank ones; tabs at the start of a line stay."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x: F.concat(F.regexp_extract(x, r"^(\t*)", 1), F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))))
    return F.array_join(F.filter(lines, lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""), "\n")


def note_markdown(route, text) -> Column:
    heads = F.transform(_c(route), lambda h, i: F.concat(F.repeat(F.lit("#"), i + 2), F.lit(" "), h))
    return F.concat_ws("\n", F.array_join(heads, "\n"), _c(text))


def case_header(text) -> Column:
    """Lines of a judgment's head without rules and blanks."""
    lines = F.filter(F.split(_c(text), r"\r?\n"), lambda x: ~x.contains("- - - - - - - - - - - - - - - - -"))
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


#: Letters and digits that a bracket makes a mark of.
_SMALL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def _line(line: str) -> str:
    """A line whose bracketed marks, ``(a)`` or ``a)``, are ``a.``; other brackets stay."""
    first, *others = line.split("(")
    opened = first + "".join(x if x[:1] in _SMALL else f"({x}" for x in others)
    *before, last = opened.split(")")
    return "".join(f"{x}." if x[-1:] in _SMALL else f"{x})" for x in before) + last


def _leads_on(line: str) -> bool:
    """Whether a line is, or ends with, a mark that the next line belongs to: a bullet or a letter's mark; a number stands alone."""
    return line[-1:] == "•" or line[-1:] == "." and line[-2:-1].isascii() and line[-2:-1].isalpha()


def marked(text: str) -> str:
    """A text with the marks of its paragraphs in one form, read line by line.

    Blank lines go, what follows a bullet or a letter's mark comes up to it, and
    a line end at the start or the end of the text stays.
    """
    lines = text.split("\n")
    out = ["\n"] if len(lines) > 1 and not lines[0] else []
    held = [_line(x) for x in lines if x]
    for n, line in enumerate(held):
        ends = n < len(held) - 1 or not lines[-1]
        out.append(f"{line}\n" if ends and not _leads_on(line) else line)
    return "".join(out)


def paragraph_marks(text) -> Column:
    """``marked`` as a column, by the same lines."""
    small = lambda x: (x != "") & F.contains(F.lit("".join(sorted(_SMALL))), x)
    whole = lambda parts, f: F.array_join(F.transform(parts, f), "")

    def line(x: Column) -> Column:
        opened = whole(F.split(x, r"\(", -1), lambda p, n: F.when((n == 0) | small(F.left(p, F.lit(1))), p).otherwise(F.concat(F.lit("("), p)))
        parts = F.split(opened, r"\)", -1)
        return whole(parts, lambda p, n: F.when(n == F.size(parts) - 1, p).when(small(F.right(p, F.lit(1))), F.concat(p, F.lit("."))).otherwise(F.concat(p, F.lit(")"))))

    leads_on = lambda x: F.endswith(x, F.lit("•")) | F.regexp_like(x, F.lit(r"[A-Za-z]\.$(?!\n)"))
    lines = F.split(_c(text), "\n", -1)
    held = F.transform(F.filter(lines, lambda x: x != ""), line)
    open_end = F.element_at(lines, -1) != ""
    ended = whole(held, lambda x, n: F.when(leads_on(x) | (open_end & (n == F.size(held) - 1)), x).otherwise(F.concat(x, F.lit("\n"))))
    return F.concat(F.when((F.size(lines) > 1) & (F.get(lines, F.lit(0)) == ""), "\n").otherwise(""), ended)


def nested_text(value) -> Column:
    """``{"text": …}`` as its text, anything else as it is."""
    return F.coalesce(F.get_json_object(_c(value), "$.text"), _c(value))


def reference_label(act, section) -> Column:
    a, s = (F.when(_c(x) != "", _c(x)) for x in (act, section))
    return F.coalesce(F.concat(a, F.lit(", section "), s), a, F.concat(F.lit("section "), s), F.lit("Unknown"))


def citation(style: str, title, kind, year, number, url) -> Column:
    """An act's citation in one of four styles."""
    t, u = _c(title), _c(url)
    cited = F.concat(F.upper(_c(kind)), F.lit(" "), _c(year).cast("string"), F.lit("/"), _c(number).cast("string"))
    forms = {
        "oscola": lambda: F.concat(t, F.lit(", "), cited), "bluebook": lambda: F.concat(t, F.lit(", "), cited, F.lit(" (UK)")),
        "markdown": lambda: F.concat(F.lit("["), t, F.lit("]("), u, F.lit(") ("), cited, F.lit(")")), "plain": lambda: F.concat(t, F.lit(" ("), cited, F.lit(")")),
    }
    if style not in forms:
        raise ValueError(f"no such style: {style!r}")
    return forms[style]()


def case_citation(style: str, name, court, year, number, cite_as, date, url) -> Column:
    """A judgment's citation in one of four styles; ``cite_as`` is another citation, where there is one."""
    n, u = _c(name), _c(url)
    other = F.when(_c(cite_as) != "", _c(cite_as))
    neutral = F.concat(F.lit("["), _c(year).cast("string"), F.lit("] "), F.upper(_c(court)), F.lit(" "), _c(number).cast("string"))
    with_other = F.concat_ws(", ", neutral, other)
    if style == "oscola":
        return F.concat(n, F.lit(" "), with_other)
    if style == "bluebook":
        full = F.coalesce(F.try_element_at(_map(COURT_NAMES.items()), F.lower(_c(court))), F.upper(_c(court)))
        return F.concat(n, F.lit(", "), F.coalesce(other, neutral), F.lit(" ("), full, F.lit(" "), F.year(_c(date)).cast("string"), F.lit(")"))
    if style == "markdown":
        return F.concat(F.lit("["), n, F.lit("]("), u, F.lit(") "), with_other)
    if style == "plain":
        return F.concat(n, F.lit(" "), neutral, F.coalesce(F.concat(F.lit(" ("), other, F.lit(")")), F.lit("")))
    raise ValueError(f"no such style: {style!r}")


def relative_time(then, now) -> Column:
    """How long ago, in words; after 30 days the date, with its year after 365."""
    minutes = F.timestamp_diff("MINUTE", _c(then), _c(now))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    ago = F.when(minutes < 1, "Just now")
    for bound, value, unit in ((minutes < 60, minutes, "m"), (hours < 24, hours, "h"), (days < 7, days, "d"), (days < 30, F.floor(days / 7), "w")):
        ago = ago.when(bound, F.concat(value.cast("string"), F.lit(f"{unit} ago")))
    return ago.otherwise(F.when(days > 365, F.date_format(_c(then), "d MMM yyyy")).otherwise(F.date_format(_c(then), "d MMM")))


def anonymous_ip(ip) -> Column:
    """The first three of four groups, or the first four of a longer address; anything else is unknown."""
    four, many = F.split(_c(ip), r"\."), F.split(_c(ip), ":")
    short = F.when(F.size(four) == 4, F.concat(F.array_join(F.slice(four, 1, 3), "."), F.lit(".xxx")))
    long = F.when(F.size(many) >= 4, F.concat(F.array_join(F.slice(many, 1, 4), ":"), F.lit("::xxxx")))
    return F.coalesce(short, long, F.lit("unknown"))


def client_ip(forwarded, peer) -> Column:
    """The rightmost forwarded address, which the own proxy has set; else the peer."""
    last = F.trim(F.element_at(F.split(_c(forwarded), ","), -1))
    return F.when(last.isNotNull() & (last != ""), last).otherwise(_c(peer))


def agent_kind(agent) -> Column:
    """Kind of a client, by the first words that its name holds."""
    a = F.lower(_c(agent))
    out = F.when(a.isNull() | a.isin("", "unknown"), "unknown")
    for kind, words in AGENTS:
        out = out.when(a.rlike("|".join(words)), kind)
    return out.otherwise("other")


def endpoint_kind(path) -> Column:
    p = _c(path)
    groups = F.when(p.startswith("/legislation"), "legislation").when(p.startswith("/caselaw"), "caselaw").when(p.startswith("/mcp"), "mcp")
    return groups.when(p.isin("/", "/api/docs", "/api/redoc"), "documentation").when(p == "/healthcheck", "health").otherwise("other")


def usage_tier(calls, limit) -> Column:
    """How much of a limit is used."""
    share = _c(calls) * 100 / _c(limit)
    return F.when(share >= 100, "exceeded").when(share >= 90, "high").when(share >= 70, "medium").when(share >= 50, "moderate").otherwise("low")


def safe_name(query, most: int = 50) -> Column:
    return F.substring(F.regexp_replace(_c(query), r"[^A-Za-z0-9_-]", "_"), 1, most)


def cache_key(name: str, *arguments: str) -> Column:
    """SHA-256 of a name and its arguments in order of their names."""
    parts = [F.concat(F.lit(f'"{a}": '), F.to_json(F.struct(F.col(a))).substr(F.lit(len(a) + 5), F.length(F.to_json(F.struct(F.col(a)))) - len(a) - 5)) for a in sorted(arguments)]
    return F.sha2(F.concat(F.lit(f"api_cache:{name}:{{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


_FIRST_OBJECT = re.compile(r"\s*")


def first_object(text) -> Column:
    """The first complete JSON object of a text with more after it."""
    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        def one(value):
            try:
                return json.dumps(json.JSONDecoder().raw_decode(value, _FIRST_OBJECT.match(value).end())[0])
            except (TypeError, ValueError):
                return None

        return values.map(one)

    return read(_c(text))
