"""Queries over small tables of forms: inputs that the driver's tables don't hold, with the rows that must come out.

Each table has well-formed, damaged, empty and null inputs; the SQL states the
expected rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import shred
from quillspark.fixed import TYPES
from quillspark.functions import regnal
from quillspark.functions import text as T
from quillspark.functions import uri as U
from quillspark.operators import filters, ingest
from quillspark.plans.catalog import QUERIES, SQL
from quillspark.shred import clml, judgment, pages, pdf, references
from quillspark.sources import files, web

ID = "http://www.legislation.gov.uk/id/"
_KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "date": "DATE", "double": "DOUBLE"}


def _literal(value, kind: str) -> str:
    if value is None:
        return f"NULL::{_KINDS[kind]}"
    text = str(value).replace("'", "''")
    return f"'{text}'::{_KINDS[kind]}" if kind in ("string", "date") else f"{value}::{_KINDS[kind]}"


def form(given: str, rows: Sequence[tuple], out: str, expected: Sequence[tuple]) -> Callable:
    """Register ``f(rows as a DataFrame)`` whose columns ``out`` must hold the expected rows."""
    columns = [c.split() for c in out.split(", ")]
    shown = ", ".join("(" + ", ".join(_literal(v, k) for v, (_, k) in zip(row, columns, strict=True)) + ")" for row in expected)

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[f.__name__] = lambda spark, d: f(spark.createDataFrame(list(rows), given)).select(*(F.col(c).cast(k).alias(c) for c, k in columns))
        SQL[f.__name__] = f"SELECT * FROM (VALUES {shown}) AS t({', '.join(c for c, _ in columns)})"
        return f

    return add


def numbered(values: Sequence) -> list[tuple]:
    return [(n, *(v if isinstance(v, tuple) else (v,))) for n, v in enumerate(values)]


# --- years and identifiers ----------------------------------------------------

# Citations and the years that they stand for.
_YEARS = [
    (f"{ID}ukpga/2018/12", 2018), (f"{ID}ukla/Vict/44-45/12", 1881), (f"{ID}ukla/Edw7/3/198", 1904), (f"{ID}ukpga/Geo5/14-15/42", 1924), (f"{ID}ukpga/Geo3/41/90", 1801), (f"{ID}ukla/Vict", 1837),
    (f"{ID}ukpga/unknown/12", None), ("", None), (None, None), ("52 & 53 Vict. c. clviii (1889)", 1889), ("S.I. 1948 No. 845", 1948), ("S.R. & O. 1948 No. 845", 1948), ("52 & 53 Vict. c. clviii", 1888),
    ("14 Geo. 6. c. xliii", 1949), ("52-53Vict/cxcvii", 1888), (f"{ID}ukla/Vict_44_45/c12", 1880), ("Edw8and1Geo6/1/100", 1936), ("10-Edw-7-&-1-Geo-5-ch-1", 1910), ("5-edw-7-c-138", 1905), ("33 Vict.", 1869),
    ("[UNCLEAR: Liverpool_Sanitary_Amendment_Act_1854_Cap.xv]", 1854), ("local/Metropolitan_District_Railway_Act_1881_c.86", 1881), ("1949 No. 2170", 1949), ("Geo 5 chapter 7 of session 20", 1916),
]


@form("n long, i string", numbered([i for i, _ in _YEARS]), "n long, year int", numbered([y for _, y in _YEARS]))
def regnal_forms(x):
    return x.select("n", regnal.year_of("i").alias("year"))


_TITLES = [("This Act may be cited as the Elementary Education Act 1891", 1891), ("Short Title.—The Court of Session Act, 1868", 1868), ("Some text with no year", None), (None, None)]


@form("n long, i string, t string", numbered([("[UNCLEAR: none]", t) for t, _ in _TITLES]), "n long, year int", numbered([y for _, y in _TITLES]))
def years_of_short_titles(x):
    return x.select("n", regnal.year_of("i", "t").alias("year"))


@form(
    "n long, act string, id string, text string, year int",
    numbered([("g", f"{ID}ukla/Vict/44/1", "", None), ("g", "[UNCLEAR: x]", "", None), ("h", "[UNCLEAR: y]", "may be cited as the A Act 1891", None), ("i", "?", "", None), ("i", "?", "", 1700)]),
    "n long, year int", numbered([1881, 1881, 1891, 1700, 1700]),
)
def years_in_tiers(x):
    return ingest.recover_years(x, "id", "text", "act")


@form(
    "n long, u string",
    numbered(["ukpga/2023/52", "https://www.legislation.gov.uk/id/ukpga/2023/52", "http://www.legislation.gov.uk/ukpga/2023/52/enacted", " /ukpga/2023/52", f"{ID}ukpga/2023/52", "", None]),
    "n long, uri string, changed boolean, pdf string, target string",
    numbered([
        (f"{ID}ukpga/2023/52", True, None, None), (f"{ID}ukpga/2023/52", True, "id/ukpga/2023", "ukpga/2023/52"), (f"{ID}ukpga/2023/52", True, "ukpga/2023/52", None), (f"{ID}ukpga/2023/52", True, None, None),
        (f"{ID}ukpga/2023/52", False, "id/ukpga/2023", "ukpga/2023/52"), ("", False, None, None), (None, False, None, None),
    ]),
)
def uri_forms(x):
    return x.select("n", U.normalise_uri("u").alias("uri"), U.needs_normalising("u").alias("changed"), U.pdf_id("u").alias("pdf"), U.amendment_target("u").alias("target"))


@form(
    "n long, i string", numbered(["uksi/2025/123", "ukla/Vict/44-45/12", "ukla/Vict/44-45/x", "a/b", "asp/x/7", None]),
    "n long, type string, year int, number int, any_type string, any_year int, any_number int",
    numbered([("uksi", 2025, 123, "uksi", 2025, 123), (None, None, None, "ukla", 1881, 12), (None, None, None, "ukla", 1881, 0), (None,) * 6, (None, None, None, "asp", 0, 7), (None,) * 6]),
)
def short_ids(x):
    y = x.select("n", U.parse_id("i").alias("a"), regnal.identity_of("i").alias("b"))
    return y.select("n", "a.*", F.col("b.type").alias("any_type"), F.col("b.year").alias("any_year"), F.col("b.number").alias("any_number"))


@form(
    "uri string, year int, type string, number int", [(f"{ID}ukpga/2000/5", 1999, "ukpga", 5), (f"{ID}asp/2001/7", 2001, "asp", 7), (f"{ID}asp/2002/8", None, "x", None), (None, None, None, None)],
    "uri string, new_year int, new_type string, new_number int", [(f"{ID}ukpga/2000/5", 2000, "ukpga", 5), (f"{ID}asp/2002/8", 2002, "asp", 8)],
)
def corrected_metadata(x):
    return U.corrected(x)


# --- texts and labels -----------------------------------------------------------


@form("n long, c string", numbered([t[0] for t in TYPES] + ["xyz", None]), "n long, name string", numbered([t[1] for t in TYPES] + ["XYZ", None]))
def type_names(x):
    return x.select("n", T.type_name("c").alias("name"))


@form(
    "n long, t string", numbered(["\t\ta \n\n  b", "", None, "x\r\n\t\n\ty"]), "n long, lines string, markdown string",
    numbered([("\t\ta\nb", "## A\n### B\n\t\ta\nb"), ("", "## A\n### B\n"), (None, "## A\n### B"), ("x\n\ty", "## A\n### B\nx\n\ty")]),
)
def note_texts(x):
    y = x.select("n", T.note_lines("t").alias("lines"))
    return y.select("n", "lines", T.note_markdown(F.array(F.lit("A"), F.lit("B")), "lines").alias("markdown"))


@form(
    "n long, t string", numbered(['{"text": "inner"}', '{"other": 1}', "plain", None]), "n long, text string", numbered(["inner", '{"other": 1}', "plain", None]),
)
def nested_texts(x):
    return x.select("n", T.nested_text("t").alias("text"))


@form(
    "n long, t string", numbered(["Title\r\n- - - - - - - - - - - - - - - - - - -\n\n  Court ", "", None]), "n long, head string", numbered(["Title\nCourt", "", None]),
)
def case_heads(x):
    return x.select("n", T.case_header("t").alias("head"))


@form(
    "n long, t string", numbered(["(a) x\n1)\ny", "•\n\nitem\n\n\nnext", "iv.\ntext\n(2)\n(B) z)", "", None]), "n long, t string", numbered(["a. x\n1.\ny", "•item\nnext", "iv.text\n2.\n(B) z.", "", None]),
)
def paragraph_marks(x):
    return x.select("n", T.paragraph_marks("t").alias("t"))



@form(
    "n long, a string, s string", numbered([("A Act 1990", "5"), ("A Act 1990", None), (None, "5"), ("", ""), (None, None)]), "n long, label string",
    numbered(["A Act 1990, section 5", "A Act 1990", "section 5", "Unknown", "Unknown"]),
)
def reference_labels(x):
    return x.select("n", T.reference_label("a", "s").alias("label"))


@form("n long, j string", numbered(['{"a": 1} tail', ' {"b": [1, 2]}{"c": 3}', "no json", "", None]), "n long, j string", numbered(['{"a": 1}', '{"b": [1, 2]}', None, None, None]))
def first_objects(x):
    return x.select("n", T.first_object("j").alias("j"))


@form(
    "n long, a string, p string, ip string",
    numbered([("curl/8", "/legislation/search", "10.1.2.3"), ("Mozilla Chrome", "/caselaw/x", "a:b:c:d:e:f"), ("Googlebot", "/mcp", "x"), ("PostmanRuntime", "/", None), ("python-httpx", "/healthcheck", ""), (None, "/zzz", "1.2.3"), ("x", None, "unknown")]),
    "n long, agent string, endpoint string, ip string",
    numbered([("curl", "legislation", "10.1.2.xxx"), ("web_browser", "caselaw", "a:b:c:d::xxxx"), ("bot", "mcp", "unknown"), ("postman", "documentation", "unknown"), ("python_client", "health", "unknown"), ("unknown", "other", "unknown"), ("other", "other", "unknown")]),
)
def client_labels(x):
    return x.select("n", T.agent_kind("a").alias("agent"), T.endpoint_kind("p").alias("endpoint"), T.anonymous_ip("ip").alias("ip"))


@form(
    "n long, t string, y int, c string, e string, p int", numbered([("A Act", 1950, "7", "1950-01-02", 3), ("A Act", None, "", None, 0), (None, None, None, None, None)]), "n long, lines string",
    numbered(["Title: A Act\nYear: 1950\nChapter Number: 7\nEnactment Date: 1950-01-02\nPDF Pages: 3", "Title: A Act", ""]),
)
def prompt_contexts(x):
    return x.select("n", T.prompt_context("t", "y", "c", "e", "p").alias("lines"))


@form(
    "n long, changed_legislation string, changed_year int, changed_number string, changed_provision string, affecting_legislation string, affecting_year int, affecting_number string, affecting_provision string, effect string, told string",
    numbered([("ukpga/2002/1", 2002, "1", "section/5", "uksi/2017/1283", 2017, "1283", "article/2", "words substituted", "It changes."), ("xyz/1", 2003, "2", None, "", None, None, None, None, None), ("asp/1", 2004, "3", "", "asp/2", 2005, "4", "", "", "")]),
    "n long, text string",
    numbered([
        "Section 5 of UK Public General Act 2002 No. 1 was amended by Article 2 of UK Statutory Instrument 2017 No. 1283 Type of amendment: words substituted. Explanation: It changes.",
        "XYZ 2003 No. 2", "Act of the Scottish Parliament 2004 No. 3 was amended by Act of the Scottish Parliament 2005 No. 4",
    ]),
)
def amendment_sentences(x):
    return x.select("n", T.amendment_text(F.col, "effect", "told").alias("text"))


@form(
    "n long, name string, cite string, court string, year int, text string", numbered([("A v B", "[2020] UKSC 1", "uksc", 2020, "Held."), ("A v B", None, "ewca", 2019, ""), ("C", "", "eat", 2018, None)]), "n long, text string",
    numbered(["Case: A v B\nCitation: [2020] UKSC 1\nCourt: UKSC\nYear: 2020\nHeld.", "Case: A v B\nCourt: EWCA\nYear: 2019", "Case: C\nCourt: EAT\nYear: 2018"]),
)
def summary_embedding_texts(x):
    return x.select("n", T.summary_embedding_text("name", "cite", "court", "year", "text").alias("text"))


@form(
    "n long, name string, court string, year int, number int, cite string, day string, url string", numbered([("A v B", "uksc", 2020, 1, "[2020] 1 WLR 2", "2020-03-04", "u/1"), ("C v D", "eat", 2018, 9, None, "2018-01-01", "u/2")]),
    "n long, oscola string, bluebook string, markdown string, plain string",
    numbered([
        ("A v B [2020] UKSC 1, [2020] 1 WLR 2", "A v B, [2020] 1 WLR 2 (UK Sup. Ct. 2020)", "[A v B](u/1) [2020] UKSC 1, [2020] 1 WLR 2", "A v B [2020] UKSC 1 ([2020] 1 WLR 2)"),
        ("C v D [2018] EAT 9", "C v D, [2018] EAT 9 (EAT 2018)", "[C v D](u/2) [2018] EAT 9", "C v D [2018] EAT 9"),
    ]),
)
def case_citations(x):
    return x.select("n", *(T.case_citation(s, "name", "court", "year", "number", "cite", "day", "url").alias(s) for s in ("oscola", "bluebook", "markdown", "plain")))


# --- shredders --------------------------------------------------------------------

_ACT = """<Legislation xmlns="urn:x" xmlns:dc="urn:dc" xmlns:ukm="urn:ukm" IdURI="http://l/id/ukpga/2001/5" DocumentURI="http://l/ukpga/2001/5" RestrictExtent="E+W" {count}>
<ukm:Metadata><dc:title>A Test Act</dc:title><ukm:Year Value="2001"/><ukm:Number Value="5"/><ukm:DocumentMainType Value="UnitedKingdomPublicGeneralAct"/></ukm:Metadata>
{body}</Legislation>"""
_BODY = """<Primary><Body><Part RestrictExtent="S"><Title>One</Title><P1group><Title>Names</Title><P1 IdURI="http://l/id/ukpga/2001/5/section/1"><Pnumber>1</Pnumber><P1para><P2 IdURI="http://l/id/ukpga/2001/5/section/1/1"><Pnumber><CommentaryRef Ref="c1"/>1</Pnumber><P2para><Text>Words of one.</Text></P2para></P2></P1para></P1></P1group></Part></Body>
<Schedules><Schedule IdURI="http://l/id/ukpga/2001/5/schedule/1"><Title>Lists</Title><ScheduleBody><P1 IdURI="u"><Pnumber>1</Pnumber><P1para><Text>More.</Text></P1para></P1></ScheduleBody></Schedule>
<Schedule IdURI="http://l/id/ukpga/2001/5/schedule/2"><ScheduleBody/></Schedule></Schedules></Primary>
<Commentaries><Commentary id="c1" Type="F"><Para><Text>By <Citation URI="http://l/id/ukpga/1999/1" CitationRef="r1">act</Citation></Text></Para></Commentary><Commentary id="c2" Type="I"><Para><Text>None</Text></Para></Commentary></Commentaries>"""
_EU = '<EURetained/><EUBody><P1 IdURI="http://l/id/eur/2001/5/article/2"><Pnumber>Article 2</Pnumber><P1para><Text>Rules.</Text></P1para></P1></EUBody>'
_ACTS = numbered([_ACT.format(count='NumberOfProvisions="3"', body=_BODY), _ACT.format(count="", body=""), _ACT.format(count="", body=_EU), "<broken", "", None])


@form(
    "n long, x string", _ACTS, "n long, title string, year int, number int, provisions int, extent string, has_body boolean, european boolean",
    [(0, "A Test Act", 2001, 5, 3, "E+W", True, False), (1, "A Test Act", 2001, 5, None, "E+W", False, False), (2, "A Test Act", 2001, 5, None, "E+W", True, True)],
)
def act_headers(x):
    return shred.rows(x, clml.header, clml.HEADER, "x", "n")[0]


@form(
    "n long, x string", _ACTS, "n long, number string, provision_type string, title string, extent string, paragraphs int, first string",
    [(0, "1", "section", "Names", "S", 1, "1 Words of one."), (0, "1", "schedule", "Lists", "E+W", 1, "1 More."), (0, "2", "schedule", "", "E+W", 0, None), (2, "2", "section", "", "E+W", 0, None)],
)
def act_provisions(x):
    y = shred.rows(x, clml.provisions, clml.PROVISION, "x", "n")[0]
    number = F.regexp_replace("number", "^article-", "")
    return y.select("n", number.alias("number"), "provision_type", "title", "extent", F.size("paragraphs").alias("paragraphs"), F.get("paragraphs", F.lit(0))["text"].alias("first"))


@form("n long, x string", _ACTS, "n long, uri string", [(1, "http://l/ukpga/2001/5")])
def acts_without_body(x):
    """Acts that are a scan only: what the discovery of PDFs gives."""
    return shred.rows(x, clml.header, clml.HEADER, "x", "n")[0].where("not has_body")


@form("n long, x string", _ACTS, "n long, error string", [(3, "ParseError")])
def quarantined_acts(x):
    return shred.rows(x, clml.provisions, clml.PROVISION, "x", "n")[1].withColumn("error", F.substring_index("error", ":", 1))


@form(
    "n long, x string", _ACTS, "n long, ref string, type string, text string, citation_uri string, citation_ref string, citation_type string",
    [(0, "c1", "F", "By act", "http://l/id/ukpga/1999/1", "r1", "primary"), (0, "c2", "I", "None", None, None, None)],
)
def act_commentaries(x):
    return shred.rows(x, clml.commentaries, clml.COMMENTARY, "x", "n")[0]


@form("n long, x string", _ACTS, "uri string, ref string, text string", [("http://l/id/ukpga/2001/5/section/1", "c1", "By act")])
def commentaries_of_provisions(x):
    return clml.with_commentaries(shred.rows(x, clml.provisions, clml.PROVISION, "x", "n")[0], shred.rows(x, clml.commentaries, clml.COMMENTARY, "x", "n")[0])


_MARKED = [
    ("<P1group><Title>T</Title><P1><Pnumber>1</Pnumber><P1para><P2><Pnumber>1</Pnumber><P2para><Text>Go.</Text></P2para></P2></P1para></P1></P1group>", "Section 1) **T**\n\n1) Go. "),
    ("<Part><Number>PART 1</Number><Title>NAMES</Title><Pblock><Title>X</Title></Pblock></Part>", "## PART 1\n## NAMES\n\n*X*\n"),
    ("<P3><Pnumber>a</Pnumber><P3para><Text>“ x ”</Text></P3para></P3>", "\ta) “x” "),
    ("<UnorderedList><ListItem><Para><Text>one</Text></Para></ListItem></UnorderedList>", "\t- one"),
]


@form("n long, x string", numbered([x for x, _ in _MARKED]), "n long, text string", numbered([t for _, t in _MARKED]))
def provisions_as_markdown(x):
    return shred.rows(x, lambda t: [{"text": clml.markdown_of(t)}], "text string", "x", "n")[0]


@form("n long, x string", numbered([_ACTS[0][1], "<a><Text>ab</Text></a>"]), "n long, text string", numbered(["Words of one.\nMore.\nBy act\nNone", ""]))
def provision_texts(x):
    return shred.rows(x, lambda t: [{"text": clml.provision_text(t)}], "text string", "x", "n")[0]


_CASE = """<akomaNtoso xmlns:uk="urn:uk"><judgment><meta><identification><FRBRWork><FRBRdate date="2020-01-02" name="judgment"/><FRBRname value="A v B"/></FRBRWork>
<FRBRExpression><FRBRuri value="https://caselaw.nationalarchives.gov.uk/ewhc/ch/2020/9"/></FRBRExpression></identification><proprietary><uk:cite>[2020] EWHC 9 (Ch)</uk:cite></proprietary></meta>
<header><p>Title</p>
<p>- - - - - - - - - - - - - - - - - - -</p></header><judgmentBody><decision>{body}</decision></judgmentBody>
<ref uk:type="case" href="https://x.gov.uk/1"/><ref uk:type="legislation" href="https://elsewhere.com/1"/></judgment></akomaNtoso>"""
_BODIES = [
    '<level style="text-decoration:underline"><heading>A</heading><paragraph>one</paragraph></level><level><heading>B</heading><paragraph>two</paragraph></level>',
    "<level>x</level><paragraph>one two</paragraph><paragraph>two</paragraph><paragraph>three</paragraph>",
    '<level>Head</level><paragraph>one</paragraph><level><p class="Quote">said</p></level><paragraph>two</paragraph>',
    "<level>Head</level><paragraph>one</paragraph><level>Next</level><paragraph>two</paragraph>",
    "<level>L</level><paragraph>1.\nfirst</paragraph><level>" + "long " * 40 + "</level><paragraph>\n2.\nsecond</paragraph><level>z</level>",
]
_CASES = numbered([*(_CASE.format(body=b) for b in _BODIES), "<broken", None])


@form(
    "n long, x string", _CASES, "n long, name string, cite_as string, court string, division string, year int, number int, header string, cases string, acts string",
    [(n, "A v B", "[2020] EWHC 9 (Ch)", "ewhc", "ch", 2020, 9, "Title", "https://x.gov.uk/1", "") for n in range(5)],
)
def judgment_headers(x):
    y = shred.rows(x, judgment.header, judgment.HEADER, "x", "n")[0]
    return y.withColumns({"cases": F.array_join("caselaw_references", ","), "acts": F.array_join("legislation_references", ",")})


@form(
    "n long, x string", _CASES, "n long, layout string, route string, place int, text string",
    [
        (0, "nested_levels", "A", 1, "one"), (0, "nested_levels", "A/B", 2, "two"), (1, "flat_paragraphs", "", 1, "one two"), (1, "flat_paragraphs", "", 2, "three"), (2, "quote_levels", "Head", 1, "one"),
        (2, "quote_levels", "Head", 2, "said\ntwo"), (3, "levels_and_paragraphs", "Head", 1, "one"), (3, "levels_and_paragraphs", "Next", 2, "two"), (4, "default", "", 0, "0.\nL"), (4, "default", "", 1, "1.\nfirst" + "long " * 39 + "long"),
        (4, "default", "", 2, "2.\nsecondz"),
    ],
)
def judgment_sections(x):
    y = shred.rows(x, judgment.sections, judgment.SECTION, "x", "n")[0]
    return y.select("n", "layout", F.array_join("route", "/").alias("route"), F.col("order").alias("place"), "text")


def _cell(text: str, href: str | None = None) -> str:
    return f'<td><a href="{href}">{text}</a></td>' if href else f"<td>{text}</td>"


def _change(target: str, year: str = "2002&nbsp;c. 1") -> str:
    return "<tr>" + _cell("t") + _cell(year, target) + _cell("s. 1") + _cell("inserted") + _cell("t") + _cell("2024&nbsp;asc 1", "/id/asc/2024/1") + _cell("") + "</tr>"


@form(
    "n long, x string", numbered(["<table><tbody>" + _change("/id/ukpga/2002/1") + _change("/id/ukpga/0000/1") + _change("/id/uksi/2003/12", "2003&nbsp;No. 12") + "<tr><td>short</td></tr></tbody></table>", "<p>none</p>", "", None]),
    "n long, changed_legislation string, changed_year int, changed_number string, changed_provision string, affecting_number string, affecting_provision string, type_of_effect string",
    [(0, "ukpga/2002/1", 2002, "1", "s. 1", "1", None, "inserted"), (0, "uksi/2003/12", 2003, "12", "s. 1", "1", None, "inserted")],
)
def change_tables(x):
    return shred.rows(x, pages.changes, pages.CHANGE, "x", "n")[0]


@form(
    "n long, x string", numbered(["<body><p>Start</p><h2>Commentary</h2><h3>Section 1: names</h3><p>One</p><ul><li>a</li><li>b</li></ul><h2>Annex</h2><p>x</p></body>", "<body></body>", None]),
    "id string, note_type string, route string, section_type string, section_number int, place int, text string",
    [("act0_1", "overview", "Introduction", None, None, 0, "Start"), ("act0_2", "provisions", "Commentary/Section 1: names", "section", 1, 1, "One\n\ta\n\tb"), ("act0_3", None, "Annex", None, None, 2, "x")],
)
def note_records(x):
    y = shred.rows(x.withColumn("legislation_id", F.concat(F.lit("act"), F.col("n").cast("string"))), pages.notes, pages.NOTE, "x", "legislation_id")[0]
    return pages.note_records(y).withColumns({"route": F.array_join("route", "/"), "place": F.col("order")})


_CITING = [
    ("under section 5(2) of the Housing Act 1985", ["Housing Act 1985:5"]), ("sections 3 to 5 of the Energy Act 2013", [f"Energy Act 2013:{n}" for n in (3, 4, 5)]), ("the Energy Act 2013 and section 7 of that Act", ["Energy Act 2013:7"]),
    ("see sections 1, 2 and 4", [":1", ":2", ":4"]), ("as the Energy Act 2013 says", ["Energy Act 2013:"]), ("nothing here", []), (None, []), ("Amendment of the Finance (No. 2) Act 1992. Section 9 of Part 2 of the Rent Act 1977.", ["Rent Act 1977:9"]),
    ("this Act may be cited as the Tiny Act 1999", []), ("sections 1 to 3 and 8(1) of the Companies (Audit and Enterprise) Act 2004", [f"Companies (Audit and Enterprise) Act 2004:{n}" for n in (1, 2, 3, 8)]),
]


@form("n long, t string", numbered([t for t, _ in _CITING]), "n long, found string", [(n, f) for n, (_, fs) in enumerate(_CITING) for f in fs])
def reference_forms(x):
    y = shred.rows(x, references.find, references.REFERENCE, "t", "n")[0]
    return y.select("n", F.concat_ws(":", F.coalesce("act", F.lit("")), F.coalesce("section", F.lit(""))).alias("found"))


_SCAN = json.dumps({"metadata": {"title": "An Old Act", "date_enacted": "1922-03-04"}, "preamble": "Be it enacted", "sections": [{"number": "1", "heading": "Names", "text": "Words."}, {"number": "2"}], "schedules": [{"title": "Lists", "text": "More."}]})
_SCANS = [("uksi/1922/7", _SCAN), ("ukla/Vict/44-45/12", '{"sections": []}'), ("zzz/1950/3", "{}"), ("uksi/1/2", "no json"), ("uksi/1/3", None)]


@form(
    "legislation_id string, extracted_data string", _SCANS, "id string, title string, description string, enactment_date date, category string, type string, year int, number int, number_of_provisions int, text string",
    [
        (f"{ID}uksi/1922/7", "An Old Act", "Be it enacted", "1922-03-04", "secondary", "uksi", 1922, 7, 3, "Be it enacted\n\nNames\nWords.\n\n\n\n\nLists\nMore."),
        (f"{ID}ukla/Vict/44-45/12", "Unknown (ukla/Vict/44-45/12)", "", None, "primary", "ukla", 1881, 12, 0, ""), (f"{ID}zzz/1950/3", "Unknown (zzz/1950/3)", "", None, "primary", "ukpga", 1950, 3, 0, ""),
    ],
)
def scanned_acts(x):
    return pdf.acts(x.where("extracted_data is null or extracted_data like '{%'"))


@form(
    "legislation_id string, extracted_data string", _SCANS, "id string, title string, text string, provision_type string, number int",
    [(f"{ID}uksi/1922/7/section/1", "Names", "Words.", "section", 1), (f"{ID}uksi/1922/7/section/2", "Section 2", "", "section", 2), (f"{ID}uksi/1922/7/schedule/1", "Lists", "More.", "schedule", 1)],
)
def scanned_provisions(x):
    return pdf.provisions(x)


# --- listings, ingest ----------------------------------------------------------------


@form(
    "n long, html string", numbered(['<a href="/ukpga/2001/7/contents">x</a><a href="/ukpga/2001/8/contents/made">y</a><a href="/asp/1">z</a><a class="n" href="/next?page=2">Next page</a>', "", None]),
    "n long, link string, following string", [(0, "/ukpga/2001/7", "/next?page=2"), (0, "/ukpga/2001/8", "/next?page=2")],
)
def listed_acts(x):
    return web.listed_acts(x.withColumn("following", web.next_page("html")), "html", "ukpga")


@form(
    "n long, html string", numbered(['<a href="/out">o</a><div class="judgments-table"><table><tr><th><a href="/head">h</a></th></tr><tr><td><a href="/ewhc/ch/2020/9?query=x">A</a></td></tr><tr><td><a href="/uksc/2020/1">B</a></td></tr></table></div>', "<table></table>", None]),
    "n long, link string", [(0, "/ewhc/ch/2020/9"), (0, "/uksc/2020/1")],
)
def listed_cases(x):
    return web.listed_cases(x, "html")


@form(
    "n long, links string", numbered(["/a.pdf,/b_en.pdf", "/a.html,http://x/c.pdf", "/a.html", "", None]), "n long, link string",
    numbered(["https://www.legislation.gov.uk/b_en.pdf", "http://x/c.pdf", None, None, None]),
)
def pdf_links(x):
    return x.select("n", web.pdf_link(F.split("links", ",")).alias("link"))


@form(
    "xml string",
    [("<feed><id>f</id><leg:morePages>3</leg:morePages><entry><title>a</title><id> http://www.legislation.gov.uk/id/ukpga/Geo3/41/90 </id></entry><entry><id>http://www.legislation.gov.uk/id/nisr/1922/1</id></entry></feed>",), ("<feed><entry><id>http://www.legislation.gov.uk/id/aep/Edw1/3</id></entry></feed>",), ("<feed/>",), (None,)],
    "link string, type string, more int", [("http://www.legislation.gov.uk/ukpga/Geo3/41/90/data.xml", "ukpga", 3), ("http://www.legislation.gov.uk/aep/Edw1/3/data.xml", "aep", 0)],
)
def historical_feeds(x):
    return web.feed_entries(x, "xml", ["ukpga", "aep"])


@form(
    "types string, year int", [("ukpga", 1962), ("ukpga", 1963), ("asp", 2001)], "place int, type string, year int, modern boolean",
    [(0, "asp", 1963, True), (1, "ukpga", 1963, True), (2, "asp", 2001, True), (3, "ukpga", 2001, True), (4, "asp", 1962, False), (5, "ukpga", 1962, False)],
)
def listing_tasks(x):
    rows = x.collect()  # the forms above: arguments of a listing
    tasks = files.split_by_year(sorted({r.types for r in rows}), [1962, 1963, 2001])
    return x.sparkSession.createDataFrame([(n, *task) for n, task in enumerate(tasks)], "place int, type string, year int, modern boolean")


@form("f string, year int, number int", [("b", 2001, 7), ("a", None, None), ("c", 2002, 1), ("d", 2002, 9)], "place int, f string", [(0, "a"), (1, "d"), (2, "c"), (3, "b")])
def file_order(x):
    from pyspark.sql import Window

    return x.select(F.row_number().over(Window.orderBy(*files.file_order(), "f")).alias("n"), "f").select((F.col("n") - 1).alias("place"), "f")


@form("n long, error string, terminal boolean", numbered([(None, None), ("bad", True), ("slow", False), ("x", None)]), "n long, status string, terminal boolean", numbered([("success", False), ("failure", True), ("failure", False), ("failure", False)]))
def outcomes(x):
    return x.select("n", ingest.outcome(F.col("error"), F.col("terminal")).alias("o")).select("n", "o.*")


@form(
    "n long, legislation_id string, note_type string, section_type string", numbered([("a", "overview", "section"), ("a", "extent", None), ("b", "overview", "part"), (None, "overview", "section")]), "n long", [(0,), (2,)],
)
def note_filters(x):
    one = x.where(filters.notes("a", ["overview"], ["section", "part"]))
    return one.union(x.where(filters.notes("b", None, ["part"]))).select("n")
