import gc
import weakref

import pytest
from pyspark.sql import functions as F

from quillspark import shred
from quillspark.shred import clml, judgment, pages, references
from quillspark.shred.tree import parse

ACT = """<Legislation xmlns="urn:x" xmlns:dc="urn:dc" xmlns:ukm="urn:ukm" IdURI="http://l/id/ukpga/2001/5" DocumentURI="http://l/ukpga/2001/5" RestrictExtent="E+W" {count}>
<ukm:Metadata><dc:title>A Test Act</dc:title><ukm:Year Value="2001"/><ukm:Number Value="5"/><ukm:DocumentMainType Value="UnitedKingdomPublicGeneralAct"/></ukm:Metadata>
{body}</Legislation>"""
BODY = """<Primary><Body><Part RestrictExtent="S"><Title>One</Title><P1group><Title>Names</Title><P1 IdURI="http://l/id/ukpga/2001/5/section/1"><Pnumber>1</Pnumber><P1para><P2 IdURI="http://l/id/ukpga/2001/5/section/1/1"><Pnumber>1</Pnumber><P2para><Text>Words of one.</Text></P2para></P2></P1para></P1></P1group></Part></Body>
<Schedules><Schedule IdURI="http://l/id/ukpga/2001/5/schedule/1"><Title>Lists</Title><ScheduleBody><P1 IdURI="u"><Pnumber>1</Pnumber><P1para><Text>More.</Text></P1para></P1></ScheduleBody></Schedule>
<Schedule IdURI="http://l/id/ukpga/2001/5/schedule/2"><ScheduleBody/></Schedule></Schedules></Primary>
<Commentaries><Commentary id="c1" Type="F"><Para><Text>By <Citation URI="http://l/id/ukpga/1999/1" CitationRef="r1">act</Citation></Text></Para></Commentary></Commentaries>"""


def act(body=BODY, count='NumberOfProvisions="3"'):
    return ACT.format(body=body, count=count)


def test_act_header():
    row = clml.header(act())[0]
    assert (row["id"], row["title"], row["year"], row["number"], row["provisions"], row["has_body"]) == ("http://l/id/ukpga/2001/5", "A Test Act", 2001, 5, 3, True)
    assert clml.header(act(count=""))[0]["provisions"] is None
    assert not clml.header(act(body=""))[0]["has_body"]


def test_provisions_and_extent():
    one, two, three = clml.provisions(act())
    assert (one["number"], one["extent"], one["title"], one["provision_type"]) == ("1", "S", "Names", "section")
    assert "Words of one." in one["text"]
    assert one["paragraphs"][0]["text"] == "1 Words of one."
    assert (two["provision_type"], two["title"], two["extent"]) == ("schedule", "Lists", "E+W")
    assert (three["title"], three["text"]) == ("", "")
    assert clml.provisions(act(body="")) == []


def test_commentaries():
    assert clml.commentaries(act())[0] == {"legislation_id": "http://l/id/ukpga/2001/5", "ref": "c1", "type": "F", "text": "By act", "citation_id": "http://l/id/ukpga/1999/1", "citation_uri": "http://l/id/ukpga/1999/1", "citation_ref": "r1", "citation_type": "primary"}


@pytest.mark.parametrize(
    ("xml", "text"),
    [
        ("<P1group><Title>T</Title><P1><Pnumber>1</Pnumber><P1para><P2><Pnumber>1</Pnumber><P2para><Text>Go.</Text></P2para></P2></P1para></P1></P1group>", "Section 1) **T**\n\n1) Go. "),
        ("<Part><Number>PART 1</Number><Title>NAMES</Title><Pblock><Title>X</Title></Pblock></Part>", "## PART 1\n## NAMES\n\n*X*\n"),
        ("<P3><Pnumber>a</Pnumber><P3para><Text>“ x ”</Text></P3para></P3>", "\ta) “x” "),
        ("<UnorderedList><ListItem><Para><Text>one</Text></Para></ListItem></UnorderedList>", "\t- one"),
    ],
)
def test_markdown(xml, text):
    assert clml.markdown_of(xml) == text


CASE = """<akomaNtoso xmlns:uk="urn:uk"><judgment><meta><identification><FRBRWork><FRBRdate date="2020-01-02" name="judgment"/><FRBRname value="A v B"/></FRBRWork>
<FRBRExpression><FRBRuri value="https://caselaw.nationalarchives.gov.uk/ewhc/ch/2020/9"/></FRBRExpression></identification><proprietary><uk:cite>[2020] EWHC 9 (Ch)</uk:cite></proprietary></meta>
<header><p>Title</p>
<p>- - - - - - - - - - - - - - - - - - -</p></header><judgmentBody><decision>{body}</decision></judgmentBody>
<ref uk:type="case" href="https://x.gov.uk/1"/><ref uk:type="legislation" href="https://elsewhere.com/1"/></judgment></akomaNtoso>"""
LAYOUTS = {
    "nested_levels": ('<level style="text-decoration:underline"><heading>A</heading><paragraph>one</paragraph></level><level><heading>B</heading><paragraph>two</paragraph></level>', [(["A"], "one"), (["A", "B"], "two")]),
    "flat_paragraphs": ("<level>x</level><paragraph>one two</paragraph><paragraph>two</paragraph><paragraph>three</paragraph>", [([], "one two"), ([], "three")]),
    "quote_levels": ('<level>Head</level><paragraph>one</paragraph><level><p class="Quote">said</p></level><paragraph>two</paragraph>', [(["Head"], "one"), (["Head"], "said\ntwo")]),
    "levels_and_paragraphs": ("<level>Head</level><paragraph>one</paragraph><level>Next</level><paragraph>two</paragraph>", [(["Head"], "one"), (["Next"], "two")]),
    "default": ("<level>L</level><paragraph>1.\nfirst</paragraph><level>" + "long " * 40 + "</level><paragraph>\n2.\nsecond</paragraph><level>z</level>", None),
}


@pytest.mark.parametrize("kind", LAYOUTS)
def test_layouts(kind):
    body, wanted = LAYOUTS[kind]
    rows = judgment.sections(CASE.format(body=body))
    assert {r["layout"] for r in rows} == {kind}
    if wanted:
        assert [(r["route"], r["text"]) for r in rows] == wanted
    assert [r["id"][-2:] for r in rows] == [f"-{n + 1}" for n in range(len(rows))]
    assert rows[0]["order"] == (0 if kind == "default" else 1)


def test_judgment_header():
    row = judgment.header(CASE.format(body="<paragraph>x</paragraph>"))[0]
    assert (row["court"], row["division"], row["year"], row["number"], row["header"]) == ("ewhc", "ch", 2020, 9, "Title")
    assert (row["caselaw_references"], row["legislation_references"]) == (["https://x.gov.uk/1"], [])


def test_numbered_text():
    assert judgment.numbered("Start\n1.\none\n3.\nnot yet\n2.\ntwo") == ["0.\nStart", "1.\none\n3.\nnot yet", "2.\ntwo"]


def test_changes():
    def cell(text, href=None):
        return f'<td><a href="{href}">{text}</a></td>' if href else f"<td>{text}</td>"

    def row(target, year="2002&nbsp;c. 1"):
        return "<tr>" + cell("t") + cell(year, target) + cell("s. 1") + cell("inserted") + cell("t") + cell("2024&nbsp;asc 1", "/id/asc/2024/1") + cell("") + "</tr>"

    rows = pages.changes("<table><tbody>" + row("/id/ukpga/2002/1") + row("/id/ukpga/0000/1") + "</tbody></table>")
    assert len(rows) == 1
    assert (rows[0]["changed_year"], rows[0]["changed_number"], rows[0]["affecting_number"], rows[0]["changed_legislation"]) == (2002, "1", "1", "ukpga/2002/1")
    assert rows[0]["id"] == "changed-https://www.legislation.gov.uk/id/ukpga/2002/1-prov-s. 1-affecting-https://www.legislation.gov.uk/id/asc/2024/1-prov-none-type-inserted"
    assert pages.changes("<p>none</p>") == []


def test_notes():
    rows = pages.notes("<body><p>Start</p><h2>Commentary</h2><h3>Section 1</h3><p>One</p><ul><li>a</li><li>b</li></ul><h2>End</h2><p>x</p></body>", 4)
    assert [(r["route"], r["text"], r["order"]) for r in rows] == [(["Introduction"], "Start", 4), (["Commentary", "Section 1"], "One\n\ta\n\tb", 5), (["End"], "x", 6)]


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("under section 5(2) of the Housing Act 1985", [("Housing Act 1985", "5")]),
        ("sections 3 to 5 of the Energy Act 2013", [("Energy Act 2013", str(n)) for n in (3, 4, 5)]),
        ("the Energy Act 2013 and section 7 of that Act", [("Energy Act 2013", "7")]),
        ("see sections 1, 2 and 4", [(None, "1"), (None, "2"), (None, "4")]),
        ("as the Energy Act 2013 says", [("Energy Act 2013", None)]),
        ("nothing here", []),
    ],
)
def test_references(text, wanted):
    assert [(r["act"], r["section"]) for r in references.find(text)] == wanted


def test_rows_and_quarantine(spark):
    docs = spark.createDataFrame([(1, act()), (2, "<broken"), (3, None)], "id int, xml string")
    good, bad = shred.rows(docs, clml.provisions, clml.PROVISION, "xml", "id")
    assert good.count() == 3
    assert [r.id for r in bad.collect()] == [2]


def test_rows_are_given_out_as_they_are_made(spark):
    """One pass over the texts for rows, whatever a batch holds; repeated rows and errors stay."""
    docs = spark.range(40).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("x")).coalesce(1)
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        if text == "t7":
            raise ValueError("no")
        return [{"a": text}] * 2

    good, bad = shred.rows(docs, read, "a string", "x", "id")
    assert sorted(map(tuple, good.collect())) == sorted([(n, f"t{n}") for n in range(40) if n != 7] * 2)
    assert seen.value == 40
    assert [tuple(r) for r in bad.collect()] == [(7, "ValueError: no")]


@pytest.mark.parametrize("read", [parse, pages.tree])
def test_a_tree_goes_with_its_root(read):
    """No tree waits for the garbage collector, whatever the number of documents."""
    gc.disable()
    try:
        root = read("<a><b>one<c>two</c></b></a>")
        inner = root.first("c")
        assert (inner.parent, inner.above("a").tag, root.parent) == (root.first("b"), "a", None)
        inner = weakref.ref(inner)
        del root
        assert inner() is None
    finally:
        gc.enable()
