import uuid

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import regnal, uri
from quillspark.functions import text as T

ID = "http://www.legislation.gov.uk/id/"

YEARS = [
    (f"{ID}ukpga/2018/12", 2018), (f"{ID}ukla/Vict/44-45/12", 1881), (f"{ID}ukla/Vict/63-64/198", 1900), (f"{ID}ukla/Edw7/3/198", 1904), (f"{ID}ukpga/Geo5/14-15/42", 1924),
    (f"{ID}ukpga/Geo3/41/90", 1801), (f"{ID}ukpga/Geo6/10-11/44", 1946), (f"{ID}ukla/Vict", 1837), ("", None), (f"{ID}ukpga", None), (f"{ID}ukpga/unknown/12", None),
    ("52 & 53 Vict. c. clviii (1889)", 1889), ("S.I. 1948 No. 845", 1948), ("S.R. & O. 1948 No. 845", 1948), ("52 & 53 Vict. c. clviii", 1888), ("14 Geo. 6. c. xliii", 1949),
    ("52-53Vict/cxcvii", 1888), (f"{ID}ukla/Vict_44_45/c12", 1880), ("Edw8and1Geo6/1/100", 1936), ("10-Edw-7-&-1-Geo-5-ch-1", 1910), ("5-edw-7-c-138", 1905),
    ("[UNCLEAR: Liverpool_Sanitary_Amendment_Act_1854_Cap.xv]", 1854), ("local/Metropolitan_District_Railway_Act_1881_c.86", 1881), ("1949 No. 2170", 1949),
]


@pytest.mark.parametrize(("identifier", "year"), YEARS)
def test_year(identifier, year):
    assert regnal.parse_year(identifier) == year


def test_year_from_text():
    missing = "[UNCLEAR: reference not provided]"
    assert regnal.parse_year(missing, "This Act may be cited as the Elementary Education Act 1891") == 1891
    assert regnal.parse_year(missing, "Short Title.—The Court of Session Act, 1868") == 1868
    assert regnal.parse_year(missing, "Some text with no year reference whatsoever") is None


def test_year_column_agrees_with_the_reader(spark):
    rows = spark.createDataFrame([(i, y) for i, y in YEARS], "i string, y int")
    assert rows.where(~regnal.year_of("i").eqNullSafe(F.col("y"))).count() == 0


def test_sovereigns():
    assert regnal.sovereign("victoriae") == ("Vict", 1837, 1901)
    assert regnal.sovereign("George5") == ("Geo5", 1910, 1936)
    assert regnal.sovereign("george") is None
    assert regnal.session_year(1837, 1901, 44) == 1880
    assert regnal.session_year(1837, 1901, 200) is None


@pytest.mark.parametrize(
    ("given_uri", "canonical"),
    [
        ("ukpga/2023/52", f"{ID}ukpga/2023/52"), ("https://www.legislation.gov.uk/id/ukpga/2023/52", f"{ID}ukpga/2023/52"), ("http://www.legislation.gov.uk/ukpga/2023/52", f"{ID}ukpga/2023/52"),
        ("http://www.legislation.gov.uk/ukpga/2023/52/enacted/data.xml", f"{ID}ukpga/2023/52"), ("http://www.legislation.gov.uk/id/uksi/2023/100/made", f"{ID}uksi/2023/100"), ("  /ukpga/2023/52 ", f"{ID}ukpga/2023/52"),
        ("aep/Edw7/6/19", f"{ID}aep/Edw7/6/19"), ("", ""), (None, None), ("http://www.legislation.gov.uk/ukpga/2023/52/enacted/section/1", f"{ID}ukpga/2023/52"),
    ],
)
def test_normalise(spark, given_uri, canonical):
    rows = spark.createDataFrame([(given_uri,)], "u string")
    assert rows.select(uri.normalise_uri("u")).first()[0] == canonical
    again = rows.select(uri.normalise_uri(uri.normalise_uri("u"))).first()[0]
    assert again == canonical


@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=20, max_size=20))
def _names(names):
    _names.seen.append(names)


def test_uuid_is_the_standard_one(spark):
    _names.seen = []
    _names()
    names = sorted({n for batch in _names.seen for n in batch})
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", uri.uuid5("n")).collect()
    assert all(b == str(uuid.uuid5(uuid.NAMESPACE_URL, a)) for a, b in rows)


def test_uri_parts(spark):
    rows = spark.createDataFrame([(f"{ID}ukpga/2000/5/section/12/3",), ("x/y",), (None,)], "u string")
    got = [tuple(r) for r in rows.select(uri.legislation_type("u"), uri.legislation_number("u"), uri.section_number("u"), uri.parent_section("u"), uri.amendment_target("u")).collect()]
    assert got == [("ukpga", 5, 3, f"{ID}ukpga/2000/5/section/12", "ukpga/2000/5/section/12/3"), (None,) * 5, (None,) * 5]


def test_corrected_metadata(spark):
    rows = spark.createDataFrame([(f"{ID}ukpga/2000/5", 1999, "ukpga", 5), (f"{ID}asp/2001/7", 2001, "asp", 7)], "uri string, year int, type string, number int")
    assert [(r.new_year, r.new_type) for r in uri.corrected(rows).collect()] == [(2000, "ukpga")]


def test_text_functions(spark):
    row = spark.createDataFrame([("2017\xa0No. 1283", "\t\ta \n\n  b", "E+W", '{"a": 1} tail', "(a) x\n1)\ny")], "c string, n string, e string, j string, p string")
    got = row.select(T.year_number("c"), T.note_lines("n"), T.extents("e"), T.first_object("j"), T.paragraph_marks("p")).first()
    assert tuple(got[0]) == (2017, "1283")
    assert got[1] == "\t\ta\nb"
    assert got[2] == ["England", "Wales"]
    assert got[3] == '{"a": 1}'
    assert got[4] == "a. x\n1.\ny"


def test_year_spec():
    from quillspark.operators.ingest import expand_years

    assert expand_years("1999,1990-1992 1991") == [1990, 1991, 1992, 1999]
    with pytest.raises(ValueError, match="not a year"):
        expand_years("1990-x")
