"""Crawls in rounds and listings that fetch only what is asked for."""

import re
import threading
import urllib.error
import uuid
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import crawl
from quillspark.shred import pages
from quillspark.sources import listing

A = '<a href="{}">{}</a>'


def site(spark, found):
    return spark.createDataFrame(list(found.items()), "url string, html string")


def anchors(frame):
    return frame.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("url"), "kind", "root")


def test_a_crawl_reaches_each_page_once_and_ends(spark, tmp_path):
    found = {"/1": A.format("/2", "x") + A.format("/3", "y"), "/2": A.format("/1", "back"), "/3": A.format("/4", "x") + A.format("/gone", "z"), "/4": A.format("/3", "x"), "/9": ""}
    seeds = spark.createDataFrame([("/1", "k", "r"), ("/1", "k", "s"), (None, "k", "r")], crawl.FRONTIER)
    got = {r.url: (r["round"], r.html is not None, r.root) for r in crawl.crawl(seeds, crawl.from_table(site(spark, found)), anchors, str(tmp_path)).collect()}
    assert got == {"/1": (0, True, "r"), "/2": (1, True, "r"), "/3": (1, True, "r"), "/4": (2, True, "r"), "/gone": (2, False, "r")}
    assert crawl.crawl(seeds.limit(0), crawl.from_table(site(spark, found)), anchors, str(tmp_path / "none")).count() == 0
    with pytest.raises(RuntimeError):
        crawl.crawl(seeds, crawl.from_table(site(spark, found)), anchors, str(tmp_path / "short"), most_rounds=1)


def test_a_crawl_that_was_cut_off_goes_on(spark, tmp_path):
    found = {f"/{n}": A.format(f"/{n + 1}", "x") for n in range(6)}
    fetched = []

    def fetch(frontier):
        fetched.append(sorted(r.url for r in frontier.collect()))
        if len(fetched) == 4:
            raise OSError("the network is gone")
        return crawl.from_table(site(spark, found))(frontier)

    seeds = spark.createDataFrame([("/0", "k", "r")], crawl.FRONTIER)
    with pytest.raises(OSError, match="gone"):
        crawl.crawl(seeds, fetch, anchors, str(tmp_path))
    got = crawl.crawl(seeds, fetch, anchors, str(tmp_path))
    assert fetched == [["/0"], ["/1"], ["/2"], ["/3"], ["/3"], ["/4"], ["/5"], ["/6"]]
    assert {r.url: r["round"] for r in got.collect()} == {f"/{n}": n for n in range(7)}


OLD = '<a title="Open Explanatory Notes" href="/old/notes/full">Open full notes</a>'
NEXT = '<a class="userFunctionalElement nav" href="{}"><span>Next</span></a>'


def test_notes_of_both_styles(spark, tmp_path):
    found = {
        "/old/contents": A.format("/old/notes", "Explanatory Notes"), "/old/notes": OLD, "/old/notes/full": "<h2>One</h2><p>a</p><h3>Two</h3><p>b</p>",
        "/new/contents": A.format("/new/notes", "Explanatory Notes"), "/new/notes": '<article><h2 class="title">What these notes do</h2><p>first</p></article>' + NEXT.format("/new/notes/2"),
        "/new/notes/2": "<article><h2>Second</h2><p>second</p><p>and more</p></article>" + NEXT.format("/new/notes/3"), "/new/notes/3": "<article><h2>Third</h2><p>third</p></article>",
        "/odd/contents": A.format("/odd/notes", "Explanatory Notes"), "/odd/notes": "<article><h2>Other</h2><p>x</p></article>" + NEXT.format("/odd/notes/2"), "/odd/notes/2": "<p>y</p>", "/none/contents": "<p>no notes</p>",
    }
    acts = spark.createDataFrame([(f"/{x}",) for x in ("old", "new", "odd", "none", "gone")], "url string")
    got = crawl.notes(acts, crawl.from_table(site(spark, found)), str(tmp_path))
    rows = sorted((r.root, r.style, r.order, r.text) for r in got.collect())
    assert rows == [("/new", "new", 0, "first"), ("/new", "new", 1, "second\nand more"), ("/new", "new", 2, "third"), ("/old", "old", 0, "a"), ("/old", "old", 1, "b")]
    assert pages.note_style(pages.tree(found["/odd/notes"])) is None


def counted(address, options):
    """A site whose every fetch leaves a file behind."""
    Path(options["log"], uuid.uuid4().hex).write_text(address)
    _, kind, year, *_ = address.partition("?")[0].split("/")
    page = int(re.search(r"[?&]page=(\d+)", address)[1]) if re.search(r"[?&]page=", address) else 1
    if kind == "primary+secondary":
        entry = "<entry><id>http://l/id/{}/Geo3/41/{}</id></entry>"
        return f"<feed>{entry.format('ukpga', page)}{entry.format('ukla', page)}<leg:morePages>{3 - page}</leg:morePages></feed>"
    if kind == "changes":
        return "<table><tr><td>x</td></tr></table>" if page < 3 else "<p>none</p>"
    if kind == "judgments":
        rows = "".join(f'<tr><td><a href="/ewhc/{year}/{page}?q=1">c</a></td></tr>' for _ in range(1))
        return f'<div class="judgments-table"><table><tr><th>h</th></tr>{rows if page != 2 else ""}</table></div>' + (f'<a href="?page={page + 1}">Next page</a>' if page < 3 else "")
    if year == "1999":
        return '<div class="warning">No items found for 1999</div>'
    rows = f'<tr><td><a href="/{kind}/{year}/{page}/contents/made">x</a></td></tr><tr><td><a href="/other/1/contents">x</a></td></tr><tr></tr>'
    return f'<div id="content"><table><tbody>{rows}</tbody></table></div>' + (f'<a title="next page" href="/{kind}/{year}?page={page + 1}">n</a>' if page < 2 else "")


def read(spark, log, where=None, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(listing.Listed)
    log.mkdir(parents=True)
    df = spark.read.format("listed").options(fetch="test_crawl:counted", log=str(log), **options).load()
    rows = sorted(map(tuple, (df if where is None else df.where(where)).collect()))
    return rows, sorted(p.read_text() for p in log.iterdir())


def test_acts_by_pages_and_pushed_filters(spark, tmp_path):
    every, fetched = read(spark, tmp_path / "a", types="ukpga,uksi", years="1999,2000,2001,1801")
    assert every == sorted(
        [(t, y, n, f"/{t}/{y}/{n}") for t in ("ukpga", "uksi") for y in (2000, 2001) for n in (1, 2)] + [("ukpga", 1801, n, f"http://l/ukpga/Geo3/41/{n}") for n in (1, 2, 3)]
    )
    assert len(fetched) == 8 + 2 + 3  # two pages of each, one of the empty year, three of the feed for all types
    some, fetched = read(spark, tmp_path / "b", "type = 'uksi' and year > 2000", types="ukpga,uksi", years="1999,2000,2001,1801")
    assert some == [r for r in every if r[0] == "uksi" and r[1] > 2000]
    assert fetched == ["/uksi/2001", "/uksi/2001?page=2"]
    none, fetched = read(spark, tmp_path / "c", "year in (5, 6)", types="ukpga", years="2000")
    assert none == fetched == []


def test_judgments_and_changes(spark, tmp_path):
    rows, fetched = read(spark, tmp_path / "a", "year < 2020", kind="cases", types="ewhc", years="1990,2019,2020")
    assert rows == [("ewhc", 2019, n, f"/ewhc/search/{n}") for n in (1, 3)] and len(fetched) == 3
    rows, fetched = read(spark, tmp_path / "b", "year = 2019", kind="changes", years="2019,2020")
    assert [r[:3] for r in rows] == [("all", 2019, 1), ("all", 2019, 2)] and len(fetched) == 3
    with pytest.raises(Exception, match="no such listing"):
        read(spark, tmp_path / "c", kind="other", years="1")


def test_pages_of_the_network():
    answers = {"/a": [200], "/busy": [503, 429, 200], "/down": [500] * 9}
    asked = []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append(self.path)
            code = answers[self.path].pop(0) if answers.get(self.path) else 404
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write("é".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    site, how = f"http://127.0.0.1:{server.server_port}", {"pause": "0.01", "tries": "3"}
    assert listing.http_page(f"{site}/a", how) == listing.http_page(f"{site}/busy", how) == "é"
    assert listing.http_page(f"{site}/none", how) is None and asked.count("/busy") == 3
    with pytest.raises(urllib.error.HTTPError):
        listing.http_page(f"{site}/down", how)
    server.shutdown()
