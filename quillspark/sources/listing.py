"""Paged listings as Python data sources.

``listing`` calls a function of a task and a page number.  ``listed`` reads the
listings of a site: acts by type and year, feeds of older years, judgments by
court and year, tables of changes by year.  What a query asks of ``type`` and
``year`` is pushed to it (with ``spark.sql.python.filterPushdown.enabled``), so
that a type or year that isn't asked for is never fetched.  The network stays
behind one function, ``fetch(address, options)``, which gives the page's text
or None.
"""

from __future__ import annotations

import importlib
import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import count

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from quillspark.shred.pages import tree

#: Years from which acts have listings of their own; older ones stand in feeds by year.
MODERN = 1963
#: Judgments begin in this year.
FIRST_JUDGMENTS = 2001
#: Parts of stored pages, and pages of a row group.
PARTS, GROUP = 16, 64
#: Results of a page of judgments and of changes.
CASES_A_PAGE, CHANGES_A_PAGE = 50, 100


class _Task(InputPartition):
    def __init__(self, value):
        super().__init__(value)


def _function(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "task string, page int, url string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.tasks = json.loads(options["tasks"])
        self.fetch = options["fetch"]
        self.most = int(options["pages"]) if "pages" in options else None  # else until the last page

    def partitions(self) -> list[InputPartition]:
        return [_Task(t) for t in self.tasks]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        fetch = _function(self.fetch)
        for page in count(1) if self.most is None else range(1, self.most + 1):
            urls, last = fetch(partition.value, page)
            yield from ((json.dumps(partition.value), page, url) for url in urls)
            if last:
                return


# --- what the pages of a site's listings hold: links, and the next page ------


def acts_page(text: str, kind: str) -> tuple[list[str], str | None]:
    """Acts of a type on a page of results, and the link to the next page."""
    root = tree(text)
    warning = next((d for d in root.walk("div") if "warning" in (d.get("class") or "").split()), None)
    if warning is not None and re.search("No items found for|Sorry, but we cannot satisfy your request", warning.text):
        return [], None
    content = next((d for d in root.walk("div") if d.get("id") == "content"), None)
    body = content.first("tbody") if content is not None else None
    found = []
    for row in body.walk("tr") if body is not None else ():
        cell = row.first("td")
        href = (a.get("href") or "") if cell is not None and (a := cell.first("a")) is not None else ""
        if href.startswith(f"/{kind}") and re.search("/contents(/made)?$", href):
            found.append(re.sub("/contents(/made)?$", "", href))
    following = next((a.get("href") for a in root.walk("a") if a.get("title") == "next page"), None)
    return found, following


def feed_page(text: str) -> tuple[list[tuple[str, str]], bool]:
    """Acts and their types on a page of a year's feed, and whether more pages follow."""
    ids = re.findall(r"<entry\b.*?<id>\s*(.*?)\s*</id>", text, re.DOTALL)
    more = re.search(r"<(?:\w+:)?morePages>\s*(\d+)", text)
    named = [(x.replace("/id/", "/"), x.split("/")[4]) for x in ids if x.count("/") >= 4]
    return named, bool(ids and more and int(more[1]))


def cases_page(text: str) -> tuple[list[str], str | None]:
    """Judgments of a page of results, without their query strings, and the link to the next page."""
    root = tree(text)
    table = next((t for t in root.walk("table") if t.above("div") is not None and "judgments-table" in (t.above("div").get("class") or "") or "judgments-table" in (t.get("class") or "")), None)
    rows = list(table.walk("tr"))[1:] if table is not None else []
    links = [a.get("href").partition("?")[0] for r in rows for a in [r.first("a")] if a is not None and a.get("href")]
    following = next((a.get("href") for a in root.walk("a") if a.text.strip().lower() in ("next", "next page")), None)
    return links, following


class Listed(DataSource):
    """``type, year, page, url`` of a site's listings.

    Options: ``kind`` (acts, cases or changes), ``site``, ``types``, ``years``
    (comma-separated), ``fetch``; all are given to ``fetch``.  Acts of a type
    and year are a partition; a year before ``MODERN`` is one for all its types,
    so its feed is fetched once.
    """

    @classmethod
    def name(cls) -> str:
        return "listed"

    def schema(self) -> str:
        return "type string, year int, page int, url string"

    def reader(self, schema) -> DataSourceReader:
        return _ListedReader(dict(self.options))


class _ListedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.kind = options.get("kind", "acts")
        if self.kind not in ("acts", "cases", "changes"):
            raise ValueError(f"no such listing: {self.kind!r}")
        self.types = [t for t in options.get("types", "").split(",") if t] or ["all"]
        self.years = [int(y) for y in options["years"].split(",")]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Types and years that the query leaves out are no partitions; Spark still applies every filter."""
        tests: dict[type, Callable] = {
            EqualTo: lambda f, x: x == f.value, In: lambda f, x: x in f.value, GreaterThan: lambda f, x: x > f.value, GreaterThanOrEqual: lambda f, x: x >= f.value,
            LessThan: lambda f, x: x < f.value, LessThanOrEqual: lambda f, x: x <= f.value,
        }
        for f in filters:
            test = tests.get(type(f))
            if test and f.attribute == ("year",):
                self.years = [y for y in self.years if test(f, y)]
            if test and f.attribute == ("type",) and self.kind != "changes":
                self.types = [t for t in self.types if test(f, t)]
            yield f

    def partitions(self) -> list[InputPartition]:
        years = sorted(set(self.years))
        if self.kind == "changes":
            return [_Task(("all", y)) for y in years] or [_Task(None)]
        if self.kind == "cases":
            return [_Task((t, y)) for y in years if y >= FIRST_JUDGMENTS for t in self.types] or [_Task(None)]
        modern = [_Task((t, y)) for y in years if y >= MODERN for t in self.types]
        older = [_Task((",".join(self.types), y)) for y in years if y < MODERN and self.types]
        return modern + older or [_Task(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        (kind, year), site = partition.value, self.options.get("site", "")
        fetch = _function(self.options["fetch"])
        if self.kind == "changes":
            yield from self._changes(fetch, site, year)
        elif self.kind == "acts" and year < MODERN:
            yield from self._feed(fetch, site, year, kind.split(","))
        else:
            first = f"{site}/{kind}/{year}" if self.kind == "acts" else f"{site}/judgments/search?query=&order=-date&page=1&per_page={CASES_A_PAGE}&from_date_2={year}&to_date_2={year}" + (f"&court={kind}" if kind != "all" else "")
            yield from self._linked(fetch, site, first, kind, year)

    def _linked(self, fetch, site: str, address: str, kind: str, year: int) -> Iterator[tuple]:
        """Pages that name the next one; a page without results may still name one."""
        seen = set()
        for page in count(1):
            text = fetch(address, self.options)
            if text is None:
                return
            seen.add(address)
            urls, following = acts_page(text, kind) if self.kind == "acts" else cases_page(text)
            yield from ((kind, year, page, site + u if u.startswith("/") else u) for u in urls)
            if not following:
                return
            address = site + following if following.startswith("/") else f"{address.partition('?')[0]}{following}" if following.startswith("?") else following
            if address in seen:
                return

    def _feed(self, fetch, site: str, year: int, types: list[str]) -> Iterator[tuple]:
        """A year's feed, as long as it says that pages follow."""
        for page in count(1):
            text = fetch(f"{site}/primary+secondary/{year}/data.feed" + (f"?page={page}" if page > 1 else ""), self.options)
            entries, more = feed_page(text) if text is not None else ([], False)
            yield from ((kind, year, page, url) for url, kind in entries if kind in types or types == ["all"])
            if not more:
                return

    def _changes(self, fetch, site: str, year: int) -> Iterator[tuple]:
        """Pages of changes by number, until one has no table."""
        for page in count(1):
            address = f"{site}/changes/affected/all/{year}?results-count={CHANGES_A_PAGE}&page={page}&sort=affected-year-number"
            text = fetch(address, self.options)
            if text is None or tree(text).first("table") is None:
                return
            yield "all", year, page, address


def http_page(address: str, options: dict[str, str]) -> str | None:
    """A page of the network; None where the server has none.  ``timeout`` in seconds, ``tries`` of a server that is busy or fails, ``pause`` before another, doubled each time."""
    import time
    import urllib.error
    import urllib.request

    pause, tries = float(options.get("pause", "1")), int(options.get("tries", "4"))
    for left in reversed(range(tries)):
        try:
            with urllib.request.urlopen(address, timeout=float(options.get("timeout", "30"))) as answer:  # noqa: S310 - the caller names the site
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as problem:
            if problem.code not in (429, 500, 502, 503, 504):
                return None
            if not left:
                raise
        except urllib.error.URLError:
            if not left:
                raise
        time.sleep(pause)
        pause *= 2
    return None


def stored_page(address: str, options: dict[str, str]) -> str | None:
    """A fetch from stored pages: the folder ``pages`` of Parquet ``url, html`` in 16 parts by CRC-32 of the address (``store_pages``).

    What a part's files hold is read once by a worker; a fetch then reads the one row group that can hold the address.
    """
    import pyarrow.parquet as pq

    system, firsts, groups = _stored(options["pages"], zlib.crc32(address.encode()) % PARTS)
    at = bisect_right(firsts, address) - 1
    if at < 0 or groups[at][1] < address:
        return None
    _, _, file, group, footer = groups[at]
    with system.open_input_file(file) as held:
        found = pq.ParquetFile(held, metadata=footer).read_row_group(group, columns=["url", "html"])
    place = found.column("url").index(address).as_py()
    return found.column("html")[place].as_py() if place >= 0 else None


@lru_cache(maxsize=4 * PARTS)
def _stored(pages: str, part: int):
    """The file system of stored pages, and of a part's row groups the first addresses, and all of them with their last one, file, number and footer."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(pages)
    folder, groups = f"{path}/part={part}", []
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        for info in system.get_file_info(fs.FileSelector(folder)):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as held:
                file = pq.ParquetFile(held)
                for n in range(file.metadata.num_row_groups):
                    urls = file.read_row_group(n, columns=["url"]).column(0)
                    groups.append((urls[0].as_py(), urls[-1].as_py(), info.path, n, file.metadata))
    groups.sort(key=lambda g: g[:4])
    return system, [g[0] for g in groups], groups


def store_pages(pages, path: str) -> None:
    """Pages ``url, html`` for ``stored_page``: parts in the order of their addresses, in row groups of ``GROUP``."""
    from pyspark.sql import functions as F

    placed = pages.select("url", "html", (F.crc32("url") % PARTS).cast("int").alias("part"))
    ordered = placed.repartitionByRange("part", "url").sortWithinPartitions("part", "url")
    ordered.write.mode("overwrite").option("parquet.block.row.count.limit", str(GROUP)).partitionBy("part").parquet(path)


def court_years(years: list[int]) -> list[int]:
    """Years of a court listing must follow one another and not be before 2001."""
    ordered = sorted(years)
    if ordered != list(range(ordered[0], ordered[-1] + 1)) or ordered[0] < FIRST_JUDGMENTS:
        raise ValueError("years must be consecutive and 2001 or later")
    return ordered
