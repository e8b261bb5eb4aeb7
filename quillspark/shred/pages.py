"""HTML tables of changes and pages of explanatory notes."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import note_section, note_type
from quillspark.shred.tree import Node

CHANGE = "id string, changed_legislation string, changed_year int, changed_number string, changed_url string, changed_provision string, changed_provision_url string, affecting_legislation string, affecting_year int, affecting_number string, affecting_url string, affecting_provision string, affecting_provision_url string, type_of_effect string"
NOTE = "route array<string>, text string, `order` int"
SITE = "https://www.legislation.gov.uk"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, [], self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.root


def _link(cell: Node) -> str | None:
    a = cell.first("a")
    href = a.get("href") if a else None
    return href if not href or href.startswith("http") else SITE + href


def _year_number(text: str) -> tuple[int | None, str | None]:
    head, _, tail = text.partition("\xa0")
    if not re.fullmatch(r"\s*\d+\s*", head) or not tail:
        return None, None
    tail = tail.partition("\xa0")[0]
    number = re.sub(r"^(?:c|No)\. ", "", tail)
    return int(head), number.split()[-1] if number == tail and " " in tail else number


def changes(page: str) -> list[dict]:
    """A row for each change of a results table; placeholders for missing acts are left out."""
    table = tree(page).first("table")
    out = []
    for row in (table.first("tbody") or table).walk("tr") if table else ():
        cells = row.nodes("td")
        if len(cells) < 7:
            continue
        record: dict = {"type_of_effect": cells[3].text.strip() or None}
        for side, at in (("changed", 1), ("affecting", 5)):
            url = _link(cells[at])
            year, number = _year_number(cells[at].text)
            record |= {f"{side}_legislation": url.split("/id/")[1] if url and "/id/" in url else None, f"{side}_year": year, f"{side}_number": number, f"{side}_url": url, f"{side}_provision": cells[at + 1].text.strip() or None, f"{side}_provision_url": _link(cells[at + 1])}
        if any("/0000" in (record[f"{s}_legislation"] or "") for s in ("changed", "affecting")):
            continue
        part = [f"{label}-{record[key] or 'none'}" for label, key in (("changed", "changed_url"), ("prov", "changed_provision"), ("affecting", "affecting_url"), ("prov", "affecting_provision"), ("type", "type_of_effect"))]
        out.append(record | {"id": "-".join(part)})
    return out


def _lines(text: str) -> str:
    return "\n".join(re.match(r"^\t*", x)[0] + x.strip() for x in text.split("\n") if x.strip())


def note_records(rows: DataFrame, act: str = "legislation_id") -> DataFrame:
    """Stored notes of the rows of ``notes`` with their act: key, type, and the provision that the innermost heading names."""
    named = F.filter(F.transform(F.reverse("route"), note_section), lambda x: x["kind"].isNotNull())
    found = F.get(named, F.lit(0))
    key = F.concat(F.col(act), F.lit("_"), (F.col("order") + 1).cast("string"))
    return rows.select(key.alias("id"), F.col(act).alias("legislation_id"), note_type("route").alias("note_type"), "route", found["kind"].alias("section_type"), found["number"].alias("section_number"), "order", "text")


def notes(page: str, first: int = 0, inside: bool = False) -> list[dict]:
    """Texts under headings h2 to h6 of a page; the second level begins as Introduction.

    With ``inside`` only what stands in the page's article, or in its snippet of a note, is read.
    """
    route: list[str | None] = [None, "Introduction", None, None, None]
    out, text = [], ""
    root = tree(page)
    body = root.first("body") or root
    if inside:
        body = next((d for d in root.walk("div") if "LegSnippet" in (d.get("class") or "").split()), None) or root.first("article") or body
    for node in [*body.nodes(), Node("h2")]:
        level = int(node.tag[1]) - 2 if re.fullmatch(r"h[2-6]", node.tag) else None
        if level is not None:
            if text.strip():
                out.append({"route": [r for r in route if r is not None], "text": _lines(text.strip()), "order": first + len(out)})
            text = ""
            route[level:] = [node.text.strip(), *[None] * (4 - level)]
        elif node.tag in ("p", "blockquote") and node.text.strip():
            text += node.text.strip() + "\n"
        elif node.tag in ("ul", "ol"):
            text += "".join(f"\t{x}\n" for c in node.children if (x := (c.text if isinstance(c, Node) else c).strip()))
    return out


#: What the pages of a note crawl are: an act's contents, the contents of its notes, a whole note or a part of one.
ACT_PAGE, CONTENTS_PAGE, NOTE_PAGE = "act contents", "note contents", "note"


def note_style(root: Node) -> str | None:
    """``old`` where all notes are one page away, ``new`` where they are a chain of pages, else null."""
    opener = next((a for a in root.walk("a") if a.get("title") == "Open Explanatory Notes"), None)
    if opener is not None and opener.text == "Open full notes":
        return "old"
    article = root.first("article")
    heading = next((h for h in article.walk("h2") if "title" in (h.get("class") or "").split()), None) if article else None
    return "new" if heading is not None and heading.text.strip() == "What these notes do" else None


def note_links(page: str, kind: str, url: str) -> list[tuple[str, str]]:
    """``url, kind`` of the links that a note crawl follows from a page."""
    root = tree(page)
    if kind == ACT_PAGE:
        found = [a for a in root.walk("a") if a.text == "Explanatory Notes"][:1]
        return [(urljoin(url, a.get("href")), CONTENTS_PAGE) for a in found if a.get("href")]
    style = note_style(root) if kind == CONTENTS_PAGE else "new"
    if style == "old":
        found = [a for a in root.walk("a") if a.get("title") == "Open Explanatory Notes"][:1]
    elif style == "new":  # the contents are the first page of the chain
        found = [a for a in root.walk("a") if {"userFunctionalElement", "nav"} <= set((a.get("class") or "").split()) and a.text.strip() == "Next"][:1]
    else:
        found = []
    return [(urljoin(url, a.get("href")), NOTE_PAGE) for a in found if a.get("href")]
