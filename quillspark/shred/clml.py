"""Acts in their XML: one header row, provisions with their text, commentaries, and text as markdown."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.shred.tree import Node, parse

HEADER = "id string, uri string, title string, description string, enacted string, valid string, modified string, publisher string, category string, type string, year int, number int, status string, extent string, provisions int, has_body boolean, european boolean"
PROVISION = "uri string, legislation_id string, title string, text string, extent string, provision_type string, number string, paragraphs array<struct<uri:string,text:string>>, commentary_refs array<string>, label string"
COMMENTARY = "legislation_id string, ref string, type string, text string, citation_id string, citation_uri string, citation_ref string, citation_type string"


# --- markdown -----------------------------------------------------------------

_DEPTH = re.compile(r"P(\d+)$")
_PLAIN = re.compile(r"(?:P\d+(?:para|group)|Text|Schedule|ScheduleBody|UnorderedList|Para)$")


class _Markdown:
    """Writes a tree as text.  A heading that has taken a number says so to the number that follows."""

    def __init__(self):
        self.number_taken = False

    def inside(self, node: Node, depth: int) -> str:
        out = "".join(self.one(c, depth) if isinstance(c, Node) else f"{c.strip()} " * bool(c.strip()) for c in node.children)
        return out.replace("“ ", "“").replace(" ”", "”")

    def one(self, node: Node, depth: int) -> str:
        rule = getattr(self, f"on_{node.tag}", None)
        if rule:
            return rule(node, depth)
        if m := _DEPTH.match(node.tag):
            return self.inside(node, max(0, int(m[1]) - 2))
        return self.inside(node, depth) if _PLAIN.match(node.tag) else f"{node.text.strip()} "

    def block(self, node: Node, depth: int) -> str:
        """A node as a document of its own: what has no rule is written by its parts."""
        known = hasattr(self, f"on_{node.tag}") or _DEPTH.match(node.tag) or _PLAIN.match(node.tag)
        return self.one(node, depth) if known else self.inside(node, depth)

    def on_Pnumber(self, node: Node, depth: int) -> str:  # noqa: N802
        if self.number_taken:
            self.number_taken = False
            return ""
        return "\n" + "\t" * depth + node.text.strip() + ") "

    def on_BlockAmendment(self, node: Node, depth: int) -> str:  # noqa: N802
        return self.inside(node, depth + 1).replace("\n", "\n" + "\t" * depth)

    def on_ListItem(self, node: Node, depth: int) -> str:  # noqa: N802
        return "\n" + "\t" * (depth + 1) + "- " + self.inside(node, depth + 1).strip()

    def headed(self, node: Node, depth: int, head) -> str:
        """The heads of a node's title children before what the others give."""
        heads, rest = [], []
        for child in node.children:
            found = head(child) if isinstance(child, Node) else None
            if found is not None:
                heads.append(found)
            elif isinstance(child, Node):
                rest.append(self.block(child, depth))
            elif child.strip():
                rest.append(f"{child.strip()} ")
        return heads, "".join(rest)

    def on_Pblock(self, node: Node, depth: int) -> str:  # noqa: N802
        heads, rest = self.headed(node, depth, lambda c: f"*{c.text.strip()}*\n" if c.tag == "Title" else None)
        return "".join(heads[-1:]) + rest

    def on_Part(self, node: Node, depth: int) -> str:  # noqa: N802
        heads, rest = self.headed(node, depth, lambda c: f"## {c.text.strip()}\n" if c.tag in ("Number", "Title") else None)
        return "".join(heads) + "\n" * bool(heads) + rest

    def on_P1group(self, node: Node, depth: int) -> str:  # noqa: N802
        number = node.first("Pnumber")

        def head(child: Node) -> str | None:
            if child.tag != "Title":
                return None
            if number is None:
                return ""
            self.number_taken = True
            word = "" if "Article" in number.text else "Section "
            return f"\n\n{word}{number.text.strip()}) **{child.text.strip()}**\n"

        heads, rest = self.headed(node, depth, head)
        return "".join(heads[-1:]) + rest


def markdown(node: Node) -> str:
    writer = _Markdown()
    return writer.block(node, 0).lstrip("\n")


def markdown_of(text: str) -> str:
    """A fragment or document as markdown."""
    return markdown(parse(text))


# --- rows -----------------------------------------------------------------------


def _flat(node: Node | None) -> str:
    if node is None:
        return ""
    text = " ".join(s.strip() for s in node.strings() if s.strip())
    return re.sub(r" ([.,])$", r"\1", re.sub(r"\s+", " ", text).strip())


def _whole(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*\d+\s*", text) else None


def _value(root: Node, tag: str) -> str | None:
    found = root.first(tag)
    return found.get("Value") if found else None


def header(text: str) -> list[dict]:
    """One row; a missing number of provisions is null and not an error."""
    root = parse(text)
    named = {tag: _flat(root.first(tag)) or None for tag in ("title", "description", "identifier", "publisher", "modified", "valid")}
    enacted = root.first("EnactmentDate", "Made")
    uri = root.get("IdURI") or named["identifier"]
    return [{
        "id": uri, "uri": root.get("DocumentURI") or named["identifier"], "title": named["title"], "description": named["description"], "enacted": enacted.get("Date") if enacted else None,
        "valid": named["valid"] or root.get("RestrictStartDate"), "modified": named["modified"], "publisher": named["publisher"], "category": _value(root, "DocumentCategory"), "type": _value(root, "DocumentMainType"),
        "year": _whole(_value(root, "Year")), "number": _whole(_value(root, "Number")), "status": _value(root, "DocumentStatus"), "extent": root.get("RestrictExtent"),
        "provisions": _whole(root.get("NumberOfProvisions")), "has_body": root.first("Body", "EUBody") is not None, "european": root.first("EURetained") is not None,
    }]


def _paragraphs(node: Node, tag: str) -> list[dict]:
    return [{"uri": p.get("IdURI"), "text": _flat(p)} for p in node.walk(tag) if p.get("IdURI")]


def _refs(node: Node) -> list[str]:
    return [r.get("Ref") for r in node.walk("CommentaryRef") if r.get("Ref")]


def with_commentaries(provisions: DataFrame, commentaries: DataFrame) -> DataFrame:
    """A row for each commentary that a provision refers to."""
    asked = provisions.select("uri", "legislation_id", F.explode("commentary_refs").alias("ref"))
    return asked.join(commentaries, ["legislation_id", "ref"])


def _number(uri: str, word: str) -> str:
    return uri.rpartition("/")[2].removeprefix(f"{word}-")


def provisions(text: str) -> list[dict]:
    """Sections of the body, then schedules; no body gives no rows (the act is a scan only).

    Retained acts of the Union have articles in divisions of their own.  ``label``
    is the provision's number as it stands before it.
    """
    root = parse(text)
    act, out = root.get("IdURI"), []
    european = root.first("EURetained") is not None
    body = root.first("EUBody" if european else "Body", "Body", "EUBody")

    def row(node: Node, kind: str, title: str, shown: str, extent: str | None, paragraphs: str) -> dict:
        uri, label = node.get("IdURI"), _flat(node.first("Pnumber")).strip(".")
        return {"uri": uri, "legislation_id": act, "title": title, "text": shown, "extent": extent, "provision_type": kind, "number": _number(uri, kind), "paragraphs": _paragraphs(node, paragraphs), "commentary_refs": _refs(node), "label": label or None}

    for p in body.walk("P1") if body else ():
        if not p.get("IdURI"):
            continue
        if european:  # an article has the title, the text and the divisions of the element around it, and the act's extent
            around = p.parent
            title = around.first("Title")
            out.append(row(p, "section", _flat(title), markdown(around), root.get("RestrictExtent"), "P"))
            continue
        group, part = p.above("P1group"), p.above("Part")
        title = group.nodes("Title") if group else []
        extent = p.get("RestrictExtent") or (part and part.get("RestrictExtent")) or root.get("RestrictExtent")
        out.append(row(p, "section", _flat(title[0]) if title else "", markdown(p), extent, "P2"))
    schedules = root.first("Schedules")
    for s in schedules.walk("Schedule") if schedules else ():
        if s.get("IdURI"):
            title = s.first("Title")
            extent = root.get("RestrictExtent") if european else s.get("RestrictExtent") or root.get("RestrictExtent")
            out.append(row(s, "schedule", _flat(title), markdown(s) if title else "", extent, "P" if european else "P1"))
    return out


def commentaries(text: str) -> list[dict]:
    """Commentaries with their citations, a row for each citation (or one without)."""
    root = parse(text)
    out = []
    for c in root.walk("Commentary"):
        base = {"legislation_id": root.get("IdURI"), "ref": c.get("id"), "type": c.get("Type"), "text": _flat(c)}
        rows = [{"citation_id": x.get("id") or x.get("URI"), "citation_uri": x.get("URI"), "citation_ref": x.get("CitationRef") or "SelfReference", "citation_type": "sub_reference" if x.tag == "CitationSubRef" else "primary"} for x in c.walk("Citation", "CitationSubRef")]
        out += [base | r for r in rows or [dict.fromkeys(("citation_id", "citation_uri", "citation_ref", "citation_type"))]]
    return out


def provision_text(text: str, most: int = 8000) -> str:
    """Texts of over three letters, cut with a mark."""
    parts = [s for x in parse(text).walk("Text") if len(s := _flat(x)) > 3]
    joined = "\n".join(parts)
    return joined if len(joined) <= most else joined[:most] + "…"


SCAN = "legislation_id string, pdf_url string, legislation_type string, identifier string, title string"


def scans(text: str) -> list[dict]:
    """The scan of an act that has no body: its address, and the type and identifier that its own address holds."""
    root = parse(text)
    if root.first("Body", "EUBody") is not None:
        return []
    link = next((x for x in root.walk("link") if x.get("type") == "application/pdf" and x.get("title") == "Original PDF"), None)
    act = root.get("IdURI") or _flat(root.first("identifier")) or ""
    parts = act.split("/")
    return [{"legislation_id": act or None, "pdf_url": link.get("href") if link else None, "legislation_type": parts[4] if len(parts) > 4 else None, "identifier": "/".join(parts[5:]) or None, "title": _flat(root.first("title")) or None}]


#: Letters of a fetched provision, and what stands after a cut.
MOST_LETTERS, CUT = 8000, "... [truncated]"


def fetched_text(text: str) -> str | None:
    """What the elements of a provision begin with, where it is over three letters, cut with a mark; None without any."""
    root = parse(text)
    parts = [s for n in (root, *root.walk()) if n.children and isinstance(n.children[0], str) and len(s := n.children[0].strip()) > 3]
    joined = " ".join(parts)
    return (joined if len(joined) <= MOST_LETTERS else joined[:MOST_LETTERS] + CUT) or None
