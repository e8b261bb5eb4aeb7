"""Main text of web pages by shallow block features.

A page becomes a flat list of text blocks.  Each block has its number of words
and link density, those of the blocks beside it, and what its surroundings are
(inside an article, inside an element that by its name is a menu, an advert, a
notice and so on).  A decision tree, trained on a small labelled table, says
which blocks are main text.

Defined results: a null or empty page has an empty text; text outside any block
element is a block; unclosed and wrongly nested elements are taken as browsers
would show them, block by block; a ``<`` without a ``>`` after it is text;
repeated rows are extracted each; other columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# --- blocks ---------------------------------------------------------------

#: Elements whose content is never text of the page.
_SILENT = "script|style|template|svg|math|iframe|object|canvas|textarea|select|title|noscript|video|audio|map"
_SILENT_NAMES = frozenset(_SILENT.split("|"))
#: Of these, those that ``/>`` closes; it means nothing on an element of HTML, scripts and styles among them.
_FOREIGN = frozenset(("svg", "math"))
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in _SILENT_NAMES}
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``start, end, name, closes, attributes`` of every tag in order; comments, declarations and silent elements have no name.

    A silent element goes to its closing tag; without one, or as a foreign
    element closed by ``/>``, it is its tag alone.  A quote that never closes ends the reading of quotes
    for the rest of the page, so each place is read a bounded number of times.
    """
    at, quotes = 0, True
    unclosed: set[str] = set()
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0 and start < last:
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", False, ""
            continue
        m = _NAME.match(page, start)
        if not m:
            at = start + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.find(">", at) + 1
                yield start, at, "", False, ""
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            quotes = False
            end = page.find(">", m.end())
            attributes, at = page[m.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        name = m[2].lower()
        if name not in _SILENT_NAMES or m[1]:
            yield start, at, name, bool(m[1]), attributes
            continue
        if not (attributes.endswith("/") and name in _FOREIGN) and name not in unclosed:
            if closing := _CLOSING[name].search(page, at):
                at = closing.end()
            else:
                unclosed.add(name)
        yield start, at, "", False, name


_BLOCKS = frozenset("address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are not main text wherever they stand.
_ASIDE = frozenset("nav footer aside form menu dialog button fieldset search head".split())
#: Class and id names of what is not main text, alone or as the last word of a name (``site-header``).
_LAST = re.compile(
    r"(?:.*[_-])?(?:ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscri\w*|sign-?up|login|"
    r"nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|rail|widget|header|masthead|footer|foot|copyright|comments?|commentlist|replies|reply|respond|disqus|discussion|social|share|sharing|"
    r"related|recommend\w*|more-stories|trending|popular|tags?|pagination|pager|skip|toolbar|search)\d*",
    re.I,
)
#: Names that say so as the first word as well (``comment-body``); others may name a subject there (``notice-period``).
_FIRST = re.compile(
    r"(?:ads?|adverts?|advertis\w*|sponsor\w*|cookies?|consent|gdpr|newsletter|nav|navbar|navigation|menu|breadcrumbs?|sidebar|widget|masthead|footer|comments?|commentlist|disqus|social|sharing|"
    r"pagination|related[_-]?(?:posts?|articles?|stor(?:y|ies)|links?|content|news|items?|topics?))(?:[_-].*|\d*)",
    re.I,
)
#: Elements of running text, whose names mostly say how they look: only a name alone counts.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li td th dd dt blockquote figcaption pre".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    aside: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _names(token: str, running: bool) -> bool:
    """Whether a class or id names something that is not main text."""
    if running and ("-" in token or "_" in token):
        return False
    return bool(_LAST.fullmatch(token) or _FIRST.fullmatch(token))


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element by its name or attributes holds no main text."""
    if tag in _ASIDE or tag == "header" and not inside:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and any(_names(token, tag in _RUNNING) for token in value.split()) or name == "role" and value.lower() in _ROLES:
            return True
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, str]] = []  # element, inside an article, apart, heading
    text: list[str] = []
    linked: list[bool] = []
    article = apart = False
    heading = ""
    link = 0

    def close() -> None:
        if text:
            words = count = 0
            for part, is_link in zip(text, linked, strict=True):
                n = len(part.split())
                words += n
                count += n * is_link
            shown = " ".join("".join(text).split())
            if shown:
                out.append(Block(shown, words, count, article, apart, bool(heading)))
            text.clear()
            linked.clear()

    at = 0
    for start, end, tag, closes, attributes in tags(page):
        if start > at:
            text.append(html.unescape(page[at:start]))
            linked.append(link > 0)
        at = end
        if not tag:
            if attributes in ("iframe", "video"):
                text.append(" ")
                linked.append(False)
            continue
        if tag == "a":
            link = 0 if closes else 1
        elif tag == "br":
            text.append(" ")
            linked.append(link > 0)
        elif tag in _BLOCKS:
            close()
            link = 0
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCKS:
            continue
        if tag in _BLOCKS or tag in ("span", "ins"):
            if not closes:
                if tag == "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                    _, article, apart, heading = stack[-1] if stack else ("", False, False, "")
                was = apart
                article = article or tag in ("article", "main")
                apart = apart or _apart(tag, attributes, article)
                heading = tag if tag[0] == "h" and tag[1:].isdigit() else heading
                if tag in ("span", "ins") and apart != was:
                    close_needed = (article, was, heading)
                    article, apart, heading = close_needed
                    close()
                    apart = True
                stack.append((tag, article, apart, heading))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if tag in ("span", "ins") and (stack[k - 1][2] if k else False) != apart:
                            close()
                        del stack[k:]
                        break
                _, article, apart, heading = stack[-1] if stack else ("", False, False, "")
    if at < len(page):
        text.append(html.unescape(page[at:]))
        linked.append(link > 0)
    close()
    return out


# --- the tree -------------------------------------------------------------

FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "article", "aside", "heading", "page has article")
#: Labelled blocks, one row each: the features in their order, then 1 for main text.
LABELLED = [
    # pages with an article element
    (9, 0.0, 1, 1.0, 40, 0.0, 1, 0, 1, 1, 1), (60, 0.0, 9, 0.0, 35, 0.0, 1, 0, 0, 1, 1), (35, 0.05, 60, 0.0, 4, 0.0, 1, 0, 0, 1, 1), (4, 0.0, 35, 0.0, 80, 0.1, 1, 0, 0, 1, 1),
    (80, 0.1, 4, 0.0, 6, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 80, 0.0, 12, 0.0, 1, 0, 0, 1, 1), (2, 0.0, 50, 0.0, 50, 0.0, 1, 0, 0, 1, 1), (1, 0.0, 20, 0.0, 8, 0.3, 1, 0, 0, 1, 1),
    (12, 1.0, 50, 0.0, 40, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 30, 0.0, 3, 0.0, 1, 0, 1, 1, 1), (25, 0.4, 30, 0.0, 10, 0.0, 1, 0, 0, 1, 1), (120, 0.0, 1, 1.0, 7, 0.0, 1, 0, 0, 1, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 6, 0.0, 0, 1, 0, 1, 0), (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 1, 0),
    (7, 0.0, 30, 0.0, 0, 0.0, 0, 1, 0, 1, 0), (30, 0.0, 60, 0.0, 5, 0.0, 1, 1, 0, 1, 0), (12, 0.0, 60, 0.0, 40, 0.0, 1, 1, 0, 1, 0), (55, 0.0, 40, 0.0, 20, 0.0, 1, 1, 0, 1, 0),
    (3, 0.0, 40, 0.0, 15, 0.0, 1, 1, 1, 1, 0), (18, 0.0, 9, 0.0, 8, 0.0, 0, 0, 0, 1, 0), (45, 0.0, 1, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (5, 0.0, 12, 0.0, 30, 0.0, 0, 0, 1, 1, 0),
    (22, 0.1, 40, 0.0, 3, 1.0, 0, 0, 0, 1, 0), (70, 0.0, 22, 0.0, 4, 0.0, 0, 1, 0, 1, 0), (28, 0.0, 33, 0.0, 18, 0.0, 0, 1, 0, 1, 0), (2, 1.0, 28, 0.0, 2, 1.0, 0, 0, 0, 1, 0),
    # pages without one
    (50, 0.0, 7, 0.0, 45, 0.0, 0, 0, 0, 0, 1), (45, 0.02, 50, 0.0, 38, 0.0, 0, 0, 0, 0, 1), (38, 0.1, 45, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (18, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    (14, 0.0, 22, 0.0, 9, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 1), (5, 0.0, 40, 0.0, 33, 0.0, 0, 0, 1, 0, 1), (6, 0.0, 33, 0.0, 40, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 25, 0.0, 31, 0.0, 0, 0, 0, 0, 1), (90, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0, 1), (200, 0.05, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (24, 0.3, 30, 0.0, 41, 0.0, 0, 0, 0, 0, 1),
    (16, 0.0, 7, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (11, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 18, 0.0, 14, 0.0, 0, 0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 50, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 38, 0.0, 2, 1.0, 0, 0, 0, 0, 0),
    (9, 0.9, 3, 1.0, 8, 0.8, 0, 0, 0, 0, 0), (14, 0.8, 40, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (6, 0.7, 1, 1.0, 22, 0.0, 0, 0, 0, 0, 0), (40, 0.9, 4, 1.0, 4, 1.0, 0, 0, 0, 0, 0),
    (15, 0.0, 40, 0.0, 22, 0.0, 0, 1, 0, 0, 0), (40, 0.0, 30, 0.0, 22, 0.0, 0, 1, 0, 0, 0), (5, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (4, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1, 0, 0),
    # links inside an article: headlines, references and lone linked paragraphs are main text, lists of links and "read more" are not
    (7, 1.0, 1, 1.0, 40, 0.0, 1, 0, 1, 1, 1), (5, 1.0, 0, 0.0, 60, 0.0, 1, 0, 1, 1, 1), (9, 1.0, 30, 0.0, 35, 0.0, 1, 0, 1, 1, 1), (3, 1.0, 50, 0.0, 25, 0.0, 1, 0, 1, 1, 1),
    (2, 1.0, 2, 1.0, 70, 0.0, 1, 0, 1, 1, 1), (6, 1.0, 12, 0.0, 4, 0.3, 1, 0, 1, 1, 1), (8, 1.0, 1, 1.0, 5, 0.0, 1, 0, 1, 1, 1), (4, 1.0, 0, 0.0, 3, 1.0, 1, 0, 1, 1, 1),
    (12, 1.0, 20, 0.0, 15, 0.0, 1, 0, 0, 1, 1), (8, 1.0, 30, 0.0, 45, 0.0, 1, 0, 0, 1, 1), (6, 1.0, 45, 0.0, 30, 0.0, 1, 0, 0, 1, 1), (6, 1.0, 80, 0.1, 60, 0.0, 1, 0, 0, 1, 1),
    (10, 1.0, 9, 0.0, 12, 0.0, 1, 0, 0, 1, 1), (20, 0.9, 30, 0.0, 0, 0.0, 1, 0, 0, 1, 1), (7, 0.9, 15, 0.0, 8, 0.0, 1, 0, 0, 1, 1), (9, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1, 1),
    (14, 0.8, 16, 0.7, 12, 0.8, 1, 0, 0, 1, 1), (12, 0.7, 2, 0.0, 14, 0.8, 1, 0, 0, 1, 1), (18, 0.8, 14, 0.8, 0, 0.0, 1, 0, 0, 1, 1), (16, 0.6, 1, 0.0, 20, 0.6, 1, 0, 0, 1, 1),
    (25, 0.7, 18, 0.8, 22, 0.7, 1, 0, 0, 1, 1), (15, 0.8, 25, 0.6, 3, 1.0, 1, 0, 0, 1, 1),
    (2, 1.0, 60, 0.0, 50, 0.0, 1, 0, 0, 1, 0), (2, 1.0, 30, 0.0, 0, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 90, 0.0, 40, 0.0, 1, 0, 0, 1, 0), (2, 1.0, 12, 0.0, 30, 0.0, 1, 0, 0, 1, 0),
    (4, 1.0, 40, 0.0, 5, 1.0, 1, 0, 0, 1, 0), (5, 1.0, 4, 1.0, 6, 1.0, 1, 0, 0, 1, 0), (6, 1.0, 5, 1.0, 4, 1.0, 1, 0, 0, 1, 0), (4, 1.0, 6, 1.0, 30, 0.0, 1, 0, 0, 1, 0),
    (9, 1.0, 8, 1.0, 7, 1.0, 1, 0, 0, 1, 0), (8, 1.0, 60, 0.0, 9, 1.0, 1, 0, 0, 1, 0), (7, 1.0, 9, 1.0, 40, 0.0, 1, 0, 0, 1, 0), (1, 1.0, 70, 0.0, 1, 1.0, 1, 0, 0, 1, 0),
    (7, 1.0, 3, 0.0, 8, 1.0, 1, 0, 0, 1, 0), (8, 1.0, 7, 1.0, 0, 0.0, 1, 0, 0, 1, 0), (1, 1.0, 1, 1.0, 80, 0.0, 1, 0, 0, 1, 0), (3, 1.0, 3, 1.0, 3, 0.0, 1, 0, 0, 1, 0),
    # plain blocks of articles beside links
    (30, 0.0, 2, 1.0, 4, 1.0, 1, 0, 0, 1, 1), (4, 0.0, 7, 1.0, 40, 0.0, 1, 0, 0, 1, 1), (3, 0.33, 7, 1.0, 50, 0.0, 1, 0, 0, 1, 1), (6, 0.0, 50, 0.0, 4, 1.0, 1, 0, 1, 1, 1),
    # links outside the article, after long paragraphs too
    (2, 1.0, 120, 0.0, 3, 1.0, 0, 0, 0, 1, 0), (3, 1.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1, 0), (8, 1.0, 90, 0.0, 7, 1.0, 0, 0, 0, 1, 0), (6, 1.0, 70, 0.1, 0, 0.0, 0, 0, 0, 1, 0),
    (7, 1.0, 2, 1.0, 12, 0.0, 0, 0, 1, 1, 0), (5, 1.0, 70, 0.0, 14, 0.0, 0, 0, 1, 1, 0), (10, 1.0, 8, 1.0, 9, 1.0, 0, 0, 0, 1, 0), (14, 0.7, 80, 0.0, 30, 0.0, 0, 0, 0, 1, 0),
    # links and scraps of pages without an article
    (8, 1.0, 1, 1.0, 50, 0.0, 0, 0, 1, 0, 1), (6, 1.0, 0, 0.0, 40, 0.0, 0, 0, 1, 0, 1), (4, 1.0, 30, 0.0, 60, 0.0, 0, 0, 1, 0, 1), (9, 1.0, 45, 0.0, 22, 0.0, 0, 0, 1, 0, 1),
    (7, 1.0, 20, 0.0, 5, 0.0, 0, 0, 1, 0, 1), (12, 1.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 1), (8, 1.0, 25, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (6, 0.9, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (9, 1.0, 14, 0.0, 12, 0.0, 0, 0, 0, 0, 1), (15, 0.7, 18, 0.7, 16, 0.8, 0, 0, 0, 0, 1), (18, 0.6, 30, 0.0, 20, 0.7, 0, 0, 0, 0, 1),
    (2, 1.0, 120, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (2, 1.0, 50, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 70, 0.0, 2, 1.0, 0, 0, 0, 0, 0), (3, 1.0, 25, 0.0, 40, 0.0, 0, 0, 0, 0, 0),
    (7, 1.0, 8, 1.0, 9, 1.0, 0, 0, 0, 0, 0), (9, 1.0, 60, 0.0, 8, 1.0, 0, 0, 0, 0, 0), (8, 1.0, 7, 1.0, 30, 0.0, 0, 0, 0, 0, 0), (10, 1.0, 9, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (1, 1.0, 90, 0.0, 1, 1.0, 0, 0, 0, 0, 0), (4, 1.0, 3, 1.0, 2, 0.0, 0, 0, 0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 0), (1, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (3, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), (2, 0.0, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 0),
    (12, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1), (25, 0.0, 4, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (9, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0, 1), (3, 0.0, 1, 1.0, 45, 0.0, 0, 0, 0, 0, 1),
    (3, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (4, 0.0, 2, 1.0, 1, 1.0, 0, 0, 1, 0, 1), (2, 0.0, 1, 1.0, 3, 1.0, 0, 0, 1, 0, 1),
]

#: More of them with varied neighbours, all as (words, density); a group has the blocks, those before, those after, whether they are headings, and the class.
_PLAIN = [(0, 0.0), (5, 0.0), (12, 0.3), (35, 0.0), (70, 0.1), (130, 0.0)]
_LINKS = [(2, 1.0), (5, 1.0), (9, 1.0)]
_TEXT = [(n, d) for n in (1, 2, 3, 5, 8, 12, 18, 28, 45, 60, 80, 120, 200) for d in (0.0, 0.1, 0.4) if n * d >= 1 or not d]
_MAIN = [
    ([(4, 1.0), (8, 1.0), (13, 1.0)], [*_PLAIN, *_LINKS], [(1, 0.0), (2, 0.0), *_PLAIN], 1, 1),  # linked headlines
    ([(6, 1.0), (10, 1.0), (18, 1.0)], _PLAIN[1:], _PLAIN, 0, 1),  # a linked item among prose
    ([(12, 0.7), (16, 0.8), (24, 0.7)], [*_PLAIN[1:], (14, 0.8)], [*_PLAIN, (15, 0.7)], 0, 1),  # references
    ([(1, 1.0), (2, 1.0), (3, 1.0)], [*_PLAIN, *_LINKS], [*_PLAIN, *_LINKS], 0, 0),  # "read more"
    ([(6, 1.0), (10, 1.0), (14, 1.0)], [*_PLAIN, *_LINKS], _LINKS, 0, 0),  # lists of links: their first and middle items
    ([(6, 1.0), (10, 1.0), (14, 1.0)], _LINKS, _PLAIN, 0, 0),  # and their last ones
    (_TEXT, [*_PLAIN, (2, 1.0)], _PLAIN, 0, 1),  # paragraphs, one side of which at most is a link
    (_TEXT, _PLAIN, [(2, 1.0)], 0, 1),
    (_TEXT[:8], [(0, 0.0), (12, 0.3), (70, 0.1), (2, 1.0)], [(5, 0.0), (35, 0.0), (2, 1.0)], 1, 1),  # headings
]
_CITED = ([(12, 1.0), (15, 1.0), (20, 1.0)], [(13, 1.0), (22, 1.0)], [(12, 1.0), (18, 1.0), (5, 0.0), (60, 0.0), (0, 0.0)])
_SCRAPS = [n for n in _TEXT if n[0] < 4]
LABELLED += [
    (*block, *before, *after, article, 0, heading, article, label)
    for article in (0, 1)
    for some, befores, afters, heading, label in [*_MAIN, (_SCRAPS, _LINKS, _LINKS, 0, article), (*_CITED, 0, article), ([x for x in _TEXT if x[0] > 4], _LINKS, _LINKS, 0, 1)]
    for block in some
    for before in befores
    for after in afters
]
# outside the article of a page that has one, and in menus, notices and the like
LABELLED += [
    (*block, *before, *after, article, aside, heading, page, 0)
    for article, aside, page in ((0, 0, 1), (0, 1, 1), (1, 1, 1), (0, 1, 0))
    for heading, some in ((0, [*_TEXT, (2, 1.0), (8, 1.0), (15, 0.7)]), (1, [(3, 0.0), (8, 1.0)]))
    for block in some
    for before in [(12, 0.0), (70, 0.0), (2, 1.0)]
    for after in [(12, 0.0), (70, 0.0), (2, 1.0)]
]


def grow(rows: np.ndarray, depth: int = 16) -> tuple:
    """A tree of (feature, threshold, left, right) or a leaf's class, by Gini impurity."""
    y = rows[:, -1]
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (int(share >= 0.5),)
    best = None
    for feature in range(rows.shape[1] - 1):
        values = np.unique(rows[:, feature])
        for cut in (values[1:] + values[:-1]) / 2:
            side = rows[:, feature] <= cut
            p, q = y[side].mean(), y[~side].mean()
            impurity = side.mean() * p * (1 - p) + (1 - side.mean()) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, cut, side)
    if best is None:
        return (int(share >= 0.5),)
    _, feature, cut, side = best
    return feature, float(cut), grow(rows[side], depth - 1), grow(rows[~side], depth - 1)


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


_trees: list[tuple] = []


def main_text(page: str) -> str:
    """Blocks that the tree takes for main text, one a line."""
    if not _trees:
        _trees.append(grow(np.array(LABELLED, float)))
    found = blocks(page)
    has = any(b.article and not b.aside for b in found)
    none = Block("", 0, 0, False, False, False)
    out = []
    for before, block, after in zip([none, *found][: len(found)], found, [*found, none][1:], strict=True):
        row = (block.words, block.density, before.words, before.density, after.words, after.density, block.article, block.aside, block.heading, has)
        if decide(_trees[0], row):
            out.append(block.text)
    return "\n".join(out)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url, text, n_chars`` of every page."""
    small_batches(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "") for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    chosen = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnRenamed("id", id_col)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
