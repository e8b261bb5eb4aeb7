"""A small tree of XML: local names, attributes, and children that are nodes or strings.

A node is held by the one around it and not the other way, so that a tree goes
with its root: a task that reads many documents holds one tree, and not those
that wait for the garbage collector.
"""

from __future__ import annotations

import re
import weakref
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import InitVar, dataclass, field


@dataclass(eq=False)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    around: InitVar[Node | None] = None

    def __post_init__(self, around: Node | None):
        self._around = around and weakref.ref(around)

    @property
    def parent(self) -> Node | None:
        """The node around this one, while the tree is held by its root."""
        return self._around and self._around()

    def nodes(self, *tags: str) -> list[Node]:
        """Direct children, of the tags if any are given."""
        return [c for c in self.children if isinstance(c, Node) and (not tags or c.tag in tags)]

    def walk(self, *tags: str) -> Iterator[Node]:
        """Descendants in document order."""
        for child in self.children:
            if isinstance(child, Node):
                if not tags or child.tag in tags:
                    yield child
                yield from child.walk(*tags)

    def first(self, *tags: str) -> Node | None:
        return next(self.walk(*tags), None)

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.strings()
            else:
                yield child

    @property
    def text(self) -> str:
        return "".join(self.strings())

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attributes.get(name, default)

    def above(self, tag: str) -> Node | None:
        node = self.parent
        while node and node.tag != tag:
            node = node.parent
        return node


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _build(element: ET.Element, parent: Node | None) -> Node:
    node = Node(_local(element.tag), {_local(k): v for k, v in element.attrib.items()}, [], parent)
    if element.text:
        node.children.append(element.text)
    for child in element:
        if isinstance(child.tag, str):
            node.children.append(_build(child, node))
        if child.tail:
            node.children.append(child.tail)
    return node


def parse(text: str) -> Node:
    """The root's node; prefixes without a declaration are taken as they are."""
    text = text.lstrip("﻿ \t\r\n")
    try:
        return _build(ET.fromstring(text), None)
    except ET.ParseError as problem:
        if "unbound prefix" not in str(problem):
            raise
    loose = re.sub(r"(</?)[\w.-]+:", r"\1", text)
    loose = re.sub(r"(\s)(?!xmlns)[\w.-]+:([\w.-]+=)", r"\1\2", loose)
    return _build(ET.fromstring(loose), None)
