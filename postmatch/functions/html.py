"""Element list of a page and the few selector forms the page rules use."""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# An opening tag on the left ends open elements of the kinds on the right, up to a scope border.
_BLOCKS = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul li dd dt"
).split()
CLOSES: dict[str, set[str]] = {tag: {"p"} for tag in _BLOCKS}
CLOSES["li"] = {"p", "li"}
CLOSES["dd"] = CLOSES["dt"] = {"p", "dd", "dt"}
CLOSES["option"] = {"option"}
CLOSES["a"] = {"a"}
CLOSES["td"] = CLOSES["th"] = {"p", "td", "th"}
CLOSES["tr"] = {"p", "td", "th", "tr"}
BORDER = {"li": {"ul", "ol"}, "dd": {"dl"}, "dt": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
P_BORDER = {"button", "table", "td", "th", "caption"}


class Node:
    __slots__ = ("attrs", "classes", "end", "parent", "parts", "start", "tag")

    def __init__(self, tag, attrs, parent):
        self.tag = tag
        self.attrs = attrs
        self.classes = frozenset((attrs.get("class") or "").split())
        self.parent = parent
        self.parts = []  # texts and child nodes, in order
        self.start = self.end = 0  # positions of the element and just past its last descendant


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[Node] = []
        self.open: list[Node] = []

    def close_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            node.end = len(self.nodes)
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        for kind in CLOSES.get(tag, ()):
            border = P_BORDER if kind == "p" else BORDER.get(kind, set())
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth].tag in border:
                    break
                if self.open[depth].tag == kind:
                    self.close_to(depth)
                    break
        values: dict[str, str] = {}
        for name, value in attrs:
            values.setdefault(name, value or "")
        node = Node(tag, values, self.open[-1] if self.open else None)
        if node.parent:
            node.parent.parts.append(node)
        node.start = len(self.nodes)
        self.nodes.append(node)
        node.end = len(self.nodes)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                self.close_to(depth)
                return

    def handle_data(self, data):
        if self.open:
            self.open[-1].parts.append(data)


def load(html: str) -> list[Node]:
    """All elements in document order."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    builder.close_to(0)
    return builder.nodes


def text_of(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            stack.extend(reversed(part.parts))
    return "".join(out)


_SIMPLE = re.compile(r'\.([\w-]+)|\[([\w-]+)(?:(\*?=)"?([^"\]]*)"?)?\]|([\w-]+)')


def parse_selector(selector: str) -> list[list[tuple]]:
    """Alternatives of a comma list; each is a list of (tag, classes, attribute tests), outermost first."""
    alternatives = []
    for alternative in selector.split(","):
        chain = []
        for compound in alternative.split():
            tag, classes, tests = None, set(), []
            for cls, attr, op, value, name in _SIMPLE.findall(compound):
                if cls:
                    classes.add(cls)
                elif attr:
                    tests.append((attr, op, value))
                else:
                    tag = name
            chain.append((tag, frozenset(classes), tuple(tests)))
        alternatives.append(chain)
    return alternatives


def _simple(node: Node, compound: tuple) -> bool:
    tag, classes, tests = compound
    if tag and node.tag != tag or not classes <= node.classes:
        return False
    for attr, op, value in tests:
        actual = node.attrs.get(attr)
        if actual is None or op == "=" and actual != value or op == "*=" and value not in actual:
            return False
    return True


def matches(node: Node, selector: list[list[tuple]]) -> bool:
    for chain in selector:
        if not _simple(node, chain[-1]):
            continue
        rest, above = len(chain) - 1, node.parent
        while rest and above is not None:
            if _simple(above, chain[rest - 1]):
                rest -= 1
            above = above.parent
        if not rest:
            return True
    return False


def first_match(page: list[Node], card: Node, selector: list[list[tuple]]) -> Node | None:
    """First descendant of ``card`` that matches, in document order."""
    for position in range(card.start + 1, card.end):
        if matches(page[position], selector):
            return page[position]
    return None
