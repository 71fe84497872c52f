"""HTML to text over the events of the standard library's parser, as an Arrow UDF."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without readable text, and what block elements put in front of theirs.
DROPPED = frozenset(("nav", "footer", "script", "style", "noscript", "header"))
BREAKS = {"br": "\n", "p": "\n", "div": "\n", "section": "\n", "article": "\n", "tr": "\n", "li": "\n- ", "td": " | ", "th": " | "}
HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))


class Node:
    """An element: its children are nodes and strings."""

    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes=()):
        self.name, self.attributes, self.children = name, dict(attributes), []

    def nodes(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, name: str, test=lambda node: True):
        return next((n for n in self.nodes() if n.name == name and test(n)), None)

    def text(self) -> str:
        """All strings, each trimmed, joined."""
        return "".join(s.strip() for n in self.nodes_and_strings() if isinstance(s := n, str))

    def nodes_and_strings(self):
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.children))


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, attrs))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def readable(node: Node, parity: bool = False) -> str:
    """Text of an element with the marks of its blocks.

    ``parity`` glues inline strings and gives headings twice, as the original text extraction did;
    else inline strings keep their spaces and headings appear once.
    """
    out: list[str] = []
    todo: list = list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            text = x.strip() if parity else re.sub(r"\s+", " ", x)
            out.append(text)
            continue
        if x.name in DROPPED:
            continue
        if x.name in HEADINGS:
            heading = x.text()
            if heading:
                out.append(f"\n{HEADINGS[x.name]} {heading}\n")
            if not parity:
                continue
        out.append(BREAKS.get(x.name, ""))
        todo.extend(reversed(x.children))
    text = "".join(out)
    if not parity:
        text = re.sub(r" *\n *", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def json_strings(text: str, key: str):
    """The string values that a key has anywhere in a script, read by the JSON decoder."""
    name, decoder = json.dumps(key), json.JSONDecoder()
    at = text.find(name)
    while at >= 0:
        colon = text[at + len(name) :].lstrip()
        value = colon[1:].lstrip() if colon.startswith(":") else ""
        if value.startswith('"'):
            try:
                yield decoder.raw_decode(value)[0]
            except ValueError:
                return
        at = text.find(name, at + 1)


def title_of(root: Node) -> str:
    """The first h1, even an empty one, else the title element."""
    source = root.find("h1") or root.find("title")
    return source.text() if source else ""


def trail_of(root: Node, title: str) -> list[str]:
    """Link texts of the breadcrumb navigation; the title closes the trail unless it does already."""
    nav = root.find("nav", lambda n: "breadcrumb" in (n.attributes.get("class") or "").lower())
    links = [n.text() for n in nav.nodes() if n.name == "a"] if nav else []
    trail = [t for t in links if t]
    return [*trail, title] if title and trail[-1:] != [title] else trail


#: Where the text of a page is, first choice first, and how much of it is enough.
PLACES = (("section", lambda n: "id" in n.attributes), ("main", lambda n: True), ("article", lambda n: True))
ENOUGH = 100


def body_of(root: Node, parity: bool = False) -> str:
    """Readable text of the page's main element and, if that is little, of the body that a script carries."""
    places = (root.find(name, test) for name, test in PLACES)
    main = next((n for n in places if n), None)
    text = readable(main, parity) if main else ""
    if len(text.strip()) < ENOUGH:
        scripts = ("".join(c for c in n.children if isinstance(c, str)) for n in root.nodes() if n.name == "script")
        bodies = (readable(tree(next(json_strings(x, "body"), "")), parity) for x in scripts)
        carried = next((x for x in bodies if x), "")
        text = "\n\n".join(x for x in (text, carried) if x)
    return re.sub(r" {2,}", " ", re.sub(r"\n{3,}", "\n\n", text.strip()))


def page(html: str | None, parity: bool = False) -> dict:
    """Title, breadcrumbs, content and section path of a page; a null page counts as empty."""
    root = tree(html or "")
    title = title_of(root)
    trail = trail_of(root, title)
    return {"title": title, "breadcrumbs": trail, "content": body_of(root, parity), "section_path": " / ".join(trail) or title}


def extracted(html: Column, parity: bool = False) -> Column:
    """A struct (title, breadcrumbs, content, section_path)."""

    @F.pandas_udf("title string, breadcrumbs array<string>, content string, section_path string")
    def run(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            [page(x, parity) for x in column], columns=["title", "breadcrumbs", "content", "section_path"], dtype=object
        )

    return run(html)
