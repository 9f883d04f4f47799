"""Structure of marked-up statutes and regulations, read with the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Class names of the page templates (fixed values).
STRUCTURAL = {"subsection", "paragraph", "subparagraph", "clause", "subclause", "item", "subitem"}
ANNOTATION = {"note", "notes", "sourceCredit"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SECTIONS = "filename string, seq int, path array<struct<role:string,label:string>>, text string"
PARAGRAPHS = "filename string, seq int, level int, label string, text string"


class Node:
    """An element: tag, attributes and children (elements or strings)."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    @property
    def role(self) -> str:
        return self.classes[0] if self.classes else ""

    def walk(self):
        """Elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: Node | None = None) -> str:
        """The trimmed strings below, joined by blanks."""
        parts, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    parts.append(node.strip())
            elif node is not skip:
                stack.extend(reversed(node.children))
        return " ".join(parts)


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag == "p" and self.open[-1].tag == "p":  # paragraphs end each other
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):  # noqa: ANN001, ANN201
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree.root


def statute_sections(html: str) -> list[tuple[list[tuple[str, str]], str]]:
    """(path, own text) of every provision with text of its own, in document order."""
    top = next((n for n in parse(html).walk() if n.tag == "div" and "section" in n.classes), None)
    if top is None:
        raise ValueError("no section root")
    out, stack = [], [(top, [])]
    while stack:
        node, path = stack.pop()
        divs = [c for c in node.children if isinstance(c, Node) and c.tag == "div"]
        own = [d.text() for d in divs if d.role not in STRUCTURAL and d.role not in ANNOTATION]
        own = " ".join(t for t in own if t).strip()
        if own:
            out.append((path, own))
        below = []
        for d in divs:
            if d.role in STRUCTURAL:
                num = next((n for n in d.walk() if n.tag == "span" and "num" in n.classes), None)
                below.append((d, [*path, (d.role, num.attrs.get("value", "?") if num else "?")]))
        stack.extend(reversed(below))
    return out


def flat_paragraphs(html: str) -> list[tuple[int, str | None, str]]:
    """(level, label or None, text without the label) of every ``psection-N`` paragraph."""
    out = []
    for p in parse(html).walk():
        level = next((int(c.split("-")[1]) for c in p.classes if c.startswith("psection-")), None) if p.tag == "p" else None
        if level is None:
            continue
        mark = next((n for n in p.walk() if n.tag == "span" and "enumxml" in n.classes), None)
        label = "".join(mark.text().split(" ")).strip("()") if mark else None
        out.append((level, label, p.text(skip=mark)))
    return out


def parse_statutes(pages: DataFrame) -> DataFrame:
    """Sections of (filename, html); a page without a section root fails the query, null pages give nothing."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for name, html in zip(pdf["filename"], pdf["html"]):
                if html is not None:
                    rows += [(name, i, [{"role": r, "label": x} for r, x in path], text) for i, (path, text) in enumerate(statute_sections(html))]
            yield pd.DataFrame(rows, columns=["filename", "seq", "path", "text"])

    return pages.select("filename", "html").mapInPandas(run, SECTIONS)


def parse_regulations(pages: DataFrame) -> DataFrame:
    """Flat paragraphs of (filename, html), for ``ingest.level_paths``."""

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = [(n, i, *p) for n, h in zip(pdf["filename"], pdf["html"]) if h is not None for i, p in enumerate(flat_paragraphs(h))]
            yield pd.DataFrame(rows, columns=["filename", "seq", "level", "label", "text"])

    return pages.select("filename", "html").mapInPandas(run, PARAGRAPHS)
