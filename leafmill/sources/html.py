"""HTML pages as ordered, typed passages.

A tolerant tree is built with the standard library's tokenizer: void elements close themselves,
block starts close an open paragraph, list items and table cells close their open siblings, and
ends that match nothing are ignored. Passages are then read off in document order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
REMOVED = frozenset("script style noscript nav form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXTS = HEADINGS | {"p", "blockquote", "li"}
SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
COMMENT_CLASSES = {"comment-metadata", "comment-content"}
READABLE = TEXTS | {"pre", "table", "img"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)

    def inside(self, tag: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def comment(self) -> bool:
        return bool(COMMENT_CLASSES & set((self.attrs.get("class") or "").split()))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag in CLOSES_P:
            self._close({"p"}, {"table", "td", "th", "li", "blockquote", "button"} if tag != "p" else {"table", "td", "th", "button"})
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    root = builder.root
    for node in list(root.walk()):
        if node.tag in REMOVED and node.parent is not None:
            node.parent.children = [c for c in node.parent.children if c is not node]
    return root


def collapse(text: str) -> str:
    return " ".join(text.split())


def _resolve(link: str | None, base: str | None, schemes: set[str]) -> str | None:
    try:
        full = urljoin(base or "", (link or "").strip())
        return full if urlsplit(full).scheme.lower() in schemes else None
    except ValueError:
        return None


def _number(value: str | None) -> float | None:
    found = re.match(r"\s*\d+(?:\.\d+)?", value or "")
    return float(found.group()) if found else None


def _image(node: Node, base: str | None) -> dict | None:
    raw = node.attrs.get("src") or node.attrs.get("data-src") or node.attrs.get("data-original")
    sizes = [_number(node.attrs.get(k)) for k in ("width", "height")]
    if not raw or any(s is not None and s <= 2 for s in sizes):
        return None
    src = _resolve(raw, base, {"http", "https", "data", "blob"})
    if src is None:
        return None
    alt = collapse(node.attrs.get("alt") or node.attrs.get("title") or "")
    whole = all(s is not None and s > 0 for s in sizes)
    return {"type": "image", "text": f"Picture of {alt}" if alt else "", "image": {"src": src, "alt": alt, "width": sizes[0] if whole else None, "height": sizes[1] if whole else None}}


def _code(node: Node) -> dict | None:
    code = next((c for c in node.walk() if c.tag == "code"), None)
    text = (code.text() if code is not None else "") or node.text()
    if not text.strip():
        return None
    language = ""
    if code is not None:
        named = re.search(r"(?:^|\s)language-([\w-]+)", code.attrs.get("class") or "")
        language = code.attrs.get("data-lang") or (named.group(1) if named else "")
    return {"type": "code", "text": text, "language": language}


def _table(node: Node) -> dict | None:
    rows = []
    for row in (r for r in node.walk() if r.tag == "tr"):
        cells = [{"text": t, "header": c.tag == "th"} for c in row.children if isinstance(c, Node) and c.tag in ("td", "th") and (t := collapse(c.text()))]
        if cells:
            rows.append({"cells": cells})
    return {"type": "table", "text": "", "rows": rows} if rows else None


def _text(node: Node, base: str | None) -> dict | None:
    inner = None if node.tag not in ("blockquote", "li") and not node.comment() else {n.tag for n in node.walk()}
    if node.comment() and inner & READABLE:
        return None
    if node.inside("pre") or node.inside("table"):
        return None
    if node.tag == "blockquote" and (inner & (READABLE - {"blockquote"}) or any(n.comment() for n in node.walk())):
        return None
    if node.tag == "li" and inner & {"p", "blockquote"}:
        return None
    text = collapse(re.sub(r"\s+([,.;:!?])", r"\1", node.text()))
    if not text:
        return None
    links = []
    for a in node.walk():
        if a.tag == "a" and "href" in a.attrs:
            label, href = collapse(a.text()), _resolve(a.attrs["href"], base, {"http", "https", "mailto"})
            if label and href:
                links.append({"label": label, "href": href})
    return {"type": "heading" if node.tag in HEADINGS else "paragraph", "text": text, "links": links}


def passages(html: str | None, base: str | None) -> list[dict]:
    """The passages of a page, in document order."""
    out = []
    for node in tree(html).walk():
        if node.tag == "img":
            found = _image(node, base)
        elif node.tag == "pre":
            found = _code(node)
        elif node.tag == "table":
            found = _table(node)
        elif node.tag in TEXTS or node.comment():
            found = _text(node, base)
        else:
            continue
        if found is not None:
            out.append(found)
    return out


CELL = pa.struct([("text", pa.string()), ("header", pa.bool_())])
ARROW = [
    ("pos", pa.int32()), ("type", pa.string()), ("text", pa.string()), ("language", pa.string()),
    ("links", pa.list_(pa.struct([("label", pa.string()), ("href", pa.string())]))),
    ("image", pa.struct([("src", pa.string()), ("alt", pa.string()), ("width", pa.float64()), ("height", pa.float64())])),
    ("table_rows", pa.list_(pa.struct([("cells", pa.list_(CELL))]))),
]
SCHEMA = "pos int, type string, text string, language string, links array<struct<label:string,href:string>>, image struct<src:string,alt:string,width:double,height:double>, table_rows array<struct<cells:array<struct<text:string,header:boolean>>>>"


def html_passages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per passage: the page's id, pos from 0, and the passage's fields."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                places, rows = [], []
                for k, (url, html) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for pos, p in enumerate(passages(html, url)):
                        places.append(k)
                        rows.append((pos, p["type"], p["text"], p.get("language"), p.get("links") or None, p.get("image"), p.get("rows")))
                ids = part.column(0).take(pa.array(places, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(ARROW))], names=["_id", *(n for n, _ in ARROW)])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def page_title(html: str | None) -> str:
    found = next((n for n in tree(html).walk() if n.tag == "title"), None)
    return collapse(found.text()) if found is not None else ""
