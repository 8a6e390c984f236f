"""Text out of HTML: native patterns for the plain cases, the standard library's parser where the tree matters."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import strip

DROPPED = ("script", "style", "nav", "footer", "header")
#: Where pages keep their content, in order of preference.
CONTENT_SELECTORS = (".content", ".main-content", "#content", ".page-content", ".entry-content", "main", "article")
COMBINED_SELECTORS = (".content", ".main-content", "#content", "main", "article")
LISTING_SELECTORS = (".faculty-card", ".faculty-profile", ".faculty-member", ".staff-card", ".team-member", ".professor-card", ".faculty", ".staff", ".team")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def title(html: Column, default: str = "Untitled") -> Column:
    """The stripped title, else the first heading, else the default; blank ones are passed over."""
    one = lambda tag: F.nullif(strip(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))), F.lit(""))
    return F.coalesce(one("title"), one("h1"), F.lit(default))


def plain(markup: Column) -> Column:
    """Markup without tags and comments, entities of the basic set decoded, whitespace collapsed."""
    x = F.regexp_replace(F.regexp_replace(markup, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def body_text(html: Column) -> Column:
    """Text of the body without scripts, styles, navigation, footers and headers."""
    x = html
    for tag in DROPPED:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", " ")
    return plain(F.coalesce(F.nullif(F.regexp_extract(x, r"(?is)<body\b[^>]*>(.*)</body>", 1), F.lit("")), x))


def element_text(html: Column, tag: str) -> Column:
    """Text of the first element of a kind, null if there is none."""
    return F.nullif(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)), F.lit(""))


def first_substantial(candidates: list[Column], least: int = 100) -> Column:
    """The first candidate of more than ``least`` characters; shorter ones are passed over."""
    return F.coalesce(*[F.when(F.length(c) > least, c) for c in candidates])


class _Node:
    __slots__ = ("tag", "attrs", "children", "up")

    def __init__(self, tag: str, attrs: dict, up) -> None:
        self.tag, self.attrs, self.children, self.up = tag, attrs, [], up

    def walk(self):
        """This node and all under it, in the order of the document, without recursion."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, _Node))

    def texts(self, dropped: tuple[str, ...] = ("script", "style")):
        stack: list = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                if node.strip():
                    yield node.strip()
            elif node is self or node.tag not in dropped:
                stack.extend(reversed(node.children))


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        if tag not in _VOID:
            self.here = node

    def handle_endtag(self, tag):
        node = self.here
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.here = node.up

    def handle_data(self, data):
        self.here.children.append(data)


def _matches(node: _Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in node.attrs.get("class", "").split()
    if selector[0] == "#":
        return node.attrs.get("id") == selector[1:]
    return node.tag == selector


def parse_page(html: str | None, content: tuple[str, ...] = CONTENT_SELECTORS, repeated: tuple[str, ...] = LISTING_SELECTORS, least: int = 100) -> dict:
    """Content by selector order (else the body without dropped parts), tables as rows, repeated elements of one kind."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    nodes = list(tree.root.walk())
    text, method = None, None
    for s in content:
        hit = next((n for n in nodes if _matches(n, s)), None)
        if hit is not None:
            t = "\n".join(hit.texts())
            if len(t) > least:
                text, method = t, s
                break
    if text is None:
        body = next((n for n in nodes if n.tag == "body"), tree.root)
        text, method = "\n".join(body.texts(DROPPED)), "body"
    tables = []
    for t in (n for n in nodes if n.tag == "table"):
        rows = [" | ".join(" ".join(c.texts()) for c in r.walk() if c.tag in ("td", "th")) for r in t.walk() if r.tag == "tr"]
        tables.append("TABLE: " + "\n".join(r for r in rows if r))
    # Of all content places the first one in the document, however short.
    place = next((n for n in nodes if any(_matches(n, s) for s in COMBINED_SELECTORS)), None)
    items: list[str] = []
    for s in repeated:
        found = [n for n in nodes if _matches(n, s)]
        if found:
            items = [x for x in (" ".join(n.texts()) for n in found) if len(x) > 10]
            break
    return {"text": text, "method": method, "tables": tables, "items": items, "first": None if place is None else "\n".join(place.texts())}


PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("method", T.StringType()), T.StructField("tables", T.ArrayType(T.StringType())), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("first", T.StringType())])


def page_content(parts: Column) -> Column:
    """A page's text with its tables after it, a blank line between."""
    return F.concat_ws("\n\n", F.nullif(parts["text"], F.lit("")), F.nullif(F.array_join(parts["tables"], "\n\n"), F.lit("")))


def _page_udf():
    @F.pandas_udf(PAGE)
    def page(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([parse_page(h) for h in s], columns=["text", "method", "tables", "items", "first"])

    return page


def page_parts(html: Column) -> Column:
    """Struct of ``parse_page``, by the parser; for pages whose tree matters."""
    return _page_udf()(html)
