"""Text, title and links of captured pages: an Arrow UDF over a table of pages, one parse a page."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from difflib import unified_diff
from functools import cached_property
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

# Fixed values.
NOISE_TAGS = {"script", "style", "noscript", "nav", "footer"}
NOISE_CLASSES = {
    "breadcrumbs", "breadcrumb", "pagination", "social", "share", "dropfiles-content", "com-content-article__info", "article-info", "item-info", "tags", "mod-tagspopular", "eb-inst",
}
KEPT_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "ol", "ul", "li", "table", "thead", "tbody", "tr", "td", "th", "strong", "b", "em", "i", "sup", "sub", "br", "a", "div"}
LINE_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "tr"}
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: What these hold is no text.
SILENT_TAGS = {"script", "style", "template"}
#: An opening tag ends these that are open, up to the nearest of the others.
IMPLIED_END = {"p": ({"p"}, {"td", "th", "li", "article", "div", "main", "body"}), "li": ({"li", "p"}, {"ul", "ol"}), "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"})}
ENDS_PARAGRAPH = {"h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "div", "article", "main", "nav", "footer", "section"}
#: An end tag passes over open elements of at most its own rank; a higher one makes it a stray tag. Others have 100.
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220}


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None):
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.name not in SILENT_TAGS:
                stack.extend(reversed(node.children))

    def inside(self, test) -> bool:
        """Whether a node around this one passes a test."""
        at = self.parent
        while at is not None and not test(at):
            at = at.parent
        return at is not None

    def text(self) -> str:
        return " ".join(t for t in (x.strip() for x in self.texts()) if t)

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())


class _Tree(HTMLParser):
    """A tree with the ends of p, li, tr and cells that HTML lets authors leave out; stray and crossed end tags end no cell, row or table around them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", {}, None)

    def _close(self, names: set[str], stop: set[str]) -> None:
        node, last = self.at, None
        while node.parent is not None and node.name not in stop:
            if node.name in names:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IMPLIED_END:
            self._close(*IMPLIED_END[tag])
        elif tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"td", "th", "li", "article", "div", "main", "body"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node, rank = self.at, END_RANK.get(tag, 100)
        while node.parent is not None and node.name != tag:
            if END_RANK.get(node.name, 100) > rank:
                return
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def clean(value: str) -> str:
    """One space for each run of white space, none at the ends."""
    return " ".join(value.split())


def _first(root: Node, test) -> Node | None:
    return next((n for n in root.walk() if test(n)), None)


def _body(n: Node) -> bool:
    return "com-content-article__body" in n.classes()


def _item(n: Node) -> bool:
    return "item-page" in n.classes()


#: Where a page's content may stand, in order.
ROOTS = (
    _body,
    lambda n: _body(n) and n.inside(_item),
    lambda n: n.name == "article",
    lambda n: n.name == "article" and n.inside(lambda m: m.name == "main"),
    _item,
    lambda n: "com-content-article" in n.classes(),
    lambda n: n.name == "main",
    lambda n: n.attrs.get("id") == "content",
)


def content_root(root: Node) -> Node:
    """Of the candidates, in order, the first with most text; else body, else all."""
    found = [n for n in (_first(root, t) for t in ROOTS) if n is not None]
    return max(found, key=lambda n: len(n.text()), default=_first(root, lambda n: n.name == "body") or root)


def _strip(node: Node) -> Node:
    """A copy without noise; pages may be nested deeply, so nothing here recurs."""
    out = Node(node.name, node.attrs, None)
    todo = [(node, out)]
    while todo:
        source, copy = todo.pop()
        for c in source.children:
            if isinstance(c, str):
                copy.children.append(c)
            elif c.name not in NOISE_TAGS and not c.classes() & NOISE_CLASSES:
                copy.children.append(Node(c.name, c.attrs, copy))
                todo.append((c, copy.children[-1]))
    return out


def semantic_text(node: Node) -> str:
    lines = []
    for n in node.walk():
        if n.name in LINE_TAGS:
            cells = [c for c in n.children if isinstance(c, Node) and c.name in ("td", "th")]
            line = " | ".join(clean(c.text()) for c in cells) if n.name == "tr" else clean(n.text())
            if line:
                lines.append(line)
    return "\n".join(lines)


class _End(str):
    """A closing tag that waits for what is inside it."""


def normalized_html(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n if isinstance(n, _End) else escape(n, quote=False))
            continue
        if n.name in KEPT_TAGS:
            names = ("href",) if n.name == "a" else ("rowspan", "colspan") if n.name in ("td", "th") else ()
            out.append(f"<{n.name}" + "".join(f' {k}="{escape(n.attrs[k])}"' for k in names if n.attrs.get(k)) + ("/>" if n.name in VOID else ">"))
            if n.name not in VOID:
                todo.append(_End(f"</{n.name}>"))
        todo.extend(reversed(n.children))
    return "".join(out)


class Page:
    """A page's facts, each found when it is asked for."""

    def __init__(self, html: str | None, url: str | None):
        self.url, self.tree = url or "", parse(html)

    @cached_property
    def root(self) -> Node:
        return content_root(self.tree)

    @cached_property
    def bare(self) -> Node:
        return _strip(self.root)

    def title(self) -> str:
        found = _first(self.tree, lambda n: n.name == "h1") or _first(self.tree, lambda n: n.name == "title")
        return clean(found.text()) if found else ""

    def category(self) -> str:
        crumbs = [a for n in self.tree.walk() if n.classes() & {"breadcrumb", "breadcrumbs"} for a in n.walk() if a.name == "a"]
        return clean(crumbs[-1].text()) if crumbs else ""

    def root_tag(self) -> str:
        return self.root.name

    def root_chars(self) -> int:
        return len(self.root.text())

    def links(self) -> list[dict]:
        inside = {id(n) for n in self.root.walk() if n.name == "a"}
        every = [n for n in self.tree.walk() if n.name == "a" and "href" in n.attrs]
        return [{"url": urljoin(self.url, n.attrs["href"]), "title": clean(n.text()), "in_root": id(n) in inside} for n in every]

    def normalized_html(self) -> str:
        return normalized_html(self.bare)

    def semantic_text(self) -> str:
        return semantic_text(self.bare)


_LINKS = pa.list_(pa.struct([("url", pa.string()), ("title", pa.string()), ("in_root", pa.bool_())]))
#: Spark's and Arrow's type of each fact.
FACTS = {
    "title": ("string", pa.string()), "category": ("string", pa.string()), "root_tag": ("string", pa.string()), "root_chars": ("long", pa.int64()),
    "links": ("array<struct<url:string,title:string,in_root:boolean>>", _LINKS), "normalized_html": ("string", pa.string()), "semantic_text": ("string", pa.string()),
}
#: Pages parsed at once.
PAGES = 200


def page_facts(html: str | None, url: str | None, names: tuple[str, ...] = tuple(FACTS)) -> dict:
    page = Page(html, url)
    return {name: getattr(page, name)() for name in names}


def parse_pages(pages: DataFrame, *names: str) -> DataFrame:
    """page_id, url, the named facts of each page and `error`: a page that can't be parsed says why there, and has null facts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                b = batch.slice(at, PAGES)
                rows, errors = [], []
                for url, html in zip(b.column(1), b.column(2), strict=True):
                    try:
                        rows.append(page_facts(html.as_py(), url.as_py(), names))
                        errors.append(None)
                    except (ValueError, AssertionError) as e:
                        rows.append(dict.fromkeys(names))
                        errors.append(str(e)[:200])
                facts = [pa.array([r[n] for r in rows], FACTS[n][1]) for n in names]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *facts, pa.array(errors, pa.string())], names=["page_id", "url", *names, "error"])

    schema = "page_id long, url string, " + ", ".join(f"{n} {FACTS[n][0]}" for n in names) + ", error string"
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


#: Elements of an ODT's content that are a line each.
ODT_LINES = ("p", "h", "table-row")


def odt_text(data: bytes | None) -> str:
    """Paragraphs, headings and rows of an ODT's content, a line each in the order of their starts; empty for anything else.

    The content is read as a stream of starts, texts and ends: only the open lines are held.
    """
    reader, lines, open_ = expat.ParserCreate(namespace_separator=" "), [], []

    def start(name: str, _: dict) -> None:
        gap()
        if name.rpartition(" ")[2] in ODT_LINES:
            open_.append(len(lines))
            lines.append([])

    def end(name: str) -> None:
        if name.rpartition(" ")[2] in ODT_LINES:
            at = open_.pop()
            lines[at] = clean("".join(lines[at]))
        gap()

    def gap() -> None:
        for at in open_:
            lines[at].append(" ")

    def text(found: str) -> None:
        for at in open_:
            lines[at].append(found)

    reader.StartElementHandler, reader.EndElementHandler, reader.CharacterDataHandler = start, end, text
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z, z.open("content.xml") as content:
            reader.ParseFile(content)
    except (OSError, ValueError, KeyError, zipfile.BadZipFile, expat.ExpatError):
        return ""
    return "\n".join(x for x in lines if x)


def make_odt(text: str | None) -> bytes:
    """A minimal ODT with a paragraph for each line; its bytes depend on the text only."""
    ns = "urn:oasis:names:tc:opendocument:xmlns:"
    body = "".join(f"<text:p>{escape(x, quote=False)}</text:p>" for x in re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text or "").split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("content.xml"), f'<o:document-content xmlns:o="{ns}office:1.0" xmlns:text="{ns}text:1.0"><o:body>{body}</o:body></o:document-content>')
    return out.getvalue()


@F.pandas_udf(BinaryType())
def odt_of(text: pd.Series) -> pd.Series:
    return text.map(make_odt)


def is_odt(url: str, content_type: str) -> Column:
    """Whether an attachment is an ODT by its address or type, as extracted() has it."""
    return F.coalesce(F.lower(url).endswith(".odt"), F.lit(False)) | F.coalesce(F.contains(F.lower(content_type), F.lit("opendocument")), F.lit(False))


@F.pandas_udf(StringType())
def extracted(data: pd.Series, content_type: pd.Series, url: pd.Series) -> pd.Series:
    """The text of attachments that are ODTs by suffix or type; of others none."""
    odt = url.str.lower().str.endswith(".odt") | content_type.str.lower().str.contains("opendocument", regex=False)
    return pd.Series([odt_text(d) if o else "" for d, o in zip(data, odt, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def diff_of(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series(["\n".join(unified_diff(a.splitlines(), b.splitlines(), "old", "new", n=3, lineterm=""))[:12000] for a, b in zip(old, new, strict=True)])
