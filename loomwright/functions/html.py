"""HTML to Markdown on the standard library's parser: title, author, language, links, content, chrome, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse, urlunparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import spread

# Elements that are never content, and parts of class and id names of navigation and chrome.
CHROME_TAGS = frozenset("script style noscript nav header footer aside form button iframe svg template dialog".split())
CHROME_NAMES = re.compile(
    "nav|menu|sidebar|footer|header|banner|cookie|consent|advert|promo|social|share|comment|related|recommend|newsletter|subscribe|breadcrumb|pagination|toc|skip-link|screen-reader",
    re.I,
)
# Containers that hold the article, best first; (tag, attribute, value).
CONTAINERS = [
    ("article", None, None), ("main", None, None), (None, "role", "main"), (None, "id", "content"), (None, "class", "content"), (None, "id", "main"),
    (None, "class", "post"), (None, "class", "entry-content"), (None, "class", "markdown-body"), (None, "class", "article-body"), (None, "class", "documentation"),
]
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ASSET = re.compile(r"\.(zip|tar|gz|png|jpe?g|gif|svg|css|js|ico|woff2?|mp4|mp3)$", re.I)
LEAST_CONTENT = 200


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node | str]:
        """All descendants in page order; deep trees need no recursion."""
        todo = [iter(self.children)]
        while todo:
            for child in todo[-1]:
                yield child
                if isinstance(child, Node):
                    todo.append(iter(child.children))
                    break
            else:
                todo.pop()

    def find(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and x.tag in tags)

    def text(self, joint: str = "") -> str:
        return joint.join(s for x in self.walk() if isinstance(x, str) and (s := x.strip()))

    def raw(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def markup(self) -> int:
        """About how long the element is as markup."""
        return sum(len(x) if isinstance(x, str) else 5 + 2 * len(x.tag) + sum(len(k) + len(v) + 4 for k, v in x.attrs.items()) for x in self.walk()) + 5 + 2 * len(self.tag)


class _Builder(HTMLParser):
    CLOSERS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
    ENDS_P = frozenset("p div ul ol table pre blockquote h1 h2 h3 h4 h5 h6 section article form hr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.ENDS_P and any(n.tag == "p" for n in self.open[-3:]):
            self._close("p")
        for name in self.CLOSERS.get(tag, ()):
            if self.open[-1].tag == name:
                self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        self._close(tag)

    def _close(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def canonical(url: str) -> str:
    p = urlparse(url)
    return urlunparse(p._replace(path=p.path.rstrip("/") or "/", fragment=""))


def meta(root: Node, *names: str) -> str | None:
    for name in names:
        for m in root.find("meta"):
            if name in (m.attrs.get("property"), m.attrs.get("name")) and m.attrs.get("content"):
                return m.attrs["content"].strip()
    return None


def title(root: Node) -> str | None:
    for h in root.find("h1"):
        if h.text():
            return h.text()
        break
    if found := meta(root, "og:title", "twitter:title"):
        return found
    for t in root.find("title"):
        if t.text():
            return re.split(r"\s+[|—–-]\s+", t.text())[0]
    return None


def author(root: Node) -> str | None:
    found = meta(root, "author", "article:author")
    return found[:200] if found else None


def language(root: Node) -> str | None:
    for h in root.find("html"):
        return h.attrs["lang"].split("-")[0] if h.attrs.get("lang") else None
    return None


def links(root: Node, base: str) -> list[str]:
    """Absolute http links in order, each once, without downloads of assets."""
    out: dict[str, None] = {}
    for a in root.find("a"):
        href = a.attrs.get("href", "").strip()
        if href and not href.startswith(("#", "mailto:", "tel:", "javascript:")):
            url = canonical(urljoin(base, href))
            if url.startswith(("http://", "https://")) and not ASSET.search(url):
                out[url] = None
    return list(out)


def content(root: Node) -> Node:
    """The element that most likely holds the article: a known container, else the densest block."""
    for tag, attr, value in CONTAINERS:
        for x in root.walk():
            if isinstance(x, Node) and (x.tag == tag if tag else value in x.attrs.get(attr, "").split()):
                if len(x.text()) > LEAST_CONTENT:
                    return x
                break
    best, top = None, 0.0
    for x in root.find("div", "section", "td"):
        text = x.text(" ")
        if len(text) >= LEAST_CONTENT:
            linked = sum(len(a.text()) for a in x.find("a")) / len(text)
            score = len(text) ** 1.5 / x.markup() * (1 - min(linked, 0.9))
            if score > top:
                best, top = x, score
    return best or next(root.find("body"), root)


def without_chrome(node: Node) -> Node:
    """A copy without navigation, chrome and hidden parts."""
    out = Node(node.tag, node.attrs)
    todo = [(node, out)]
    while todo:
        src, dst = todo.pop()
        for x in src.children:
            if isinstance(x, str):
                dst.children.append(x)
            elif x.tag not in CHROME_TAGS and not CHROME_NAMES.search(f"{x.attrs.get('class', '')} {x.attrs.get('id', '')}") and x.attrs.get("aria-hidden") != "true":
                copy = Node(x.tag, x.attrs)
                dst.children.append(copy)
                todo.append((x, copy))
    return out


def _inline(node: Node) -> str:
    """Text of an element with code in backticks."""
    parts: list[str] = []

    def visit(n: Node) -> None:
        for x in n.children:
            if isinstance(x, str):
                parts.append(x.strip())
            elif x.tag == "code":
                parts.append(f"`{x.text()}`" if x.text() else "")
            else:
                visit(x)

    visit(node)
    return re.sub(r"\s{2,}", " ", " ".join(filter(None, parts))).strip()


def _table(node: Node) -> str:
    rows = [[c.text(" ") for c in tr.find("th", "td")] for tr in node.find("tr")]
    rows = [r for r in rows if r]
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "|" + "---|" * width, *lines[1:]]) if rows else ""


def markdown(node: Node) -> str:
    """The element as Markdown: headings, paragraphs, lists, code, tables, quotes."""
    out: list[str] = []

    def render(x: Node | str, depth: int) -> None:
        if isinstance(x, str):
            out.append(x.strip())
        elif re.fullmatch("h[1-6]", x.tag):
            out.append(f"\n{'#' * int(x.tag[1])} {x.text(' ')}\n" if x.text() else "")
        elif x.tag == "p":
            out.append(f"\n{_inline(x)}\n" if _inline(x) else "")
        elif x.tag == "pre":
            out.append(f"\n```\n{x.raw().rstrip()}\n```\n" if x.raw().strip() else "")
        elif x.tag in ("ul", "ol"):
            items = [_inline(c) for c in x.children if isinstance(c, Node) and c.tag == "li"]
            out.extend(f"{'  ' * depth}{f'{i}.' if x.tag == 'ol' else '-'} {t}" for i, t in enumerate(items, 1) if t)
            out.append("\n")
        elif x.tag == "table":
            out.append(f"\n{_table(x)}\n" if _table(x) else "")
        elif x.tag == "blockquote":
            out.append(f"\n> {x.text(' ')}\n" if x.text() else "")
        elif x.tag not in ("br", "hr"):
            for c in x.children:
                render(c, depth + (x.tag == "li"))

    render(node, 0)
    text = "\n".join(s for s in out if s)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", text)).strip()


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """url, title, author, language, links and Markdown text of each page; ``error`` where fewer than 80 characters
    are left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, page in zip(b["url"], b["html"], strict=True):
                root = parse(page)
                text = markdown(without_chrome(content(root)))
                rows.append((url, title(root), author(root), language(root), links(root, url or ""), text, "too little text" if len(text) < 80 else None))
            yield pd.DataFrame(rows, columns=["url", "title", "author", "language", "links", "text", "error"])

    return spread(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))).mapInPandas(run, "url string, title string, author string, language string, links array<string>, text string, error string")
