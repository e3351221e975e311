"""HTML extraction by tag-path ratios.

A page is cut into blocks at block-level tags; each block has the path of block-level tags (with class and id)
from the root. Per path, text length, punctuation and the share of text in links are summed over its blocks.
Text per block and punctuation per block are smoothed over the blocks in page order, weighted by how much of their
paths two blocks share, so that a path among text of its own kind gains and one that only stands beside it does
not, and fused by multiplication; links weaken the result. Every path of the page at or over ``LEAST`` deviations
is content, and the element that holds it - an article or main element, else what holds its last block - is a
container. What else stands in a container (or in the element that holds all of them, if that is less than the body)
belongs to it, unless it is links on a path below the threshold; where the containers have only the body in common, headings
outside them stay too; so does the h1 before an article that does not begin with a heading. A header outside article and main belongs to the page unless it is inside a container.

Paths through elements that are never article text (navigation, footer, aside, forms, dialogs, hidden elements, and
elements whose class or id names what the contract leaves out) take no part.

Tags are read in one pass: values of attributes are never searched for names, self-closing foreign elements end at
once, and an element that is never closed (raw text, a comment, a control, a link) ends where the next tag or block
begins, so that no mistake loses the rest of a page.

Runs in Arrow batches inside the tasks: no shuffle. Defined results: null, empty or text-less pages give an
empty text; text outside all elements counts as body text; unclosed, crossed or stray tags never fail; rows
give one row each; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.wordhash import small_batches

# HTML element names by role.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CONTROLS = frozenset("button select datalist svg".split())  # a block that opens inside ends them
MEDIA = frozenset("template canvas audio video".split())
NEVER = frozenset("nav footer aside form menu dialog fieldset head search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li ul ol dl dd dt pre blockquote td th tr tbody thead tfoot table caption address figcaption".split())
# What closes when an element of this name opens, and what stops the search for it.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table menu".split())
# Names of what is not the article, as a class or id or as its head, and what may follow them.
BAD_NAMES = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer footnav gdpr menu masthead modal nav navbar navigation newsletter notice notices pager pagination popup promo related replies respond sidebar skip social share sharing sponsor sponsored subscribe toc toolbar topbar widget widgets".split())
FOLLOWERS = frozenset("area bar block body box container content form group holder inner item left link links list outer panel right section slot thread top bottom unit wrap wrapper".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NAME_PARTS = re.compile(r"[A-Za-z]+|\d+")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<!--|<[!?][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
ANCHOR = re.compile(r"<(/?)a[\s>]", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，；？！¿¡]")
NEAR = (-2, -1, 0, 1, 2)
LEAST = 0.1
Path = tuple[str, ...]


@dataclass(frozen=True, slots=True)
class Block:
    path: Path
    text: str
    linked: int  # characters in links
    usable: bool  # no element on the path is never article text
    header: Path | None  # the path above the outermost header that is not inside article or main


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case with their values, the first of each; a value is never searched for names."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return out


def names_boilerplate(names: str) -> bool:
    """Whether a class or id is a bad name, ends in one, or is one with what usually follows or a number."""
    for token in names.split():
        parts = [x.lower() for x in NAME_PARTS.findall(token)]
        while len(parts) > 1 and (parts[-1].isdigit() or parts[-1] in FOLLOWERS):
            parts.pop()
        if parts and parts[-1] in BAD_NAMES:
            return True
    return False


def excluded(name: str, given: dict[str, str]) -> bool:
    if name in NEVER or "hidden" in given or given.get("aria-hidden", "").lower() == "true" or given.get("role", "").lower() in BAD_ROLES:
        return True
    return name not in ("html", "body", "article", "main") and any(names_boilerplate(given[x]) for x in ("class", "id") if x in given)


class _Reader:
    """The open elements and the blocks so far."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, str, bool]] = []  # name, path element, whether excluded
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked, self.in_link = 0, False

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1][0] in CONTROLS:
            return
        text = html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if self.in_link:
            self.linked += len(text)

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            inside = next((k for k, x in enumerate(self.stack) if x[0] in ("article", "main")), len(self.stack))
            header = next((k for k, x in enumerate(self.stack[:inside]) if x[0] == "header"), None)
            path = tuple(x[1] for x in self.stack)
            self.blocks.append(Block(path, text, self.linked, not any(x[2] for x in self.stack), None if header is None else path[:header]))
        self.parts.clear()
        self.linked = 0

    def close(self, name: str) -> None:
        k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name), None)
        if k is not None:
            del self.stack[k:]

    def open(self, name: str, raw: str) -> None:
        while self.stack and self.stack[-1][0] in CONTROLS:
            self.stack.pop()
        if self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        if shut := CLOSES.get(name):
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in shut:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in SCOPES:
                    break
        if name == "body":
            self.close("head")
        given = attributes(raw) if raw else {}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        self.stack.append((name, f"{name}.{names}" if names else name, excluded(name, given)))


def _same_length_lower(page: str) -> str:
    low = page.lower()
    return low if len(low) == len(page) else page


def blocks(page: str) -> list[Block]:
    """The blocks with text, in page order."""
    reader, at = _Reader(), 0
    low = ""
    open_ended: set[str] = set()  # what has no end from here on, so that it is looked for once

    def ends(mark: str, text: str) -> int:
        found = -1 if mark in open_ended else text.find(mark, at)
        if found < 0:
            open_ended.add(mark)
        return found

    while m := TAG.search(page, at):
        if m.start() > at:
            reader.text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0] == "<!--":
                end = ends("-->", page)
                at = end + 3 if end >= 0 else page.find(">", at) + 1 or len(page)
            continue
        close, name, raw = m[1], m[2].lower(), m[3]
        if name == "a":
            after = None if close or "href" not in raw.lower() else ANCHOR.search(page, at)
            reader.in_link = after is not None and after[1] == "/"
        elif name == "br":
            reader.flush()
        elif name in RAW or name in MEDIA:
            if not close and not raw.rstrip().endswith("/"):
                low = low or _same_length_lower(page)
                end = ends(f"</{name}", low)
                # never closed: what it holds ends at the next tag
                at = end if end >= 0 else (page.find("<", at) + 1 or len(page) + 1) - 1
        elif name in CONTROLS:
            if close:
                if any(x[0] == name for x in reader.stack):
                    reader.close(name)
            elif not raw.rstrip().endswith("/"):
                while reader.stack and reader.stack[-1][0] in CONTROLS - {"svg"}:
                    reader.stack.pop()
                reader.stack.append((name, name, True))
        elif name in BLOCK:
            reader.flush()
            if close:
                reader.close(name)
            elif name not in VOID:
                reader.open(name, raw)
    reader.text(page[at:])
    reader.flush()
    return reader.blocks


def _alike(a: Path, b: Path) -> float:
    """The share of their elements that two paths have in common, from the root."""
    if a == b:
        return 1.0
    n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return 2 * n / max(1, len(a) + len(b))


def path_ratios(found: list[Block]) -> tuple[dict[Path, float], float, dict[Path, float]]:
    """(each path's fused ratio, the threshold, the share of each path's text in links) of usable blocks."""
    sums: dict[Path, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.path, [0, 0, 0, 0])
        for k, v in enumerate((len(b.text), len(PUNCTUATION.findall(b.text)), min(b.linked, len(b.text)), 1)):
            s[k] += v
    fused: dict[Path, float] = dict.fromkeys(sums, 0.0)
    for i, b in enumerate(found):
        weight = text = marks = 0.0
        for d in NEAR:
            if 0 <= i + d < len(found):
                other = found[i + d].path
                w = math.exp(-d * d / 2) * _alike(b.path, other) ** 2
                s = sums[other]
                weight, text, marks = weight + w, text + w * s[0] / s[3], marks + w * s[1] / s[3]
        chars, _, linked, n = sums[b.path]
        weight = weight or 1.0  # text outside all elements is like nothing else
        fused[b.path] += text / weight * (1 + marks / weight) * (1 - linked / chars) / n
    mean = sum(fused.values()) / len(fused)
    limit = LEAST * math.sqrt(sum((v - mean) ** 2 for v in fused.values()) / len(fused))
    return fused, limit, {p: s[2] / s[0] for p, s in sums.items()}


def under(path: Path, holder: Path) -> bool:
    return path[: len(holder)] == holder


def _common(paths: set[Path]) -> Path:
    """What all paths begin with."""
    low, high = min(paths), max(paths)
    n = next((k for k, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
    return low[:n]


def container(path: Path) -> Path:
    """The outermost article or main element on a path, else what holds its last block."""
    for k, x in enumerate(path):
        if x.split(".")[0] in ("article", "main"):
            return path[: k + 1]
    while path and path[-1].split(".")[0] in LEAVES:
        path = path[:-1]
    return path


def extract(page: str | None) -> str:
    """The main text of a page, one line per block."""
    found = [b for b in blocks(page or "") if b.usable]
    scored = [b for b in found if b.header is None]
    if not scored:
        return "\n".join(b.text for b in found)
    fused, limit, linked = path_ratios(scored)
    best = max(fused, key=lambda p: (fused[p] * sum(len(b.text) for b in scored if b.path == p), -len(p)))
    over = {p for p in fused if fused[p] >= limit and linked[p] < 0.5} | {best}
    holders = {container(p) for p in over}
    root = _common(holders)
    bare = {x.split(".")[0] for x in root} <= {"html", "body"}
    title = any(_is_heading(b, {"h1"}) for b in scored)

    def kept(b: Block) -> bool:
        inside = any(under(b.path, h) for h in holders)
        heading = _is_heading(b, HEADINGS)
        if b.header is not None:
            own = {x.split(".")[0] for x in b.header} - {"html", "body"}
            return bool(own) and (any(under(b.header, h) for h in holders) or (heading and not title and not bare and under(b.header, root)))
        if b.path in over:
            return True
        if 2 * b.linked >= len(b.text):
            return fused[b.path] >= limit and inside
        return inside or (under(b.path, root) and (heading or not bare))

    keep = [i for i, b in enumerate(found) if kept(b)]
    if keep and not _is_heading(found[keep[0]], HEADINGS):
        # a title in a block of its own before the article
        keep = [*[i for i in range(keep[0]) if found[i].header is None and _is_heading(found[i], {"h1"})][-1:], *keep]
    return "\n".join(found[i].text for i in keep)


def _is_heading(b: Block, names: frozenset[str] | set[str]) -> bool:
    return bool(b.path) and b.path[-1].split(".")[0] in names


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: its main text and the text's number of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "url", "text", "n_chars"])

    return small_batches(pages).select(F.col(id_col), "url", F.col(html_col)).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
