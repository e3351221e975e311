"""Where a chunk comes from: one sparse struct for all kinds of sources, with link and label as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import canonical_url, percent_encode, timestamp_label, url_host

FIELDS = {
    "kind": "string", "page": "int", "page_count": "int", "file_url": "string", "line_start": "int", "line_end": "int",
    "char_start": "int", "char_end": "int", "heading_path": "array<string>", "file_path": "string", "url": "string",
    "quote_prefix": "string", "quote_suffix": "string", "repo": "string", "ref": "string", "path": "string", "symbol": "string",
    "video_id": "string", "start_seconds": "double", "end_seconds": "double", "page_path": "array<string>", "notion_page_id": "string",
}
KINDS = ("pdf", "text", "web", "github", "youtube", "notion")
SCHEMA = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def locator(kind: str, **fields: Column) -> Column:
    """A locator of one kind; what is not given is null. Lines start at 1 and end no earlier than they start."""
    if kind not in KINDS:
        raise ValueError(f"no locator of kind {kind!r}")
    if unknown := set(fields) - set(FIELDS):
        raise ValueError(f"no locator fields {sorted(unknown)}")
    if "line_start" in fields:
        fields["line_start"] = F.greatest(F.lit(1), fields["line_start"])
        fields["line_end"] = F.greatest(fields["line_start"], fields.get("line_end", fields["line_start"]))
    if kind == "github":
        fields.setdefault("ref", F.lit("HEAD"))
    if "url" in fields:
        fields["url"] = canonical_url(fields["url"])
    values = {"kind": F.lit(kind), **fields}
    return F.struct(*[values.get(k, F.lit(None)).cast(t).alias(k) for k, t in FIELDS.items()])


def to_text(where: Column) -> Column:
    """A locator as JSON, without what is null."""
    return F.to_json(where)


def from_text(stored: Column) -> Column:
    """The locator that ``to_text`` wrote; null where it is none of the known kinds."""
    where = F.from_json(stored, SCHEMA)
    return F.when(where["kind"].isin(*KINDS), where)


def _headings(where: Column, otherwise: Column) -> Column:
    path = where["heading_path"]
    return F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(path, F.greatest(F.lit(1), F.size(path) - 1), F.lit(2)), " › ")).otherwise(otherwise)


def _lines(where: Column) -> Column:
    one = where["line_start"] == where["line_end"]
    return F.when(one, F.format_string("line %d", where["line_start"])).otherwise(F.format_string("lines %d-%d", where["line_start"], where["line_end"]))


def deep_link(where: Column) -> Column:
    """A link to the very place; null where the source has none."""
    w = lambda name: where[name]
    fragment = F.concat(
        F.regexp_replace(w("url"), "#.*$", ""), F.lit("#:~:text="), percent_encode(w("quote_prefix")),
        F.when(w("quote_suffix").isNull() | (w("quote_suffix") == w("quote_prefix")), "").otherwise(F.concat(F.lit(","), percent_encode(w("quote_suffix")))),
    )
    lines = F.when(w("line_start") == w("line_end"), F.format_string("#L%d", w("line_start"))).otherwise(F.format_string("#L%d-L%d", w("line_start"), w("line_end")))
    return (
        F.when(w("kind") == "pdf", F.when(w("file_url").isNotNull(), F.concat(w("file_url"), F.lit("#page="), w("page"))))
        .when(w("kind") == "text", F.when(w("file_path").isNotNull(), F.concat(w("file_path"), F.format_string("#L%d-L%d", w("line_start"), w("line_end")))))
        .when(w("kind") == "web", F.when(F.coalesce(w("quote_prefix"), F.lit("")) == "", w("url")).otherwise(fragment))
        .when(w("kind") == "github", F.concat(F.lit("https://github.com/"), w("repo"), F.lit("/blob/"), w("ref"), F.lit("/"), w("path"), lines))
        .when(w("kind") == "youtube", F.concat(F.lit("https://www.youtube.com/watch?v="), w("video_id"), F.lit("&t="), F.floor(w("start_seconds")).cast("string"), F.lit("s")))
        .when(w("kind") == "notion", F.when(w("notion_page_id").isNotNull(), F.concat(F.lit("https://www.notion.so/"), F.replace(w("notion_page_id"), F.lit("-"), F.lit("")))))
    )


def label(where: Column) -> Column:
    """A short description of the place."""
    w = lambda name: where[name]
    host = F.nullif(url_host(w("url")), F.lit(""))
    return (
        F.when(w("kind") == "pdf", F.when(w("page_count").isNotNull(), F.format_string("p. %d / %d", w("page"), w("page_count"))).otherwise(F.format_string("p. %d", w("page"))))
        .when(w("kind") == "text", _headings(where, _lines(where)))
        .when(w("kind") == "web", _headings(where, F.coalesce(host, w("url"))))
        .when(w("kind") == "github", F.concat(w("path"), F.format_string(":%d", w("line_start")), F.coalesce(F.concat(F.lit(" ("), w("symbol"), F.lit(")")), F.lit(""))))
        .when(w("kind") == "youtube", timestamp_label(w("start_seconds")))
        .when(w("kind") == "notion", _headings(where, F.coalesce(F.try_element_at(w("page_path"), F.lit(-1)), _lines(where))))
    )


def position_label(where: Column, title: Column) -> Column:
    """The label without the document's title at its beginning."""
    text = label(where)
    cut = F.when(text.startswith(title), F.substring(text, F.length(title) + 1, F.length(text))).otherwise(text)
    return F.regexp_replace(cut, "^[ ›]+|[ ›]+$", "")
