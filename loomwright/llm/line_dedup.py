"""Line dedup by site-relative frequency.

Lines are compared with their outer white space removed and A-Z in lower case; blank lines count for nothing.
For each host, the share of its pages that contain a line decides: a line on more than ``ratio`` of the pages
of a host with at least ``min_pages`` pages, and on at least ``min_pages`` pages, is boilerplate of that host
and goes from all its pages. Lines travel as 64-bit hashes, each once per page; counts are gathered per task
before the shuffle, so a line that a whole hot host repeats is one row per task. The marks go back to the pages
by an equi-join on host and line, with the written table of boilerplate lines (small: broadcast by its
measured size; large: a shuffled join whose hot keys Spark splits), and texts are shuffled, by
page, only where there are too many marked pages to send to every task.

Defined results: a null text has no lines and stays null; pages without a host form a host of their own;
rows are told apart by a hash of all their columns that matter (id, host, text), and exactly repeated rows
stay repeated; other columns are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
RATIO, MIN_PAGES = 0.2, 10
#: Marks go to every task up to this many bytes (counted); beyond that texts are shuffled to their marks.
BROADCAST_BYTES = 48 << 20


def line_key(line: Column) -> Column:
    """The form in which lines are compared."""
    return F.translate(F.regexp_replace(line, SPACE, ""), UPPER, LOWER)


def _keyed(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        F.struct(*docs.columns).alias("__row"),
        F.col(text_col).alias("__text"),
        F.struct(F.col(host_col)).alias("__host"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(host_col).cast("string"), F.col(text_col)).alias("__page"),
        F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col).cast("string")).alias("__page2"),
    )


def page_lines(keyed: DataFrame) -> DataFrame:
    """Host, page and hash of each line that is not blank, once a page."""
    lines = F.array_distinct(F.transform(F.split(F.col("__text"), "\n"), line_key))
    at = keyed.select("__host", "__page", "__page2", F.explode(lines).alias("line")).where("line != ''")
    return at.select("__host", "__page", "__page2", F.xxhash64("line").alias("line"))


def boilerplate(lines: DataFrame, pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Host and hash of the lines over the ratio, with their share of the host's pages."""
    totals = pages.groupBy("__host").agg(F.count("*").alias("pages"))
    seen = lines.groupBy("__host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    both = seen.join(totals, "__host").where((F.col("pages") >= min_pages) & (F.col("n") > ratio * F.col("pages")))
    return both.select("__host", "line", (F.col("n") / F.col("pages")).alias("share"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` as struct ``__row`` with ``clean`` (the text without boilerplate lines), n_lines and n_removed."""
    keyed = _keyed(docs, id_col, text_col, host_col)
    lines = page_lines(keyed)
    marks = lines.join(materialise(boilerplate(lines, keyed, ratio, min_pages), "boilerplate"), ["__host", "line"])
    marks = marks.groupBy("__page", "__page2").agg(F.collect_set("line").alias("drop"))
    split = F.split(F.col("__text"), "\n")
    kept = F.filter(split, lambda line: ~F.array_contains("drop", F.xxhash64(line_key(line))) | (line_key(line) == ""))
    marks = materialise(marks, "marks")
    size = marks.agg(F.sum(F.size("drop") * 8 + 64)).first()[0] or 0  # a row's keys and place, and its lines' hashes
    out = keyed.join(F.broadcast(marks) if size <= BROADCAST_BYTES else marks, ["__page", "__page2"], "left")
    kept = F.when(F.col("drop").isNull(), split).otherwise(kept)
    return out.select("__row", "__text", split.alias("__all"), kept.alias("__kept")).select(
        "__row",
        F.when(F.size("__all") == F.size("__kept"), F.col("__text")).otherwise(F.array_join("__kept", "\n")).alias("clean"),
        F.coalesce(F.size("__all"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__all") - F.size("__kept"), F.lit(0)).cast("long").alias("n_removed"),
    )


def clean_pages(docs: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``documents`` with the boilerplate lines of their hosts removed and n_chars counted anew."""
    done = drop_boilerplate(docs, ratio, min_pages)
    own = [F.col("clean").alias("text") if c == "text" else F.when(F.col("n_removed") > 0, F.length("clean").cast("long")).otherwise(F.col("__row.n_chars")).alias("n_chars") if c == "n_chars" else F.col(f"__row.`{c}`") for c in docs.columns]
    return done.select(*own)


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, text, row_number() OVER () AS r FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)),1) AS p FROM d),
k AS (SELECT r, source, p, line, translate(regexp_replace(line,'{SPACE}','','g'),'{UPPER}','{LOWER}') AS key FROM l),
n AS (SELECT source, key, count(DISTINCT r) AS n FROM k WHERE key <> '' GROUP BY ALL),
h AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT n.source, key FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE n >= {MIN_PAGES} AND pages >= {MIN_PAGES} AND n > {RATIO}*pages),
m AS (SELECT r, p, line, b.key IS NOT NULL AS gone FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source AND k.key = b.key),
t AS (SELECT r, count(*) AS n_lines, sum(gone::INT) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS clean FROM m GROUP BY r)
SELECT doc_id, coalesce(n_lines,0)::BIGINT AS n_lines, coalesce(n_removed,0)::BIGINT AS n_removed,
  length(CASE WHEN text IS NULL THEN '' ELSE clean END)::BIGINT AS n_chars_kept, sha256(CASE WHEN text IS NULL THEN '' ELSE clean END) AS kept_sha256
FROM d LEFT JOIN t USING (r)"""
