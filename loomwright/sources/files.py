"""Files as sources: reading, routing to a connector, front matter, exports, repositories, transcripts.

Reading goes through Spark's binary reader, so any store that Spark reads will do; filters on paths act before
contents are read. Failures are rows with an ``error``, never exceptions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import title_from_markdown, title_from_path

# Folders that are never walked into; endings by kind.
SKIP = ".git .hg .svn node_modules __pycache__ .venv venv .tox .mypy_cache .pytest_cache .ruff_cache dist build target .next .nuxt vendor .terraform site-packages .idea .vscode".split()
MARKDOWN, TEXT = ".md .markdown .mdx .mdown .mkd".split(), ".txt .text .rst .log .csv .tsv".split()
CODE = ".py .pyi .js .jsx .ts .tsx .mjs .cjs .go .rs .java .kt .kts .scala .swift .c .h .cc .cpp .hpp .cs .m .mm .rb .php .pl .lua .r .jl .ex .exs .erl .sh .bash .zsh .fish .ps1 .sql .graphql .proto .tf .hcl".split()
PROSE, CONFIG = ".md .markdown .mdx .rst .txt .adoc".split(), ".yaml .yml .toml .ini .cfg .json".split()
# Repository paths that are never indexed.
EXCLUDED = (
    r"(?i)(?:^|/)(?:node_modules|vendor|third_party|\.git|dist|build|target|out|coverage|__pycache__|\.venv|venv|site-packages|\.next|\.nuxt|\.terraform)(?:/|$)"
    r"|(?:^|/)(?:package-lock\.json|yarn\.lock|pnpm-lock\.yaml|poetry\.lock|Cargo\.lock|go\.sum|composer\.lock|Gemfile\.lock|uv\.lock)$|\.min\.(?:js|css)$|\.(?:map|snap)$"
)
LANGUAGES = {
    "python": ".py .pyi", "javascript": ".js .mjs .cjs .jsx", "typescript": ".ts .tsx", "go": ".go", "rust": ".rs", "java": ".java", "kotlin": ".kt", "ruby": ".rb", "php": ".php",
    "c": ".c .h", "cpp": ".cc .cpp .hpp", "csharp": ".cs", "swift": ".swift", "shell": ".sh .bash", "sql": ".sql", "markdown": ".md",
}
MAX_BYTES = 512 * 1024


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def language(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, endings in LANGUAGES.items():
        out = F.when(suffix(path).isin(*endings.split()), name).otherwise(out)
    return out


def is_indexable(path: Column, size: Column, most: int = MAX_BYTES) -> Column:
    """Whether a repository's file is worth indexing."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return ~path.rlike(EXCLUDED) & (size <= most) & ~name.startswith(".") & suffix(path).isin(*CODE, *PROSE, *CONFIG)


def is_walked(path: Column) -> Column:
    """Whether a walk reaches a path: no skipped folder, no hidden name."""
    parts = F.split(path, "/")
    return ~F.exists(parts, lambda p: p.isin(*SKIP) | (p.startswith(".") & (F.length(p) > 1)))


def route(source: Column) -> Column:
    """The connector of a source: the first that can handle it."""
    return (
        F.when(source.rlike(r"(?i)notion") & source.rlike(r"\.zip$"), "notion")
        .when(source.rlike(r"[0-9a-f]{32}\.(md|csv)$"), "notion")
        .when(source.startswith("inline:"), "inline")
        .when(suffix(source).isin(*MARKDOWN) & ~source.rlike("^https?://"), "markdown")
        .when(suffix(source).isin(".pdf") & ~source.rlike("^https?://"), "pdf")
        .when(suffix(source).isin(*TEXT) & ~source.rlike("^https?://"), "text")
        .when(source.rlike(r"(?i)^(https?://)?([a-z]+\.)?(youtube\.com|youtu\.be)/"), "youtube")
        .when(source.rlike(r"(?i)^(gh:|github:)|^(https?://)?(www\.)?github\.com/[\w.-]+/[\w.-]+"), "github")
        .when(source.rlike("^https?://"), "web")
    )


def decode_tolerant(raw: bytes | None) -> str:
    """Text of bytes in UTF-8 (with or without a mark), else in Windows-1252, else Latin-1."""
    for name in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return (raw or b"").decode(name)
        except UnicodeDecodeError:
            continue
    return (raw or b"").decode("utf-8", "replace")


@F.pandas_udf(T.StringType())
def decoded(raw: pd.Series) -> pd.Series:
    return raw.map(decode_tolerant)


def read_files(spark: SparkSession, path: str, glob: str | None = None, most: int = 32 << 20) -> DataFrame:
    """path, size, text, connector, error of the files under a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = (rows.option("pathGlobFilter", glob) if glob else rows).load(path)
    root = re.sub(r"^[a-z]+:/*", "/", path).rstrip("/")
    rows = rows.withColumn("name", F.regexp_replace("path", f"^[a-z]+:/*{re.escape(root.lstrip('/'))}/?", "")).where(is_walked(F.col("name")))
    ok = F.col("length") <= most
    return rows.select(F.col("path"), F.col("name"), F.col("length").alias("size"), decoded(F.when(ok, F.col("content"))).alias("text"), route(F.col("path")).alias("connector"), F.when(~ok, "file too large").alias("error"))


def expand(spark: SparkSession, source: str) -> list[str]:
    """What a source stands for: an address or a text in place itself; a folder that is a Notion export itself; any
    other folder its files as a walk finds them, and a pattern the files that match it, both sorted; else the source
    as it is. A pattern without a match is an error."""
    if re.match(r"^(?:https?://|inline:|gh:|github:)", source):
        return [source]
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if any(c in source for c in "*?["):
        found = sorted(str(f.getPath()) for f in store.globStatus(path) or [])
        if not found:
            raise FileNotFoundError(f"nothing matches {source}")
        return found
    if not store.exists(path) or not store.getFileStatus(path).isDirectory():
        return [source]
    inside = store.listStatus(path)
    if any(re.search(r"[0-9a-f]{32}\.(?:md|csv)$", f.getPath().getName()) for f in inside):
        return [source]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    root = re.sub(r"^[a-z]+:/*", "", str(store.makeQualified(path))).strip("/")
    name = F.regexp_replace("path", f"^[a-z]+:/*{re.escape(root)}/?", "")
    return sorted(r["path"] for r in rows.select("path").where(is_walked(name)).collect())  # names only


def front_matter(text: Column) -> Column:
    """struct (meta: map of plain keys, body) of Markdown with --- lines before it."""
    head = F.regexp_extract(text, r"^---[ \t]*\n([\s\S]*?)\n---[ \t]*(?:\n|$)", 1)
    body = F.when(head != "", F.regexp_replace(text, r"^---[ \t]*\n[\s\S]*?\n---[ \t]*(?:\n|$)", "")).otherwise(text)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pair = lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[A-Za-z_][\w-]*:", "")), r"^[\"']|[\"']$", "").alias("v"))
    entries = F.transform(lines, pair)
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, F.lit(1), i), lambda o: o["k"] == e["k"]))
    return F.struct(F.map_from_entries(first).alias("meta"), body.alias("body"))


def markdown_documents(files: DataFrame) -> DataFrame:
    """path, title, text, meta of Markdown files: the title from the front matter, the first heading, or the name."""
    rows = files.withColumn("f", front_matter(F.col("text")))
    title = F.coalesce(F.nullif(F.col("f.meta")["title"], F.lit("")), title_from_markdown(F.col("f.body")), title_from_path(F.col("path")))
    return rows.select("path", title.alias("title"), F.col("f.body").alias("text"), F.col("f.meta").alias("meta"))


def looks_like_markdown(text: Column) -> Column:
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 60), "\n")
    return head.startswith("# ") | F.contains(head, F.lit("\n# ")) | F.contains(head, F.lit("\n## ")) | F.contains(head, F.lit("\n- ")) | F.contains(head, F.lit("```"))


def inline_documents(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """Texts given in code: path, text, kind."""
    return spark.createDataFrame(rows, "title string, text string").select(F.concat(F.lit("inline:"), "title").alias("path"), "title", "text", F.when(looks_like_markdown(F.col("text")), "markdown").otherwise("text").alias("kind"))


def rows_to_blocks(rows: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """Rows as Markdown: a heading and a list of the fields that are not empty, in ``block``."""
    parts = [F.when(F.trim(F.col(f)) != "", F.concat(F.lit(f"- {f}: "), F.trim(F.col(f)))) for f in fields]
    return rows.withColumn("block", F.concat(F.lit("## "), F.col(title), F.lit("\n\n"), F.concat_ws("\n", *parts)))


def notion_name(path: Column) -> Column:
    """struct (title, page_id) of an exported file's name."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"\.(md|csv)$", "")
    return F.struct(F.trim(F.regexp_replace(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), r"[ _-]*[0-9a-f]{32}$", "")).alias("title"), F.nullif(F.regexp_extract(name, r"([0-9a-f]{32})$", 1), F.lit("")).alias("page_id"))


def notion_ancestors(path: Column) -> Column:
    """Cleaned names of the folders above an exported file."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.filter(F.transform(folders, lambda p: F.trim(F.regexp_replace(p, r"[ _-]*[0-9a-f]{32}$", ""))), lambda p: p != "")


def repo_source(source: Column) -> Column:
    """struct (owner, repo, ref, path) of owner/repo, gh:owner/repo or a repository's address."""
    url = r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?(?:/(?:tree|blob)/([^/]+)(?:/(.*))?)?/?$"
    short = r"^(?:gh:|github:)?([\w.-]+)/([\w.-]+)$"
    is_url = source.rlike(url)
    part = lambda i: F.nullif(F.when(is_url, F.regexp_extract(source, url, i)).otherwise(F.regexp_extract(source, short, i) if i < 3 else F.lit("")), F.lit(""))
    return F.struct(*[part(i).alias(n) for i, n in enumerate(("owner", "repo", "ref", "path"), 1)])


def video_id(url: Column) -> Column:
    """The id of a video's address in any of its usual forms, or a bare id."""
    forms = r"(?:v=|youtu\.be/|/embed/|/shorts/|/live/|/v/)([A-Za-z0-9_-]{11})(?:[^A-Za-z0-9_-]|$)"
    found = F.regexp_extract(url, forms, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.when(url.rlike("^[A-Za-z0-9_-]{11}$"), url))


def clean_cue(text: Column) -> Column:
    """A cue without sound notes and line breaks."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]|♪", " "), r"\s+", " "))


def clean_pdf_pages(pages: DataFrame) -> DataFrame:
    """``pages`` (doc, page, text) without running headers and footers (short lines among the first or last three
    that stand on at least three pages and six of ten) and page numbers, with split words joined."""
    lines = pages.select("doc", "page", F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "").alias("l"))
    edge = F.array_distinct(F.concat(F.slice("l", 1, 3), F.when(F.size("l") > 0, F.slice("l", F.greatest(F.size("l") - 2, F.lit(1)), F.lit(3))).otherwise(F.array().cast("array<string>"))))
    seen = lines.select("doc", F.explode(edge).alias("line")).where(F.length("line") < 120).groupBy("doc", "line").agg(F.count("*").alias("n"))
    total = pages.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    running = seen.join(total, "doc").where((F.col("pages") >= 3) & (F.col("n") >= F.greatest(F.lit(3), F.floor(0.6 * F.col("pages")))))
    running = running.groupBy("doc").agg(F.collect_set("line").alias("running"))
    rows = pages.join(running, "doc", "left")
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("running", F.array().cast("array<string>")), x) & ~x.rlike(r"^\s*(?:page\s+)?\d+(?:\s*(?:/|of)\s*\d+)?\s*$"))
    text = F.regexp_replace(F.array_join(kept, "\n"), r"(\w)-\n(\w)", "$1$2")
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.select("doc", "page", F.trim(F.regexp_replace(text, "[ \t]{2,}", " ")).alias("text"))


def pdf_pages(files: DataFrame) -> DataFrame:
    """doc, page, text, error of PDF files (path, content), with a PDF library if there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            from pypdf import PdfReader
        except ImportError:
            PdfReader = None
        import io

        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    if PdfReader is None:
                        raise RuntimeError("no PDF library is installed (pypdf)")
                    for i, page in enumerate(PdfReader(io.BytesIO(raw)).pages, 1):
                        rows.append((path, i, page.extract_text(), None))
                except Exception as problem:
                    rows.append((path, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "doc string, page int, text string, error string")


def frontier(links: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """url, depth of the pages reached from seeds over same-origin links (source, target): each round joins the
    newest pages with the links and leaves out those already seen."""
    from loomwright.functions.text import url_host
    from loomwright.session import materialise

    same = links.where(url_host(F.col("source")) == url_host(F.col("target")))
    seen = materialise(seeds.select("url", F.lit(0).alias("depth")).dropDuplicates(["url"]), "crawl")
    for d in range(1, depth + 1):
        new = seen.where(F.col("depth") == d - 1).join(same, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct().join(seen, "url", "left_anti")
        seen = materialise(seen.unionByName(new.withColumn("depth", F.lit(d))), "crawl")
    return seen


def zip_members(files: DataFrame) -> DataFrame:
    """path, content, error: the members of archives (path, content), read one by one without unpacking; a broken archive
    is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                        for name in archive.namelist():
                            if not name.endswith("/"):
                                yield pd.DataFrame([(name, archive.read(name), None)], columns=["path", "content", "error"])
                except Exception as problem:
                    yield pd.DataFrame([(path, None, str(problem))], columns=["path", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, content binary, error string")


def notion_documents(members: DataFrame, least: int = 20) -> DataFrame:
    """path, title, page_id, ancestors, kind, text of an export's pages and tables (path, content): no ``_all.csv``, no
    bodies of fewer than ``least`` characters."""
    kind = F.regexp_extract(F.lower("path"), r"\.(md|csv)$", 1)
    rows = members.where((kind != "") & ~F.col("path").rlike(r"(?i)_all\.csv$")).select("path", kind.alias("kind"), decoded(F.col("content")).alias("text"))
    rows = rows.where(F.length(F.trim("text")) >= least)
    return rows.select("path", notion_name(F.col("path")).alias("n"), notion_ancestors(F.col("path")).alias("ancestors"), "kind", "text").select("path", "n.*", "ancestors", "kind", "text")


def repo_tree(replies: DataFrame, most: int = 400) -> DataFrame:
    """repo, path, size of the files that a tree reply (repo, reply as JSON) lists and that are worth indexing: at most
    ``most`` a repository, by path, which is the source's own setting."""
    rows = replies.select("repo", F.explode(F.from_json("reply", "tree array<struct<path:string,type:string,size:bigint>>")["tree"]).alias("t")).select("repo", "t.*")
    rows = rows.where((F.col("type") == "blob") & is_indexable(F.col("path"), F.coalesce("size", F.lit(0))))
    nth = F.row_number().over(Window.partitionBy("repo").orderBy("path"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most).select("repo", "path", "size")


def repo_contents(replies: DataFrame) -> DataFrame:
    """path, text, error of contents replies (reply as JSON, with base64 content); what holds a NUL byte is binary."""
    r = F.from_json("reply", "path string, encoding string, content string")
    raw = F.unbase64(F.regexp_replace(r["content"], r"\s", ""))
    rows = replies.select(r["path"].alias("path"), F.when(r["encoding"] == "base64", raw).otherwise(F.to_binary(r["content"], F.lit("utf-8"))).alias("raw"))
    binary = F.hex("raw").rlike("^(..)*?00")
    return rows.select("path", F.when(~binary, decoded(F.col("raw"))).alias("text"), F.when(binary, "binary file").alias("error"))


def transcript_cues(replies: DataFrame) -> DataFrame:
    """video, idx, text, start, duration of transcript replies (video, reply as JSON): a list of cues, or an object with
    ``snippets``. Cues without text after cleaning are left out."""
    cue = "struct<text:string,start:double,duration:double>"
    listed, wrapped = F.from_json("reply", f"array<{cue}>"), F.from_json("reply", f"snippets array<{cue}>")["snippets"]
    rows = replies.select("video", F.posexplode(F.when(F.ltrim("reply").startswith("["), listed).otherwise(wrapped)).alias("idx", "c"))
    return rows.select("video", "idx", clean_cue(F.col("c.text")).alias("text"), "c.start", "c.duration").where("text <> ''")


def page_error(content_type: Column, text: Column, least: int = 80) -> Column:
    """Why a fetched page is not taken: no HTML or XML, or too little text after cleaning; null if it is taken."""
    return F.when(~F.coalesce(content_type.rlike("(?i)html|xml"), F.lit(False)), "not a page of text").when(F.length(F.coalesce(text, F.lit(""))) < least, "too little text")


def unique_names(files: DataFrame, name: str = "name", order: str = "id") -> DataFrame:
    """``files`` with ``stored_name``: the first file of a name keeps it, others get a number before the ending that no
    given name has."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    rows = files.withColumn("__nth", nth)
    stem, end = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), suffix(F.col(name))
    rows = rows.withColumn("__new", F.when(F.col("__nth") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("__nth").cast("string"), end)))
    taken = files.select(F.col(name).alias("__new")).distinct().withColumn("__taken", F.lit(True))
    rows = rows.join(taken, "__new", "left")
    clash = (F.col("__nth") > 0) & F.col("__taken")
    return rows.withColumn("stored_name", F.when(clash, F.concat(stem, F.lit("-"), F.col("__nth").cast("string"), F.lit("-"), F.left(F.sha2(F.col(order).cast("string"), 256), F.lit(8)), end)).otherwise(F.col("__new"))).drop("__nth", "__new", "__taken")
