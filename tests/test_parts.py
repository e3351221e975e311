"""Point lookups, pages, settings, sources that stand for several files, fallbacks of chunkers, stored locators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomwright.corpus import Corpus, Settings, ingest, valid_queries
from loomwright.functions import chunking, locators
from loomwright.sources import files


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(f"{i}.md", f"T{i}", f"# Head {i}\n\nSome text of document {i}, which is long enough.", "markdown") for i in range(5)]
    return Corpus(ingest(spark.createDataFrame(rows, "uri string, title string, text string, source_type string"), "markdown"), Settings(dim=32))


def test_lookups_and_pages(corpus):
    pages = list(corpus.pages_of_chunks(2))
    ids = [r.id for p in pages for r in p]
    assert [len(p) for p in pages] == [2, 2, 1] and ids == sorted(ids)
    one = corpus.chunk(ids[0])
    assert one.id == ids[0] and corpus.document(one.document_id).n_chunks == 1
    assert [r.id for r in corpus.document_chunks(one.document_id).collect()] == [one.id]
    for f in (corpus.chunk, corpus.document):
        with pytest.raises(KeyError):
            f(-1)
    got = corpus.vectors_of(corpus.chunks.where(F.col("id") == one.id)).collect()
    assert len(got) == 1 and sum(x * x for x in got[0].embedding) == pytest.approx(1.0)


def test_settings_and_queries(spark):
    assert Settings(top_k=3).merged(top_k=None, rerank=False) == Settings(top_k=3, rerank=False)
    with pytest.raises(ValueError):
        Settings().merged(top_k=0)
    good, bad = valid_queries(spark.createDataFrame([(1, "  a "), (2, " "), (3, None)], "query_id long, query string"))
    assert [r.query for r in good.collect()] == ["a"] and sorted(r.query_id for r in bad.collect()) == [2, 3]


def test_expand(spark, tmp_path):
    for name in ("b.md", "a.txt", "sub/c.md", "node_modules/d.md", ".hidden/e.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    ends = lambda source: [x.removeprefix(f"file:{tmp_path}").removeprefix(f"file://{tmp_path}") for x in files.expand(spark, source)]
    assert ends(str(tmp_path)) == ["/a.txt", "/b.md", "/sub/c.md"] and ends(f"{tmp_path}/*.md") == ["/b.md"]
    assert files.expand(spark, "https://x.org/*") == ["https://x.org/*"] and files.expand(spark, "inline:T") == ["inline:T"]
    assert files.expand(spark, f"{tmp_path}/a.txt") == [f"{tmp_path}/a.txt"] and files.expand(spark, f"{tmp_path}/none") == [f"{tmp_path}/none"]
    with pytest.raises(FileNotFoundError):
        files.expand(spark, f"{tmp_path}/*.pdf")
    (tmp_path / "export").mkdir()
    (tmp_path / "export" / f"Page {'a' * 32}.md").write_text("x")
    assert files.expand(spark, f"{tmp_path}/export") == [f"{tmp_path}/export"]


def test_fallbacks_of_chunkers(spark):
    rows = spark.createDataFrame([(1, "```\n\n```"), (2, "# only a heading"), (3, " \n"), (4, None)], "doc_id long, text string")
    got = {r.doc: r.text for r in chunking.chunk_documents(rows, "markdown").collect()}
    assert got[2] == "# only a heading" and set(got) == {1, 2}
    cues = [("v", i, "A few words here. " * 20, 10.0 * i, 10.0) for i in range(12)]
    table = spark.createDataFrame(cues, "video string, idx int, text string, start double, duration double")
    got = chunking.chunk_transcripts(table, 60.0, size=400, overlap=40, least=20).collect()
    assert max(r.ordinal for r in got) >= 2 and all(len(r.text) <= 700 for r in got) and len({(r.idx, r.start, r.end) for r in got}) == len({r.idx for r in got})


def test_stored_locators(spark):
    where = locators.locator("text", file_path=F.lit("a.md"), line_start=F.lit(3), line_end=F.lit(9), heading_path=F.array(F.lit("A"), F.lit("B")))
    r = spark.range(1).select(where.alias("w")).select("w", locators.from_text(locators.to_text(F.col("w"))).alias("again"), locators.from_text(F.lit('{"kind": "moon"}')).alias("none"), locators.to_text(F.col("w")).alias("t")).first()
    assert r.w == r.again and r.none is None and "page" not in r.t.replace("pages", "")
