import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from loomwright import report
from loomwright.corpus import Corpus, Settings, ingest

FILES = [
    ("a.md", "Fusion", "# Fusion\n\nReciprocal rank fusion combines ranked lists by position, not by raw score. It uses a constant of 60.\n\n# Search\n\nHybrid search runs lexical and dense retrieval for each query.", "markdown"),
    ("b.md", "Cooking", "# Pasta\n\nCooking pasta takes ten minutes in a large pot of salted water.", "markdown"),
    ("c.md", "Blank", "  ", "markdown"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame([*FILES, FILES[1]], "uri string, title string, text string, source_type string")
    return Corpus(ingest(docs, "markdown").cache(), Settings(top_k=3))


def test_ingest_is_stable_and_deduplicated(spark, corpus):
    assert corpus.chunks.select("document_id").distinct().count() == 2 and corpus.chunks.count() == 3
    again = ingest(spark.createDataFrame(FILES, "uri string, title string, text string, source_type string"), "markdown")
    assert {r.id for r in again.collect()} == {r.id for r in corpus.chunks.collect()}
    assert ingest(spark.createDataFrame(FILES, "uri string, title string, text string, source_type string"), "markdown", known=corpus.chunks).count() == 0


def test_search_and_ask(spark, corpus):
    asked = spark.createDataFrame([(1, "how does rank fusion combine lists"), (2, "cooking pasta")], "query_id long, query string")
    best = {r.query_id: r for r in corpus.search(asked).where("rank = 1").collect()}
    assert best[1].heading_context == "Fusion" and best[2].document_title == "Cooking"
    got = {r.query_id: r.answer for r in corpus.ask(asked).collect()}
    assert "Reciprocal rank fusion" in got[1] and "[1]" in got[1] and "pasta" in got[2]


def test_parts_of_a_hybrid(spark, corpus):
    asked = spark.createDataFrame([(1, "dense retrieval")], "query_id long, query string")
    ids = lambda **k: {r.id for r in Corpus(corpus.chunks, Settings(rerank=False, top_k=50, **k)).retrieve(asked).collect()}
    assert ids(strategy="hybrid") == ids(strategy="lexical") | ids(strategy="dense")
    assert Corpus(corpus.chunks, Settings(mmr=0.5, top_k=2)).retrieve(asked).count() == 2
    only = corpus.chunks.where("document_title = 'Cooking'")
    assert {r.document_title for r in Corpus(corpus.chunks, Settings(rerank=False)).search(asked, allowed=only).collect()} == {"Cooking"}


def test_housekeeping(corpus):
    assert corpus.stats().first().n_chunks == 3 and corpus.documents("cook").count() == 1
    assert corpus.similar(corpus.chunks.limit(1), 1).count() == 1
    assert corpus.with_context(corpus.chunks.where("ordinal = 0 AND document_title = 'Fusion'")).count() == 2
    assert corpus.without(corpus.chunks.where("document_title = 'Fusion'")).chunks.count() == 1
    with pytest.raises(ValueError):
        Settings(fusion="sum")


def test_reports(spark):
    points = spark.createDataFrame([(0.0, 1.0, 0, 0), (1.0, 0.5, 1, 9)], "x double, y double, cluster int, retrievals long")
    xml.dom.minidom.parseString(report.svg_map(points))
    xml.dom.minidom.parseString(report.svg_bars([("a<b", 0.5), ("c", 1.0)]))
    assert report.markdown_table(points.select("x", F.lit("a|b").alias("t")).limit(1)).endswith("| 0.0 | a\\|b |")
