import sqlite3

import pytest
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.functions.chunking import sentences
from loomwright.functions.locators import deep_link, label, locator, position_label
from loomwright.functions.stem import index_tokens, stem
from loomwright.operators import search


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("generalization", "gener"), ("adoption", "adopt"), ("controller", "control"), ("sky", "sky"), ("is", "is")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_index_tokens():
    assert index_tokens("Café_NAÏVE, running 42!") == ["cafe", "naiv", "run", "42"]


TEXTS = ["", "One. Two! Three? four", "See e.g. This one. Dr. Who came.", 'He said "Go." "Then" left. (Next) one', "Fig. 3 shows it, i.e. The end.\nNew line. 5 more"]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences_equal_plain_python(spark, text):
    assert one(spark, X.sentences(F.col("t")), t=text) == sentences(text)


def test_terms(spark):
    assert one(spark, X.terms(F.col("t")), t="What is the hybrid-search, HYBRID x9 of it?") == ["hybrid-search", "hybrid", "x9"]
    assert one(spark, X.terms(F.col("t")), t="what is it") == ["what", "is", "it"]


def test_scalars(spark):
    assert one(spark, X.token_estimate(F.col("t")), t="") == 0 and one(spark, X.token_estimate(F.col("t")), t="abc") == 1
    assert one(spark, X.timestamp_label(F.lit(3725.9))) == "1:02:05" and one(spark, X.timestamp_label(F.lit(65))) == "1:05"
    assert one(spark, X.canonical_url(F.col("t")), t="https://x.org/a/b//?q=1#z") == "https://x.org/a/b?q=1"
    assert one(spark, X.percent_encode(F.col("t")), t="a b*~é") == "a%20b%2A~%C3%A9"
    assert one(spark, X.normalize_whitespace(F.col("t")), t=" a \r\n\n\n\nb\t\n") == "a\n\nb"
    assert one(spark, X.strip_inline_markdown(F.col("t")), t="**a** `b` [c](d)") == "a b c"
    assert one(spark, X.title_from_markdown(F.col("t")), t="x\n# Hello\n") == "Hello"
    assert one(spark, X.normal_number(F.col("t")), t="1,000.5%") == 1000.5


@pytest.mark.parametrize(
    ("where", "link", "name"),
    [
        (lambda: locator("pdf", page=F.lit(3), page_count=F.lit(9), file_url=F.lit("f.pdf")), "f.pdf#page=3", "p. 3 / 9"),
        (lambda: locator("text", line_start=F.lit(0), line_end=F.lit(4), file_path=F.lit("a.txt")), "a.txt#L1-L4", "lines 1-4"),
        (lambda: locator("web", url=F.lit("https://x.org/p/#f"), quote_prefix=F.lit("a b"), quote_suffix=F.lit("c")), "https://x.org/p#:~:text=a%20b,c", "x.org"),
        (lambda: locator("github", repo=F.lit("o/r"), path=F.lit("m.py"), line_start=F.lit(5), symbol=F.lit("f")), "https://github.com/o/r/blob/HEAD/m.py#L5", "m.py:5 (f)"),
        (lambda: locator("youtube", video_id=F.lit("v"), start_seconds=F.lit(61.5)), "https://www.youtube.com/watch?v=v&t=61s", "1:01"),
        (lambda: locator("notion", notion_page_id=F.lit("a-b"), page_path=F.array(F.lit("P"), F.lit("Q"))), "https://www.notion.so/ab", "Q"),
    ],
)
def test_locators(spark, where, link, name):
    assert one(spark, deep_link(where())) == link and one(spark, label(where())) == name


def test_position_label_drops_title(spark):
    where = locator("text", heading_path=F.array(F.lit("Guide"), F.lit("Setup")), line_start=F.lit(1))
    assert one(spark, position_label(where, F.lit("Guide"))) == "Setup"
    with pytest.raises(ValueError):
        locator("fax")


DOCS = [
    (1, "Running runners run quickly; the run was general.", "Sports"),
    (2, "A generalization about café culture and hybrid search.", "Search notes"),
    (3, "Hybrid search combines ranked lists. Searching hybrid indexes.", "Search"),
    (4, "Nothing to see here, move along.", ""),
    (5, "run run run hybrid", "Running"),
    (6, "Rank fusion of lists and more lists, ranks and ranking.", "Fusion"),
]


@pytest.mark.parametrize("query", ["running", "hybrid search", "generalization culture", '"hybrid search"', "lists ranking"])
def test_bm25_equals_fts5(spark, query):
    """Stemmed BM25 with prefixes and field weights against SQLite's own."""
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(text, title, tokenize = 'porter unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    db.executemany("insert into f(rowid, text, title) values (?, ?, ?)", DOCS)
    phrases = spark.createDataFrame([(1, query)], "query_id long, query string").select(X.query_phrases(F.col("query")).alias("p")).first()["p"]
    match = " OR ".join(f'"{" ".join(p["tokens"])}"' + ("*" if p["kind"] == "prefix" else "") for p in phrases)
    want = {r: -s for r, s in db.execute("select rowid, bm25(f, 1.0, 0.25) from f where f match ?", (match,))}
    chunks = spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    got = {r.id: r.score for r in search.bm25_scores(chunks, asked, fields={"text": 1.0, "title": 0.25}, prefix_expansion=True, stemmed=True).collect()}
    assert got == pytest.approx(want)
