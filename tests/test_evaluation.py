"""Golden sets in files, evaluation runs, replies of judges and rankers, corpora as versions."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loomwright import report
from loomwright.corpus import Corpus, Settings, embed_distinct, ingest, ingestion_report, merged_reports
from loomwright.operators import evaluate, rerank, runner, verify
from loomwright.sources import golden

FILES = [
    ("a.md", "Fusion", "# Fusion\n\nReciprocal rank fusion combines ranked lists by the sum of inverse ranks. The constant defaults to sixty in most systems.\n\n## Weights\n\nWeighted fusion scales each list before it adds them up, so that scores can be compared.", "markdown"),
    ("b.md", "Cooking", "# Bread\n\nBread dough rises for two hours in a warm place before it is baked. Salt is added last.\n\n## Soup\n\nSoup is cooked slowly with vegetables and a bone.", "markdown"),
    ("c.md", "Search", "# Vectors\n\nDense vectors are compared by their cosine, which does not depend on length.\n\n## Words\n\nAn inverted index lists for each word the chunks that hold it.", "markdown"),
]
QUESTIONS = """
name: small
queries:
  - id: q1
    query: what does reciprocal rank fusion combine?
    must_contain: ["combines ranked lists"]
    tags: [fusion]
  - id: q2
    query: how long does bread dough rise?
    must_contain: ["two hours"]
    document_titles: [cooking]
    grades: {cooking: 1}
    tags: [food]
  - id: q3
    query: what lists the chunks of a word?
    must_contain: ["index"]
  - id: q4
    query: what is not there at all?
    must_contain: ["nowhere to be found"]
"""


@pytest.fixture(scope="module")
def corpus(spark):
    files = spark.createDataFrame(FILES, "uri string, title string, text string, source_type string")
    return Corpus(ingest(files, "markdown"), Settings(dim=64))


def test_golden_sets_in_files(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text(QUESTIONS)
    (tmp_path / "g.json").write_text(json.dumps(yaml.safe_load(QUESTIONS)))
    (tmp_path / "list.json").write_text(json.dumps(yaml.safe_load(QUESTIONS)["queries"]))
    (tmp_path / "g.jsonl").write_text("\n".join(json.dumps(q) for q in yaml.safe_load(QUESTIONS)["queries"]))
    read = lambda name: sorted(map(str, golden.read_golden(spark, str(tmp_path / name)).collect()))
    want = read("g.yaml")
    assert len(want) == 4 and read("g.json") == read("list.json") == read("g.jsonl") == want
    for name in ("again.yaml", "again.json", "again.jsonl"):
        golden.save_golden(golden.read_golden(spark, str(tmp_path / "g.yaml")), str(tmp_path / name))
        assert read(name) == want
    (tmp_path / "twice.jsonl").write_text('{"id": "a", "query": "x"}\n{"id": "a", "query": "y"}')
    with pytest.raises(ValueError):
        golden.read_golden(spark, str(tmp_path / "twice.jsonl"))
    assert golden.tagged(golden.read_golden(spark, str(tmp_path / "g.yaml")), "food").count() == 1


def test_golden_sets_from_pairs_and_logs(spark):
    pairs = golden.from_pairs(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "query string, chunk_id long"))
    assert {r.query: r.chunk_ids for r in pairs.collect()} == {"x": ["1", "2"], "y": ["3"]}
    log = [("x", 1, 1), ("x", 1, 1), ("x", 2, 1), ("x", 9, 2), ("y", 3, 1)]
    mined = golden.mined(spark.createDataFrame(log, "query string, chunk_id long, rank int"))
    assert {r.query: r.chunk_ids for r in mined.collect()} == {"x": ["1"]}


def test_evaluation_run(spark, corpus, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "g.yaml").write_text(QUESTIONS)
    done = runner.run(corpus, golden.read_golden(spark, str(tmp_path / "g.yaml")), runner.PRESETS["full"])
    assert set(done.milliseconds) == {"lexical", "dense", "hybrid", "hybrid+rerank"} and set(done.excluded.values()) == {1}
    assert [r.value for r in done.unresolved.collect()] == ["nowhere to be found"]
    mean = {(r.label, r.metric): r.mean for r in done.summary.collect()}
    assert mean["lexical", "hit_rate_5"] == 1.0 and mean["lexical", "mrr"] == 1.0
    assert done.worst("mrr", 2).count() == 2
    assert not done.fails_under("mrr", 0.9) and done.fails_under("mrr", 1.1) and done.fails_under("nothing", 0.1)
    assert json.loads(report.json_report(done))["lexical"]["mean"]["mrr"] == 1.0
    assert "| mrr | 1.000 |" in report.markdown_report(done, ("mrr",))
    histogram = evaluate.rank_histogram(done.per_query.where("label = 'lexical'"))
    assert report.svg_rank_histogram(histogram).count("<rect") == 11


def test_expectations_of_any_length(spark):
    """Texts of one, two or many words, cut words and other scripts are found wherever they are contained."""
    chunks = spark.createDataFrame([(1, "T", "Hybrid retrieval uses both lists."), (2, "U", "日本語のテキスト"), (3, "t ", "nothing")], "doc_id long, title string, text string")
    asked = [(1, "text", "retrieval"), (2, "text", "hybrid retr"), (3, "text", "本語"), (4, "text", "retrieval  uses BOTH"), (5, "text", ""), (6, "title", "T"), (7, "chunk", "3"), (8, "text", "no such")]
    got = evaluate.resolve(spark.createDataFrame([(*x, 2) for x in asked], "query_id long, kind string, value string, grade int"), chunks)
    assert sorted((r.query_id, r.id) for r in got.collect()) == [(1, 1), (2, 1), (3, 2), (4, 1), (6, 1), (6, 3), (7, 3)]


def test_a_changed_corpus_has_a_new_version(spark, corpus):
    asked = spark.createDataFrame([(1, "bread dough")], "query_id long, query string")
    assert corpus.search(asked).count() > 0 and corpus._index
    less = corpus.without(corpus.chunks.where("document_title = 'Cooking'"))
    assert less.version == corpus.version + 1 and not less._index
    assert "Cooking" not in {r.document_title for r in less.search(asked).collect()}
    more = less.added(corpus.chunks.where("document_title = 'Cooking'"))
    assert more.version == less.version + 1 and more.search(asked).orderBy("rank").first().document_title == "Cooking"


def test_collections_do_not_see_each_other(spark, corpus):
    both = Corpus(corpus.chunks.withColumn("collection", F.when(F.col("document_title") == "Cooking", "food").otherwise("text")), corpus.settings)
    asked = spark.createDataFrame([(1, "bread dough")], "query_id long, query string")
    assert {r.document_title for r in both.scoped("food").search(asked).collect()} == {"Cooking"}
    assert "Cooking" not in {r.document_title for r in both.scoped("text").search(asked).collect()}
    assert both.scoped("none").search(asked).count() == 0


def test_stages_are_timed_and_answers_come_in_parts(spark, corpus):
    asked = spark.createDataFrame([(1, "how long does bread dough rise?"), (2, "zzz qqq")], "query_id long, query string")
    hits, seconds = corpus.timed(asked)
    assert {"lexical", "dense", "search"} <= set(seconds) and hits.count() == corpus.retrieve(asked).count()
    events = list(corpus.ask_in_parts(asked))
    assert [k for k, _ in events].count("done") == 2 and events[0][0] == "delta"
    first = next(v for k, v in events if k == "done" and v["query_id"] == 1)
    assert "two hours" in first["answer"] and first["citations"]


def test_failing_rerankers_leave_the_order(spark):
    pool = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 1, 0.9), (2, 2, 0.5)], "query_id long, id long, score double")
    scores = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.7), (2, 2, 0.7)], "query_id long, id long, rerank_score double")
    got = {(r.query_id, r.rank): (r.id, r.reranked) for r in rerank.rerank_by(pool, lambda _: scores).collect()}
    assert got == {(1, 1): (2, True), (1, 2): (1, True), (2, 1): (1, False), (2, 2): (2, False)}


def test_replies(spark):
    order = lambda reply, n: spark.range(1).select(rerank.reply_order(F.lit(reply), F.lit(n)).alias("x")).first().x
    assert order("[3] > [1] > [9] > 3", 4) == [2, 0, 1, 3] and order(None, 2) == [0, 1] and order("2", 0) == [] and order("99999999999, 2", 2) == [1, 0]
    verdict = lambda reply: spark.range(1).select(verify.reply_verdict(F.lit(reply).cast("string")).alias("x")).first().x
    assert tuple(verdict('Sure: {"supported": "yes", "confidence": 3, "quote": " q "} ok')) == (True, 1.0, "q", "")
    assert tuple(verdict('{"supported": false, "confidence": "high"}')) == (False, 0.5, "", "")
    assert verdict("no object") is None and verdict('{"other": 1}') is None and verdict(None) is None


def test_flags_and_reports(spark):
    rows = [(1, 0, "supported"), (1, 1, "unsupported"), (1, 2, "uncited"), (1, 3, "partial"), (2, 0, "not_a_claim")]
    got = {r.query_id: (r.unsupported_sentences, r.flagged_sentences) for r in verify.answer_flags(spark.createDataFrame(rows, "query_id long, idx int, verdict string")).collect()}
    assert got == {1: ([1], [1, 2, 3]), 2: ([], [])}
    chunks = spark.createDataFrame([(1, "a", 7), (2, "a", 7), (3, "b", 8), (4, None, 8)], "id long, text string, document_id long")
    vectors, seen = embed_distinct(chunks, 16)
    rows = {r.id: r.embedding for r in vectors.collect()}
    assert rows[1] == rows[2] != rows[3] and (seen.get["misses"], seen.get["hits"]) == (3, 1)
    one = ingestion_report(spark.range(5), chunks)
    both = merged_reports(one.unionByName(spark.createDataFrame([(1, 2, 3, ["bad file"])], "n_documents long, n_chunks long, n_skipped long, errors array<string>")))
    assert both.first().asDict() == {"n_documents": 3, "n_chunks": 6, "n_skipped": 6, "errors": ["bad file"]}
