import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import chunking, html
from loomwright.operators import analytics, answer, evaluate, fusion, rerank, store, vectors, verify

ONE = "query_id long, id long, score double, rank int"


def ranked(spark, rows):
    return spark.createDataFrame([(1, i, float(s), r) for r, (i, s) in enumerate(rows, 1)], ONE)


def test_fusion(spark):
    a, b = ranked(spark, [(1, 9), (2, 5), (3, 1)]), ranked(spark, [(3, 0.9), (4, 0.1)])
    rrf = {r.id: r.score for r in fusion.fuse(a, b, "rrf", (1.0, 1.0)).collect()}
    assert rrf[3] == round(1 / 63 + 1 / 61, 6) and rrf[1] == round(1 / 61, 6)
    weighted = {r.id: r.score for r in fusion.fuse(a, b, "weighted").collect()}
    assert weighted[1] == 0.65 and weighted[3] == 0.35 and weighted[2] == 0.325
    assert [r.id for r in fusion.fuse(a, b, "max").orderBy("rank").collect()] == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        fusion.fuse(a, b, "sum")


def test_cosine_blocks_equal_expressions(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(60)] + [(60, [0.0] * 8)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = vecs.where("id < 7").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(vectors, "BLOCK_VALUES", 16)
    got = {(r.query_id, r.rank): r.id for r in vectors.cosine_top_k(vecs, asked, 5, exclude_self=True).collect()}
    for q in range(7):
        sims = [(-round(float(np.dot(rows[q][1], v) / (np.linalg.norm(rows[q][1]) * (np.linalg.norm(v) or 1))), 6), i) for i, v in rows if i != q]
        assert [got[q, r] for r in range(1, 6)] == [i for _, i in sorted(sims)[:5]]


def test_cosine_topk_of_many_queries(spark, tmp_path, monkeypatch):
    """More queries than are laid out as rows are searched in blocks, with the same result."""
    from loomwright.plans import retrieval_queries

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)], i % 3) for i in range(0, 700, 7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = lambda: sorted(map(tuple, retrieval_queries.cosine_topk(spark, str(tmp_path)).select("query_id", "id", "score", "rank").collect()))
    whole = found()
    monkeypatch.setattr(vectors, "MOST_QUERIES", 0)
    assert len(whole) == 10 * sum(i % 100 == 0 for i, *_ in rows) and found() == whole
    vecs = spark.createDataFrame(rows[:5], "id long, embedding array<float>, label long")
    assert vectors.cosine_scores(vecs, vecs.withColumnRenamed("id", "query_id")).count() == 25


def test_cosines_are_rounded_once(spark):
    """0.1234564998 is 0.123456 to six digits, and not by way of nine digits 0.123457."""
    c = 0.1234564998
    vecs = spark.createDataFrame([(1, [c, math.sqrt(1 - c * c)]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert [(r.id, r.score) for r in vectors.cosine_top_k(vecs, asked, 2).orderBy("rank").collect()] == [(1, 0.123456), (2, 0.0)]


def test_best_rows_of_many_slices(monkeypatch):
    """Ties go to the smaller id, whichever slice they come in, and as Spark rounds."""
    from loomwright.operators import best

    monkeypatch.setattr(best, "WAITING", 7)
    rng = np.random.default_rng(2)
    score = np.round(rng.random((3, 60)), 1)
    score[1, 5:] = -np.inf
    ids = rng.permutation(60)
    held = best.Best(np.array([7, 8, 9]), 4, 6)
    for low in range(0, 60, 8):
        held.add(0, ids[low : low + 8], score[:2, low : low + 8])
        held.add(2, ids[low : low + 8], score[2:, low : low + 8])
    got = sorted((r["query_id"], -r["score"], r["id"]) for r in held.rows().to_pylist())
    assert got == [(q, -s, i) for n, q in enumerate((7, 8, 9)) for s, i in sorted(((s, i) for s, i in zip(score[n], ids, strict=True) if s >= 0), key=lambda x: (-x[0], x[1]))[:4]]
    assert best.rounded(np.array([0.0000005, -0.0000005, 1.4999999, 0.1234565]), 6).tolist() == [1, -1, 1500000, 123457]


def test_hash_vectors():
    v = vectors.hash_vector("Hybrid search of ranks", 64)
    assert math.isclose(float(np.linalg.norm(v)), 1.0, rel_tol=1e-5) and not vectors.hash_vector("", 64).any()
    same, other = vectors.hash_vector("hybrid search of ranked lists", 64), vectors.hash_vector("cooking pasta tonight", 64)
    assert v @ same > v @ other


def test_mmr_prefers_difference(spark):
    rows = [(1, 1, 1.0, 1, None, ["a", "b"]), (1, 2, 0.9, 2, None, ["a", "b"]), (1, 3, 0.5, 3, None, ["c"])]
    pool = spark.createDataFrame(rows, "query_id long, id long, score double, rank int, embedding array<double>, tokens array<string>")
    assert [r.id for r in vectors.mmr(pool, 2, 0.5).orderBy("pick").collect()] == [1, 3]
    assert [r.id for r in vectors.mmr(pool, 3, 1.0).orderBy("pick").collect()] == [1, 2, 3]


def test_rerank(spark):
    rows = [(1, "hybrid search fusion", 1, "hybrid search fusion ranks lists", "", "", "prose", 0.1, 1), (1, "hybrid search fusion", 2, "fusion " + "x " * 200 + "hybrid", "", "", "prose", 0.9, 2), (1, "hybrid search fusion", 3, "nothing", "", "hybrid", "code", 0.5, 3)]
    pool = spark.createDataFrame(rows, "query_id long, query string, id long, text string, heading_context string, document_title string, kind string, score double, rank int")
    f = {r.id: r for r in rerank.features(pool).collect()}
    assert f[1].proximity == 1.0 and f[1].phrase == 1.0 and f[1].coverage == 1.0 and f[2].proximity == 0.0
    assert f[3].coverage == 0 and f[3].heading == pytest.approx(1 / 3)
    assert [r.id for r in rerank.rerank(pool).orderBy("rank").collect()][0] == 1


def test_recursive_chunks():
    text = "Sentence one is here. " * 200
    got = chunking.recursive_chunks(text)
    assert all(c.start < c.end for c in got) and got[0].start == 0 and got[-1].end == len(text)
    assert all(b.text.startswith("Sentence") and b.start < a.end for a, b in zip(got, got[1:], strict=False))
    assert [len(c.text) for c in chunking.recursive_chunks("A" * 500, 200, 0, 50)] == [200, 200, 100]
    assert chunking.recursive_chunks("  ") == []
    with pytest.raises(ValueError):
        chunking.recursive_chunks("x", 100, 100)


def test_markdown_chunks():
    text = "Intro.\n\n# A\n\npara\n\n## B\n\n```py\n# no heading\n```\n\n| a |\n|---|\n\nTitle\n=====\n\nbody"
    got = chunking.markdown_chunks(text)
    assert [(c.path, c.kind) for c in got] == [([], "prose"), (["A"], "prose"), (["A", "B"], "code"), (["Title"], "prose")]
    assert got[2].text.startswith("A › B\n\n```py")


def test_code_chunks():
    got = chunking.code_chunks('import os\nimport re\n\nX = 1\n\ndef f():\n    """one line"""\n    return 1\n\nclass A:\n    pass\n')
    assert [(c.symbol, c.line, c.last_line) for c in got] == [(None, 1, 5), ("f", 6, 9), ("A", 10, 12)]
    assert len(chunking.code_chunks("a = 1\n" * 1000)) > 1


def test_time_windows():
    cues = [(f"c{i}", i * 10.0, 12.0) for i in range(8)]
    got = chunking.time_windows(cues, 40)
    assert got[0] == ("c0 c1 c2 c3", 0.0, 42.0) and got[-1][0].endswith("c7") and len(got) >= 2
    assert chunking.time_windows([("", 0.0, 1.0)], 5) == []


def test_chunks_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc, r.ordinal, r.text) for r in chunking.chunk_documents(docs, "recursive").collect()] == [(1, 0, "a b c")]


PAGE = """<html lang="en-GB"><head><title>T — Site</title><meta name="author" content="Ann"></head><body><nav><a href="/x">x</a></nav>
<article><h1>Head</h1><p>Some <code>code</code> in text that goes on for a good while so that it is long enough to count as content of a page.</p>
<ul><li>one</li><li>two</li></ul><pre>x = 1</pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table><p>And more text, again long enough that two hundred characters are reached by all of it together.</p></article>
<footer>foot</footer><a href="https://o.org/a/#f">o</a><a href="mailto:x@y">m</a><a href="/p.png">i</a></body></html>"""


def test_html_to_markdown(spark):
    r = html.parse_pages(spark.createDataFrame([("https://s.org/d/", PAGE), ("u", None)], "url string, html string")).orderBy("url").first()
    assert (r.title, r.author, r.language, r.error) == ("Head", "Ann", "en", None)
    assert r.links == ["https://s.org/x", "https://o.org/a"]
    assert r.text.startswith("# Head\n\nSome `code` in text") and "- one\n- two" in r.text and "```\nx = 1\n```" in r.text and "| a | b |\n|---|---|\n| 1 |  |" in r.text and "foot" not in r.text


def test_pack(spark):
    rows = [(1, i, i, "x" * (4 * n)) for i, n in ((1, 900), (2, 300), (3, 80), (4, 20), (5, 5))]
    got = answer.pack(spark.createDataFrame(rows, "query_id long, id long, rank int, text string"), 1000).orderBy("marker").collect()
    assert [(r.id, r.marker) for r in got] == [(1, 1), (3, 2), (4, 3)]


def test_answers_and_verification(spark):
    chunks = [(1, 1, "RRF uses a constant of 60 by default. Hybrid search combines ranked lists by fusion of their ranks.", "", "d"), (1, 2, "Cooking pasta takes ten minutes in a large pot of water.", "", "e")]
    packed = spark.createDataFrame(chunks, "query_id long, marker int, text string, heading_context string, label string")
    asked = spark.createDataFrame([(1, "what constant does RRF use"), (2, "capital of France")], "query_id long, query string")
    got = {r.query_id: r for r in answer.extractive_answers(packed, asked).collect()}
    assert got[1].answer.startswith("RRF uses a constant of 60 by default. [1]") and got[2].refused
    claims = [(1, 0, "RRF uses a constant of 60 by default [1].", [1], False), (1, 1, "RRF uses a constant of 50 by default [1].", [1], False), (1, 2, "RRF does not use a constant of 60 by default [1].", [1], False), (1, 3, "Hybrid search is a thing that people do.", [], False), (1, 4, "Short.", [1], False), (1, 5, "Hybrid search combines lists of ranks [9].", [9], False)]
    rows = spark.createDataFrame(claims, "query_id long, idx int, text string, markers array<int>, refused boolean")
    out = {r.idx: r.verdict for r in verify.verify(rows, packed).collect()}
    assert out == {0: "supported", 1: "unsupported", 2: "unsupported", 3: "uncited", 4: "not_a_claim", 5: "unsupported"}
    f = verify.faithfulness(verify.verify(rows, packed)).first()
    assert (f.n_claims, f.n_supported, f.faithfulness) == (5, 1, 0.2)


@pytest.mark.parametrize(("text", "want"), [("combines ranks, not raw scores", False), ("it does not support that", True), ("rather than scores", False), ("it can't work", True), ("fails to load", True)])
def test_negation(spark, text, want):
    assert spark.range(1).select(verify.is_negated(F.lit(text)).alias("x")).first()["x"] is want


def test_markers():
    assert answer.strip_invalid("A [1, 9] b [7] c [2].", 2) == "A [1] b c [2]."
    assert [(s[0], s[3]) for s in answer.spans("First here. [1] Second one [2, 3].")] == [("First here. [1]", [1]), ("Second one [2, 3].", [2, 3])]


def test_metrics(spark):
    lists = spark.createDataFrame([(q, i, r) for q in (1, 2, 3) for r, i in enumerate((10, 20, 30, 40, 50), 1)], "query_id long, id long, rank int")
    qrels = spark.createDataFrame([(1, 20, 2), (1, 40, 1), (1, 99, 1), (2, 7, 1)], "query_id long, id long, grade int")
    m = {r.query_id: r for r in evaluate.metrics(lists, qrels).collect()}
    assert m[1].recall_3 == pytest.approx(1 / 3) and m[1].precision_5 == pytest.approx(2 / 5) and m[1].mrr == 0.5 and m[1].first_relevant_rank == 2
    assert m[1].map == pytest.approx((1 / 2 + 2 / 4) / 3) and m[2].mrr == 0 and m[2].recall_1 == 0 and m[3].excluded and m[3].mrr is None
    dcg, best = 3 / math.log2(3) + 1 / math.log2(5), 3 + 1 / math.log2(3) + 1 / math.log2(4)
    assert m[1].ndcg_5 == pytest.approx(dcg / best)
    s = {r.metric: r for r in evaluate.summary(evaluate.long_form(evaluate.metrics(lists, qrels), "a")).collect()}
    assert s["mrr"].n == 2 and s["mrr"].mean == 0.25


def test_analytics(spark):
    rng = np.random.default_rng(7)
    rows = [(c * 20 + i, [float(x) for x in rng.normal(size=8) * 0.05 + np.eye(8)[c]], c) for c in range(3) for i in range(20)]
    vecs = spark.createDataFrame(rows, "id long, embedding array<double>, label int")
    out = analytics.kmeans(vecs, 3).groupBy("label").agg(F.countDistinct("cluster").alias("n")).collect()
    assert all(r.n == 1 for r in out)
    points, share = analytics.pca_2d(vecs)
    assert points.count() == 60 and 0.5 < share <= 1
    box = analytics.unit_square(points).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert min(box) >= 0 and max(box) == pytest.approx(1)
    assert [analytics.suggest_k(n) for n in (1, 5, 6, 50, 1000)] == [1, 1, 2, 5, 12]


def test_store(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, 1, "e")], "k int, v int, x string")
    assert {r.k: r.x for r in store.upsert(old, new, ["k"], "v").collect()} == {1: "c", 2: "d", 3: "e"}
    rows = spark.range(100).repartition(5)
    assert [r.n for r in store.numbered(rows, [F.desc("id")], "n").orderBy(F.desc("id")).collect()] == list(range(100))
    assert sorted(r.id for r in store.even_sample(rows, [F.asc("id")], 7).collect()) == [int(i * 100 / 7) for i in range(7)]


def test_resolve_finds_every_contained_text(spark):
    bodies = ["alpha foo bar and more", "x foo barbaz y", "日本語の文章です", "Token", "tokens of foo  BAR\nqux", "nothing", None]
    texts = ["foo bar", "bar", "日本語", "ken", "o bar q", "foo", "a foo b", "no such text", "", "!", "oo bar and mor"]
    chunks = spark.createDataFrame([(i, "t", b) for i, b in enumerate(bodies)], "doc_id long, title string, text string")
    golden = spark.createDataFrame([(q, "text", t, 1 + q % 2) for q, t in enumerate(texts)], "query_id long, kind string, value string, grade int")
    form = lambda t: " ".join((t or "").lower().split())
    want = {(q, i, 1 + q % 2) for q, t in enumerate(texts) for i, b in enumerate(bodies) if form(t) and form(t) in form(b)}
    got = evaluate.resolve(golden, chunks).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and {q for q, *_ in want} == {0, 1, 2, 3, 4, 5, 6, 10}


def test_claims_are_decided_on_whole_texts(spark, tmp_path):
    from loomwright.plans.answer_queries import negation_full

    long = "The corpus holds many documents " * 10
    rows = [(1, long + "and is this so?"), (2, long + "and it is so."), (3, f"Here {long}follows:"), (4, long + "and is it? [1]")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.claim for r in negation_full(spark, str(tmp_path)).collect()} == {1: False, 2: True, 3: False, 4: False}
