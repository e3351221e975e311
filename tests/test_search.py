import math
import random
import re
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest

from loomwright.operators import index, search, segments

FIELDS = {"text": 1.0, "title": 0.25}
QUERIES = [(1, 'alpha beta "the the"'), (2, "gamma"), (3, "bet"), (4, "nothing"), (5, '"alpha beta" delta-gamma'), (6, "alphabet")]


def corpus() -> list[tuple]:
    rng = random.Random(4)
    words = ["alpha", "beta", "the", "gamma", "delta", "bet", "alphabet", "alphabets", "zz"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randint(0, 30)), text(rng.randint(0, 3))) for i in range(120)]
    return [*rows, *[(1000 - i, "gamma the the the", None) for i in range(20)], (2000, None, None)]


def brute(phrases: dict[int, list[tuple[str, list[str]]]], allowed: set[int] | None) -> dict[int, list[tuple[int, float]]]:
    docs = {i: [re.findall("[a-z0-9]+", (x or "").lower()) for x in (t, h)] for i, t, h in corpus()}
    size = {i: sum(map(len, d)) for i, d in docs.items()}
    mean = sum(size.values()) / len(size)

    def count(words: list[str], kind: str, tokens: list[str]) -> int:
        if kind == "prefix":
            return sum(w.startswith(tokens[0]) for w in words)
        return sum(words[p : p + len(tokens)] == tokens for p in range(len(words)))

    out = {}
    for q, asked in phrases.items():
        score: dict[int, float] = {}
        for kind, tokens in asked:
            f = {i: sum(w * count(x, kind, tokens) for x, w in zip(d, FIELDS.values(), strict=True)) for i, d in docs.items()}
            f = {i: x for i, x in f.items() if x}
            weight = math.log((len(docs) - len(f) + 0.5) / (len(f) + 0.5))
            for i, x in f.items():
                part = (weight if weight > 0 else 1e-6) * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * size[i] / mean))
                score[i] = score.get(i, 0) + part
        rows = sorted((-round(s, 6), i) for i, s in score.items() if allowed is None or i in allowed)
        out[q] = [(i, -s) for s, i in rows]
    return out


@pytest.mark.parametrize("prefixes", [False, True])
@pytest.mark.parametrize("stored", [False, True])
def test_bm25_against_brute_force(spark, monkeypatch, stored, prefixes):
    """Of a table and of an index, in several segments and blocks of queries; what reaches the ranking is k rows a task."""
    monkeypatch.setattr(search, "MOST_PAIRS", 4, raising=False)
    chunks = spark.createDataFrame(corpus(), "doc_id long, text string, title string")
    asked = spark.createDataFrame(QUERIES, "query_id long, query string")
    phrases: dict = {q: [] for q, _ in QUERIES}
    for r in search.phrases_of(asked, prefixes, False).collect():
        phrases[r.query_id].append((r.kind, list(r.tokens)))
    where = index.build_index(chunks, "doc_id", FIELDS) if stored else chunks
    allowed = chunks.where("doc_id % 3 = 0").select("doc_id")
    for some, ids in ((None, None), (allowed, {i for i, *_ in corpus() if i % 3 == 0})):
        want = brute(phrases, ids)
        got: dict = {}
        for r in sorted(search.bm25_search(where, asked, 7, allowed=some, fields=FIELDS, prefix_expansion=prefixes).collect(), key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.id, r.score))
        assert got == {q: [(i, pytest.approx(s, abs=1.1e-6)) for i, s in rows[:7]] for q, rows in want.items() if rows}
    every = search.bm25_scores(where, asked, fields=FIELDS, prefix_expansion=prefixes).count()
    assert every == sum(map(len, brute(phrases, None).values()))
    if stored:
        assert where.postings.select("segment").distinct().count() > 1
        cut = search._searched(where, asked, "doc_id", None, prefixes, False, None, 1, 6)
        assert cut.count() < every / 2


def test_segments():
    """Places by term, document and field; empty documents and fields count."""
    lists = lambda x: pa.array(x, pa.list_(pa.string()))
    table = segments.invert(np.array([7, 9, 8]), [lists([["b", "a", "b"], [], None]), lists([["a"], ["c"], []])])
    rows = {r["term"]: r for r in table.to_pylist()}
    assert list(rows) == ["", "a", "b", "c"] and all(a < b for a, b in pairwise(rows))
    assert np.frombuffer(rows[""]["docs"], np.int64).tolist() == [7, 9, 8] and np.frombuffer(rows[""]["counts"], np.int64).tolist() == [4, 1, 0]
    assert [np.frombuffer(rows["a"][c], k).tolist() for c, k in (("docs", "<u2"), ("fields", "u1"), ("counts", "<u4"), ("places", "<u4"))] == [[0, 0], [0, 1], [1, 1], [1, 0]]
    assert np.frombuffer(rows["b"]["places"], "<u4").tolist() == [0, 2]
    nothing = segments.invert(np.array([1]), [lists([[]])])
    hit = segments.Wanted([("term", ("a",)), ("phrase", ("a", "b")), ("prefix", ("a",))], [1.0]).hits(0, nothing)
    assert np.frombuffer(hit["dfs"][0].as_py(), np.int64).tolist() == [0, 0, 0, 1, 0]


def test_candidates_are_written_with_their_texts(spark, tmp_path):
    """What uses the candidates does not read all documents again."""
    from loomwright.plans import retrieval_queries

    spark.createDataFrame([(i, f"alpha {i} beta", "s", "en") for i in range(9)], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha 3 beta 4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = retrieval_queries.pool(spark, str(tmp_path), 5)
    assert rows.count() == 5 and not any("/documents.parquet" in f or "/benchmark.parquet" in f for f in rows.inputFiles())


def test_stemming_takes_texts_in_parts(spark, monkeypatch):
    """A worker holds the tokens of some texts, not of a whole batch of rows."""
    chunks = spark.createDataFrame([(i, "Running ponies " * 40) for i in range(50)] + [(50, None)], "doc_id long, text string").repartition(1)
    parts = search.analysed(chunks, "doc_id", {"text": 1.0}, True)
    assert "MapInArrow" in parts._jdf.queryExecution().toString() and "ArrowEvalPython" not in parts._jdf.queryExecution().toString()
    assert {(r.len, *r.text[:2]) for r in parts.collect()} == {(80, "run", "poni"), (0,)}
