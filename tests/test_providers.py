"""Connectors of archives and replies, plugged models, projections."""

from __future__ import annotations

import base64
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loomwright.operators import analytics, providers
from loomwright.sources import files


def test_notion_archives(spark):
    page = "Team space " + "a" * 32 + "/Plan " + "b" * 32 + ".md"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(page, "# Plan\n\nWhat we plan to do this year.")
        z.writestr("Short " + "c" * 32 + ".md", "tiny")
        z.writestr("Table " + "d" * 32 + "_all.csv", "Name,Owner\n" * 5)
        z.writestr("image.png", b"\x89")
    archives = spark.createDataFrame([("x.zip", bytearray(raw.getvalue())), ("bad.zip", bytearray(b"nothing"))], "path string, content binary")
    members = files.zip_members(archives)
    assert members.count() == 5 and members.where("error IS NOT NULL").count() == 1
    (r,) = files.notion_documents(members).collect()
    assert (r.title, r.page_id, r.ancestors, r.kind) == ("Plan", "b" * 32, ["Team space"], "md")


def test_repository_replies(spark):
    tree = {"tree": [{"path": "src/a.py", "type": "blob", "size": 10}, {"path": "node_modules/x.js", "type": "blob", "size": 10}, {"path": "src", "type": "tree"}, {"path": "b.py", "type": "blob", "size": 10**7}, {"path": "README.md", "type": "blob"}]}
    rows = spark.createDataFrame([("o/r", json.dumps(tree))], "repo string, reply string")
    assert [r.path for r in files.repo_tree(rows).collect()] == ["README.md", "src/a.py"] and files.repo_tree(rows, 1).count() == 1
    reply = lambda path, raw: (json.dumps({"path": path, "encoding": "base64", "content": base64.encodebytes(raw).decode()}),)
    got = {r.path: (r.text, r.error) for r in files.repo_contents(spark.createDataFrame([reply("a", "é = 1\n".encode() * 40), reply("b", b"ab\0c"), reply("c", b"\x10\x01")], "reply string")).collect()}
    assert got == {"a": ("é = 1\n" * 40, None), "b": (None, "binary file"), "c": ("\x10\x01", None)}


def test_transcripts_pages_and_names(spark):
    cues = [{"text": "[music]", "start": 0.0, "duration": 1.0}, {"text": "hello\nthere", "start": 1.0, "duration": 2.0}]
    rows = spark.createDataFrame([("v1", json.dumps(cues)), ("v2", json.dumps({"snippets": cues}))], "video string, reply string")
    assert sorted(tuple(r) for r in files.transcript_cues(rows).collect()) == [("v1", 1, "hello there", 1.0, 2.0), ("v2", 1, "hello there", 1.0, 2.0)]
    pages = spark.createDataFrame([("text/html", "x" * 90), ("image/png", "x" * 90), ("text/html", "x"), (None, None)], "t string, text string")
    assert [r.e for r in pages.select(files.page_error(F.col("t"), F.col("text")).alias("e")).collect()] == [None, "not a page of text", "too little text", "not a page of text"]
    names = spark.createDataFrame([(1, "a.md"), (2, "a.md"), (3, "b"), (4, "b"), (5, "a-1.md")], "id long, name string")
    got = {r.id: r.stored_name for r in files.unique_names(names).collect()}
    assert len(set(got.values())) == 5 and (got[1], got[3], got[4], got[5]) == ("a.md", "b", "b-1", "a-1.md") and got[2].startswith("a-1-")


def test_plugged_models(spark):
    texts = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id long, text string")
    got = {r.id: list(r.embedding) for r in providers.embed_by(texts, lambda t: [[1.0, float(len(x))] if x else None for x in t], dim=16, batch=2).collect()}
    assert got[1] == [1.0, 2.0] and got[2] == got[3] == [0.0] * 16
    with pytest.raises(Exception, match="1 results for"):
        providers.embed_by(texts.coalesce(1), lambda t: [[1.0]], batch=3).collect()
    packed = spark.createDataFrame([(1, 1, "one", "Bread rises for two hours."), (1, 2, "two", "Soup is hot.")], "query_id long, marker int, label string, text string")
    queries = spark.createDataFrame([(1, "how long?"), (2, "nothing?")], "query_id long, query string")
    said = {r.query_id: (r.answer, r.refused) for r in providers.answers_by(packed, queries, lambda p: ["Two hours [1][7]." if "two hours" in x else None for x in p]).collect()}
    assert said[1] == ("Two hours [1].", False) and said[2][1]


def test_plugged_judges(spark):
    rows = [(1, 0, 1, "Bread rises for two hours.", "Bread rises for two hours."), (1, 0, 2, "Bread rises for two hours.", "Soup."), (1, 1, 1, "Bread rises for two hours.", "Bread rises for two hours. Warm.")]
    pairs = spark.createDataFrame(rows, "query_id long, idx int, marker int, said string, text string")

    def judge(asked):
        return [None if t.endswith("Warm.") else json.dumps({"supported": "Bread" in t, "confidence": 0.9, "quote": t}) for _, t in asked]

    got = {r.idx: (r.score, r.quote) for r in providers.judged_by(pairs, judge).collect()}
    assert got[0] == (0.9, "Bread rises for two hours.") and got[1][0] == pytest.approx(1.0)


def test_projection_falls_back(spark):
    rows = spark.createDataFrame([(i, [float(i), float(i % 3), 1.0]) for i in range(9)], "id long, embedding array<double>")
    points, note = analytics.project(rows, methods={"umap": lambda _: 1 / 0})
    assert points.count() == 9 and note.startswith("umap: division by zero; pca, ")
    assert analytics.project(rows, "tsne")[1].startswith("tsne: not there; pca")
    mine = rows.select("id", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"))
    assert analytics.project(rows, methods={"mine": lambda _: mine})[1] == "mine"
