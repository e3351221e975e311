from pyspark.sql import functions as F

from loomwright.functions.chunking import window_transcripts
from loomwright.plans import catalogue
from loomwright.sources import files, golden
from loomwright.streaming import events


def test_read_and_route(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "notes" / "a.md").write_text("---\ntitle: Front\ntags: x\n---\n# Head\n\nbody")
    (tmp_path / "notes" / "b-file.txt").write_bytes("caf\xe9".encode("cp1252"))
    (tmp_path / "node_modules" / "c.md").write_text("# no")
    rows = {r.name: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"notes/a.md", "notes/b-file.txt"}
    assert rows["notes/b-file.txt"].text == "café" and rows["notes/a.md"].connector == "markdown"
    doc = files.markdown_documents(files.read_files(spark, str(tmp_path), "*.md")).first()
    assert doc.title == "Front" and doc.text.startswith("# Head") and doc.meta["tags"] == "x"


def test_routes(spark):
    sources = ["inline:x", "a.md", "b.pdf", "c.csv", "https://youtu.be/abcdefghijk", "https://github.com/o/r", "https://x.org/p", f"P {'0' * 32}.md"]
    got = spark.createDataFrame([(s,) for s in sources], "s string").select(files.route(F.col("s")).alias("r")).collect()
    assert [r.r for r in got] == ["inline", "markdown", "pdf", "text", "youtube", "github", "web", "notion"]


def test_repositories_and_videos(spark):
    rows = spark.createDataFrame([("o/r",), ("gh:o/r",), ("https://github.com/o/r/tree/main/src/x",)], "s string").select(files.repo_source(F.col("s")).alias("x")).collect()
    assert [tuple(r.x) for r in rows] == [("o", "r", None, None)] * 2 + [("o", "r", "main", "src/x")]
    urls = ["https://www.youtube.com/watch?v=abcdefghijk&t=3", "https://youtu.be/abcdefghijk", "https://youtube.com/shorts/abcdefghijk", "abcdefghijk", "nothing"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(files.video_id(F.col("u")).alias("v")).collect()
    assert [r.v for r in got] == ["abcdefghijk"] * 4 + [None]
    paths = [("src/a.py", 10), ("node_modules/a.py", 10), ("a.lock", 10), ("a.py", 10**9), (".env", 1), ("x.min.js", 1)]
    got = spark.createDataFrame(paths, "p string, n long").select(files.is_indexable(F.col("p"), F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == [True, False, False, False, False, False]


def test_exports(spark):
    block = files.rows_to_blocks(spark.createDataFrame([("Svc", "Ann", "")], "Name string, Owner string, Tier string"), "Name", ["Owner", "Tier"]).first().block
    assert block == "## Svc\n\n- Owner: Ann"
    name = spark.range(1).select(files.notion_name(F.lit(f"a/My Page {'0' * 31}f.md")).alias("n"), files.notion_ancestors(F.lit(f"Top {'a' * 32}/Sub/x.md")).alias("a")).first()
    assert tuple(name.n) == ("My Page", "0" * 31 + "f") and name.a == ["Top", "Sub"]


def test_pdf_pages(spark):
    pages = [("d", i, f"ACME Manual\nText of page {i} with a bro-\nken word {i}.\n{i}") for i in range(1, 4)]
    got = files.clean_pdf_pages(spark.createDataFrame(pages, "doc string, page int, text string")).orderBy("page").collect()
    assert [r.text for r in got] == [f"Text of page {i} with a broken word {i}." for i in range(1, 4)]


def test_crawl_frontier(spark):
    links = spark.createDataFrame([("https://a.org/1", "https://a.org/2"), ("https://a.org/2", "https://a.org/3"), ("https://a.org/2", "https://a.org/1"), ("https://a.org/1", "https://b.org/x"), ("https://a.org/3", "https://a.org/4")], "source string, target string")
    seeds = spark.createDataFrame([("https://a.org/1",)], "url string")
    assert {(r.url[-1], r.depth) for r in files.frontier(links, seeds, 2).collect()} == {("1", 0), ("2", 1), ("3", 2)}


def test_golden(spark, tmp_path):
    text = "The retention window defaults to thirty days for every new workspace. It is also so. The result is a list of everything there was."
    got = golden.generate(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).collect()
    assert [(r.doc, r.question) for r in got] == [(1, "what does the retention window default to?")]
    (tmp_path / "g.jsonl").write_text('{"id": "a", "query": "q", "must_contain": ["x"], "tags": ["t"]}\n')
    rows = golden.read_golden(spark, str(tmp_path / "g.jsonl"))
    assert golden.tagged(rows, "t").count() == 1 and [r.tag for r in golden.all_tags(rows).collect()] == ["t"]


def test_transcripts(spark):
    cues = spark.createDataFrame([("v", i, f"c{i}", i * 10.0, 10.0) for i in range(6)], "video string, idx int, text string, start double, duration double")
    assert [r.text for r in window_transcripts(cues, 30.0).orderBy("idx").collect()] == ["c0 c1 c2", "c3 c4 c5"]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select id as event_id, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 7) as ts, id % 3 as user_id, concat('t', id % 2) as event_type, double(id) as value, '{}' as props from range(300)")
    rows.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = events.tumbling(events.read_events(spark, f"{tmp_path}/events"), "1 hour")
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    want = events.tumbling(rows, "1 hour")
    key = lambda r: (str(r.start), r.event_type, r.n, r.total)
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, want.collect()))


def test_stream_sink_keeps_latest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "k int, x string")
    write = events.upsert_into(f"{tmp_path}/t", ["k"])
    write(rows, 0)
    write(rows.withColumn("x", F.lit("b")), 1)
    write(rows.withColumn("x", F.lit("b")), 1)
    assert [(r.k, r.x) for r in events.latest(spark, f"{tmp_path}/t", ["k"]).collect()] == [(1, "b")]


def test_catalogue_is_whole():
    queries, oracles = catalogue.queries(), catalogue.oracle_sql()
    assert len(queries) > 90 and set(oracles) <= set(queries)
