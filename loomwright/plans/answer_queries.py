"""Chunks, store operations, answers, verification, evaluation, telemetry and analytics as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import chunking, html
from loomwright.functions import text as X
from loomwright.operators import analytics, answer, evaluate, search, store, telemetry, vectors, verify
from loomwright.plans import sql
from loomwright.plans.catalogue import query
from loomwright.plans.retrieval_queries import items, pool
from loomwright.session import materialise, table


# chunks ------------------------------------------------------------------------------------------------------


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "recursive")


@query("page_markdown")
def page_markdown(spark: SparkSession, d: str) -> DataFrame:
    return html.parse_pages(table(spark, d, "pages"))


@query("chunk_markdown")
def chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(html.parse_pages(table(spark, d, "pages")), "markdown", id_col="url")


@query("chunk_code")
def chunk_code(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(table(spark, d, "documents"), "code")


@query("chunk_neighbours", """SELECT a.conv_id, a.turn AS hit, b.turn, b.text FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.role = 'user'""")
def chunk_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    return store.neighbours(rows.select("conv_id", "turn", "text"), rows.where("role = 'user'"), "conv_id", "turn", 1)


@query("transcript_windows")
def transcript_windows(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as cues: a turn each ten seconds, windows of thirty."""
    rows = table(spark, d, "conversations")
    cues = rows.select(F.col("conv_id").alias("video"), F.col("turn").cast("int").alias("idx"), "text", (F.col("turn") * 10.0).alias("start"), F.lit(10.0).alias("duration"))
    return chunking.window_transcripts(cues, 30.0)


@query("transcript_fixed_windows", """SELECT conv_id AS video, (turn // 3)::BIGINT AS win, count(*)::BIGINT AS n_cues, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY ALL""")
def transcript_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("win", F.floor(F.col("turn") / 3))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ")
    return rows.groupBy(F.col("conv_id").alias("video"), "win").agg(F.count("*").alias("n_cues"), joined.alias("text"))


@query("csv_to_blocks", """SELECT c_custkey AS id, '## ' || c_name || chr(10) || chr(10) || concat_ws(chr(10), '- mktsegment: ' || c_mktsegment, '- acctbal: ' || CAST(c_acctbal AS DECIMAL(15,2)), '- nationkey: ' || c_nationkey) AS block FROM customer""")
def csv_to_blocks(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.sources.files import rows_to_blocks

    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("mktsegment"), F.col("c_acctbal").cast("decimal(15,2)").cast("string").alias("acctbal"), F.col("c_nationkey").cast("string").alias("nationkey"))
    return rows_to_blocks(rows, "name", ["mktsegment", "acctbal", "nationkey"]).select("id", "block")


# store -------------------------------------------------------------------------------------------------------


@query("anti_join_unembedded", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_join_unembedded(spark: SparkSession, d: str) -> DataFrame:
    return store.missing(table(spark, d, "documents").select("doc_id"), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), ["doc_id"])


@query("upsert_latest", """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("version"), "value")
    parts = rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == 0), rows.where(F.pmod(F.xxhash64("value"), F.lit(2)) == 1)
    return store.upsert(*parts, ["user_id", "event_type"], "version").select("user_id", "event_type", "value")


@query("cascade_delete", """SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0') AND doc_id IN (SELECT doc_id FROM documents)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    left, labels = store.delete_cascade(docs, table(spark, d, "labels"), "doc_id", docs.where("source = 'src0'").select("doc_id"))
    return labels.join(left.select("doc_id"), "doc_id", "left_semi")


@query("even_sample", """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS total FROM documents), w AS (SELECT DISTINCT (i * total // 97)::BIGINT AS pos FROM (SELECT any_value(total) AS total FROM n), range(97) r(i))
SELECT doc_id FROM n JOIN w USING (pos)""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    """97 evenly spaced documents (sampling is the feature)."""
    return store.even_sample(table(spark, d, "documents").select("doc_id"), [F.asc("doc_id")], 97)


@query("merge_collections", """WITH o AS (SELECT n_name AS name, CAST(n_regionkey AS VARCHAR) AS description, '' AS model FROM nation), n AS (SELECT r_name AS name, '' AS description, 'hash' AS model FROM region UNION ALL SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE '' END, 'hash' FROM nation WHERE n_nationkey < 10)
SELECT name, coalesce(nullif(n.description, ''), o.description) AS description, coalesce(nullif(n.model, ''), o.model) AS model FROM o FULL JOIN n USING (name)""")
def merge_collections(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    old = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("description"), F.lit("").alias("model"))
    new = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("").alias("description"), F.lit("hash").alias("model"))
    more = nation.where("n_nationkey < 10").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "new").otherwise("").alias("description"), F.lit("hash").alias("model"))
    return store.merge_collections(old, new.unionByName(more))


# answers -----------------------------------------------------------------------------------------------------


PACK = f"""{sql.bm25(30).replace('WITH', 'WITH RECURSIVE', 1)}, c AS (SELECT query_id, doc_id, rank, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS cost FROM top JOIN documents USING (doc_id)),
walk AS (SELECT query_id, rank, doc_id, cost AS used, 1 AS marker, cost, true AS taken FROM c WHERE rank = 1
 UNION ALL SELECT w.query_id, c.rank, c.doc_id, CASE WHEN w.used < 1500 AND w.used + c.cost <= 1500 THEN w.used + c.cost ELSE w.used END, CASE WHEN w.used < 1500 AND w.used + c.cost <= 1500 THEN w.marker + 1 ELSE w.marker END, c.cost, w.used < 1500 AND w.used + c.cost <= 1500 FROM walk w JOIN c ON c.query_id = w.query_id AND c.rank = w.rank + 1)
"""


@query("pack_context", PACK + "SELECT query_id, doc_id AS id, marker::INT AS marker, cost::BIGINT AS tokens FROM walk WHERE taken")
def pack_context(spark: SparkSession, d: str) -> DataFrame:
    return answer.pack(pool(spark, d), 1500)


def packed(spark: SparkSession, d: str) -> DataFrame:
    rows = pool(spark, d)
    return answer.pack(rows, 1500).join(rows.select("query_id", "id", "text", "heading_context", F.col("document_title").alias("label")), ["query_id", "id"])


@query("build_prompt", PACK + """SELECT query_id, 'Sources:' || repeat(chr(10), 2) || string_agg('[' || marker || '] ' || source || chr(10) || d.text, repeat(chr(10), 2) ORDER BY marker)
 || repeat(chr(10), 2) || '---' || repeat(chr(10), 2) || 'Question: ' || any_value(b.text) AS prompt FROM walk JOIN documents d USING (doc_id) JOIN benchmark b ON item_id = query_id WHERE taken GROUP BY query_id""")
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    return answer.prompt(packed(spark, d), items(spark, d))


@query("extractive_answer")
def extractive_answer(spark: SparkSession, d: str) -> DataFrame:
    return answer.extractive_answers(packed(spark, d), items(spark, d))


def answered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Sentences of the answers, and what they may cite."""
    chunks = materialise(packed(spark, d), "packed")
    rows = materialise(answer.extractive_answers(chunks, items(spark, d)), "answers")
    parts = rows.select("query_id", "refused", F.posexplode(F.split("answer", r"(?<=\]) ")).alias("idx", "text"))
    return parts.withColumn("markers", answer.markers(F.col("text"))), chunks


@query("verify_claims")
def verify_claims(spark: SparkSession, d: str) -> DataFrame:
    return verify.verify(*answered(spark, d))


@query("faithfulness")
def faithfulness(spark: SparkSession, d: str) -> DataFrame:
    return verify.faithfulness(verify.verify(*answered(spark, d)))


CITED = "text || ' [' || (doc_id % 7 + 1) || ', ' || (doc_id % 3 + 1) || '] And [' || (doc_id % 7 + 1) || '].'"


@query("parse_markers", f"""WITH t AS (SELECT doc_id, list_transform(flatten(list_transform(regexp_extract_all({CITED}, '\\[(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1), lambda m: string_split(m, ','))), lambda n: trim(n, ' ')::INT) AS m FROM documents),
p AS (SELECT doc_id, m[i] AS v, min(i) AS i FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM t) GROUP BY doc_id, m[i])
SELECT doc_id, string_agg(v, ',' ORDER BY i) AS markers FROM p GROUP BY doc_id""")
def parse_markers(spark: SparkSession, d: str) -> DataFrame:
    a, b = (F.col("doc_id") % 7 + 1).cast("string"), (F.col("doc_id") % 3 + 1).cast("string")
    text = F.concat("text", F.lit(" ["), a, F.lit(", "), b, F.lit("] And ["), a, F.lit("]."))
    return table(spark, d, "documents").select("doc_id", F.array_join(answer.markers(text).cast("array<string>"), ",").alias("markers"))


@query("negation_flags", r"""SELECT conv_id, turn, regexp_matches(lower(text), '\b(?:do|does|did|is|are|was|were)\s+not\b|\w+n''t\b|\b(?:never|cannot|neither|nor)\b|\bno\s+\w+|\bwithout\b') AS negated FROM conversations""")
def negation_flags(spark: SparkSession, d: str) -> DataFrame:
    """The part of the negation patterns that every engine's regular expressions know."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").rlike(r"\b(?:do|does|did|is|are|was|were)\s+not\b|\w+n't\b|\b(?:never|cannot|neither|nor)\b|\bno\s+\w+|\bwithout\b").alias("negated"))


@query("negation_full")
def negation_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", verify.is_negated(F.col("text")).alias("negated"), verify.is_claim(F.col("text")).alias("claim"))


@query("number_agreement", r"""SELECT o_orderkey AS id, regexp_extract_all(o_orderpriority || ' ' || o_totalprice::DECIMAL(15,2), '\d+(?:[.,]\d+)*%?')[-1] = o_totalprice::DECIMAL(15,2)::VARCHAR AS same_text,
abs(try_cast(replace(regexp_extract_all(o_orderpriority || ' ' || o_totalprice::DECIMAL(15,2), '\d+(?:[.,]\d+)*%?')[-1], ',', '') AS DOUBLE) - o_totalprice::DOUBLE) < 0.005 AS same_value FROM orders""")
def number_agreement(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(15,2)")
    last = F.try_element_at(F.regexp_extract_all(F.concat("o_orderpriority", F.lit(" "), price.cast("string")), F.lit(r"\d+(?:[.,]\d+)*%?"), F.lit(0)), F.lit(-1))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (last == price.cast("string")).alias("same_text"), (F.abs(X.normal_number(last) - F.col("o_totalprice").cast("double")) < 0.005).alias("same_value"))


PHRASES = ", ".join("'" + p.replace("'", "''").upper() + "'" for p in X.REFUSALS)
DECLINES = " OR ".join("contains(low, '" + p.replace("'", "''") + "')" for p in X.REFUSALS)


@query("refusals", f"""WITH t AS (SELECT lang, lower(text || ' ' || coalesce([{PHRASES}][doc_id % 25 + 1], '')) AS low FROM documents) SELECT lang, count(*)::BIGINT AS n FROM t WHERE {DECLINES} GROUP BY lang""")
def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Texts of which ten in 25 end with a phrase that declines."""
    phrase = F.try_element_at(X.lit_array([p.upper() for p in X.REFUSALS]), (F.col("doc_id") % 25 + 1).cast("int"))
    said = table(spark, d, "documents").select("lang", F.concat("text", F.lit(" "), F.coalesce(phrase, F.lit(""))).alias("text"))
    return said.where(X.looks_like_refusal(F.col("text"))).groupBy("lang").agg(F.count("*").alias("n"))


# events as verdicts: the user is the question, the kind of event the verdict
VERDICTS = {"view": "supported", "click": "unsupported", "purchase": "partial", "signup": "not_a_claim"}
VERDICT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in VERDICTS.items()) + " ELSE 'uncited' END"


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("idx"), F.expr(VERDICT).alias("verdict"))


@query("faithfulness_of_verdicts", f"""WITH v AS (SELECT user_id AS query_id, {VERDICT} AS verdict FROM events), c AS (SELECT query_id, count(*) FILTER (WHERE verdict <> 'not_a_claim') AS n, count(*) FILTER (WHERE verdict = 'supported') AS good FROM v GROUP BY query_id)
SELECT query_id, n::BIGINT AS n_claims, good::BIGINT AS n_supported, round(good::DOUBLE / nullif(n, 0), 4) AS faithfulness FROM c""")
def faithfulness_of_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verify.faithfulness(verdicts(spark, d))


@query("answer_flags", f"""WITH v AS (SELECT user_id AS query_id, event_id AS idx, {VERDICT} AS verdict FROM events)
SELECT query_id, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE verdict = 'unsupported'), '') AS unsupported, coalesce(string_agg(idx, ',' ORDER BY idx) FILTER (WHERE verdict IN ('unsupported', 'uncited', 'partial')), '') AS flagged FROM v GROUP BY query_id""")
def answer_flags(spark: SparkSession, d: str) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return verify.answer_flags(verdicts(spark, d)).select("query_id", joined("unsupported_sentences").alias("unsupported"), joined("flagged_sentences").alias("flagged"))


@query("reply_order", r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\d+'), lambda x: try_cast(x AS INTEGER) - 1), lambda v: v >= 0 AND v < 9) AS said FROM documents),
p AS (SELECT doc_id, v, min(i) AS i FROM (SELECT doc_id, unnest(said) AS v, generate_subscripts(said, 1) AS i FROM t) GROUP BY doc_id, v),
a AS (SELECT doc_id, v, coalesce(p.i, 1000000 + v) AS i FROM documents CROSS JOIN range(9) r(v) LEFT JOIN p USING (doc_id, v))
SELECT doc_id, string_agg(v, ',' ORDER BY i) AS ranking FROM a GROUP BY doc_id""")
def reply_order(spark: SparkSession, d: str) -> DataFrame:
    """Texts as ranking replies over nine candidates."""
    from loomwright.operators import rerank

    order = rerank.reply_order(F.col("text"), F.lit(9))
    return table(spark, d, "documents").select("doc_id", F.array_join(order.cast("array<string>"), ",").alias("ranking"))


# evaluation --------------------------------------------------------------------------------------------------

# judged by labels: each item's documents are those whose id leaves the item's id when divided by the number of items
QRELS = "nq AS (SELECT count(*) AS m FROM benchmark), qrels AS (SELECT doc_id % m AS query_id, doc_id AS id, quality + toxic AS grade FROM labels, nq)"
RANKED = "ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, id) AS rank FROM (SELECT doc_id % m AS query_id, doc_id AS id, n_chars FROM documents, nq))"


def judged_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    m = table(spark, d, "benchmark").count()
    docs = table(spark, d, "documents").select((F.col("doc_id") % m).alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "id")))
    qrels = table(spark, d, "labels").select((F.col("doc_id") % m).alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") + F.col("toxic")).alias("grade"))
    return ranked.select("query_id", "id", "rank"), qrels


def _metrics_sql(ranked: str = RANKED, label: str = "") -> str:
    """``m``: the metrics of the lists ``ranked``, per query or per label and query."""
    by = f"{label}query_id"
    ideal = f"(SELECT * FROM (SELECT DISTINCT {label.rstrip(', ')} FROM ranked), i)" if label else "i"
    parts, ideals, out = [], [], []
    for k in evaluate.CUTOFFS:
        parts.append(f"sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END) AS h{k}, sum(CASE WHEN rank <= {k} THEN (pow(2.0, grade) - 1)/log2(rank + 1.0) ELSE 0 END) AS dcg{k}")
        ideals.append(f"sum(CASE WHEN r <= {k} THEN (pow(2.0, grade) - 1)/log2(r + 1.0) ELSE 0 END) AS ideal{k}")
        out.append(f"CASE WHEN ok THEN round(h{k}::DOUBLE / least(relevant, {k}), 6) END AS recall_{k}, CASE WHEN ok THEN round(h{k}::DOUBLE / {k}, 6) END AS precision_{k}, CASE WHEN ok THEN (h{k} > 0)::INT::DOUBLE END AS hit_rate_{k}, CASE WHEN ok THEN round(dcg{k} / ideal{k}, 6) END AS ndcg_{k}")
    return f"""WITH {QRELS}, {ranked}, j AS (SELECT r.*, coalesce(grade, 0) AS grade, (coalesce(grade, 0) >= 1)::INT AS hit FROM ranked r LEFT JOIN qrels q USING (query_id, id)),
f AS (SELECT *, sum(hit) OVER (PARTITION BY {by} ORDER BY rank) AS found FROM j),
p AS (SELECT {by}, count(*) AS listed, min(CASE WHEN hit = 1 THEN rank END) AS first, sum(CASE WHEN hit = 1 THEN found::DOUBLE / rank END) AS ap, {", ".join(parts)} FROM f GROUP BY {by}),
i AS (SELECT query_id, sum((grade >= 1)::INT) AS relevant, {", ".join(ideals)} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS r FROM qrels WHERE grade > 0) GROUP BY query_id),
b AS (SELECT *, coalesce(relevant, 0) > 0 AS ok FROM p FULL JOIN {ideal} USING ({by})),
m AS (SELECT {by}, NOT ok AS excluded, first::INT AS first_relevant_rank, {", ".join(out)}, CASE WHEN ok THEN round(coalesce(1.0/first, 0), 6) END AS mrr, CASE WHEN ok THEN round(coalesce(ap / nullif(least(relevant, listed), 0), 0), 6) END AS map FROM b)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("metrics_per_query", _metrics_sql() + " SELECT * FROM m")
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.metrics(*judged_lists(spark, d)))


NAMES = [f"{m}_{k}" for k in evaluate.CUTOFFS for m in ("recall", "precision", "hit_rate", "ndcg")] + ["mrr", "map"]
SUMMARY = _metrics_sql() + f""", l AS (SELECT * FROM (UNPIVOT (SELECT query_id, {", ".join(NAMES)} FROM m) ON {", ".join(NAMES)} INTO NAME metric VALUE value) WHERE value IS NOT NULL)
SELECT 'long' AS label, metric, count(*)::BIGINT AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(coalesce(stddev_samp(value), 0), 4) AS stdev, round(min(value), 4) AS min, round(max(value), 4) AS max FROM l GROUP BY metric"""


@query("metric_summary", SUMMARY)
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.summary(evaluate.long_form(rounded(evaluate.metrics(*judged_lists(spark, d))), "long"))


def _sweep_sql() -> str:
    from loomwright.plans.retrieval_queries import fused_clauses

    lists = " UNION ALL ".join(f"SELECT '{x}' AS label, query_id, {i} AS id, rank FROM {t}" for x, i, t in (("lexical", "doc_id", "top"), ("dense", "doc_id", "den"), ("rrf", "id", "rrf"), ("weighted", "id", "weighted")))
    found = fused_clauses({"rrf": "coalesce(0.65/(60+lr), 0) + coalesce(0.35/(60+dr), 0)", "weighted": "0.65*coalesce(ls, 0) + 0.35*coalesce(ds, 0)"}).strip().removeprefix("WITH")
    values = f"SELECT label, metric, round(avg(value), 4) AS mean FROM (UNPIVOT (SELECT label, query_id, {', '.join(NAMES)} FROM m) ON {', '.join(NAMES)} INTO NAME metric VALUE value) WHERE value IS NOT NULL GROUP BY label, metric"
    return _metrics_sql(f"{found}, ranked AS ({lists})", "label, ") + f", s AS ({values}) SELECT s.label, metric, s.mean, round(s.mean - z.mean, 4) AS delta FROM s JOIN (SELECT metric, mean FROM s WHERE label = 'lexical') z USING (metric)"


@query("sweep_delta", _sweep_sql())
def sweep_delta(spark: SparkSession, d: str) -> DataFrame:
    """Lexical, dense and fused lists against the lexical one, judged by labels."""
    from loomwright.operators import fusion
    from loomwright.plans.retrieval_queries import two_lists

    lexical, dense = (materialise(x, "list") for x in two_lists(spark, d))
    qrels = materialise(judged_lists(spark, d)[1], "qrels")
    values = None
    for label, ranked in (("lexical", lexical), ("dense", dense), ("rrf", fusion.fuse(lexical, dense)), ("weighted", fusion.fuse(lexical, dense, "weighted"))):
        part = evaluate.long_form(rounded(evaluate.metrics(ranked.select("query_id", "id", "rank"), qrels)), label)
        values = part if values is None else values.unionByName(part)
    return evaluate.deltas(evaluate.summary(values).select("label", "metric", "mean"), "lexical")


@query("rank_histogram", _metrics_sql() + " SELECT least(coalesce(first_relevant_rank, 11), 11)::INT AS rank, count(*)::BIGINT AS n FROM m WHERE NOT excluded GROUP BY 1")
def rank_histogram(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_histogram(evaluate.metrics(*judged_lists(spark, d)))


@query("p95_latency", """SELECT event_type, l[(round_even(0.95 * (len(l) - 1), 0))::INT + 1] AS p FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type)""")
def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.nearest_rank(table(spark, d, "events"), "event_type", "value")


def expectations(spark: SparkSession, d: str) -> DataFrame:
    """What each item's text expects: the document that holds its middle words."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("text").alias("kind"), X.middle_words(F.col("text")).alias("value"), F.lit(2).alias("grade"))


def expected(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws(" ", F.lit("doc"), F.col("doc_id").cast("string")).alias("title"))
    m = table(spark, d, "benchmark").count()
    titles = table(spark, d, "labels").where("quality = 1").select((F.col("doc_id") % m).alias("query_id"), F.lit("title").alias("kind"), F.concat_ws(" ", F.lit("DOC"), F.col("doc_id").cast("string")).alias("value"), F.lit(1).alias("grade"))
    return evaluate.resolve(expectations(spark, d).unionByName(titles), docs)


MATCH = f"lower({sql.squeeze('text')})"


@query("qrels_resolve", f"""WITH t AS (SELECT item_id, list_filter(string_split({sql.squeeze('text')}, ' '), lambda w: w <> '') AS p FROM benchmark),
n AS (SELECT item_id AS query_id, lower(trim(regexp_replace(array_to_string(p[greatest(0, (len(p) - 8) // 2) + 1 : greatest(0, (len(p) - 8) // 2) + 8], ' '), '[.,;:]+$', ''), ' ')) AS needle FROM t),
h AS (SELECT query_id, doc_id AS id, 2 AS grade FROM n JOIN (SELECT doc_id, {MATCH} AS body FROM documents) ON contains(body, needle)),
l AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS query_id, doc_id AS id, 1 AS grade FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
SELECT query_id, id, max(grade)::INT AS grade FROM (SELECT * FROM h UNION ALL SELECT * FROM l) GROUP BY ALL""")
def qrels_resolve(spark: SparkSession, d: str) -> DataFrame:
    return expected(spark, d)


FIRST_WORDS = f"array_to_string(list_filter(string_split({sql.squeeze('text')}, ' '), lambda w: w <> '')[1 : 1 + item_id % 2], ' ')"


@query("qrels_short", f"""WITH n AS (SELECT item_id AS query_id, lower({FIRST_WORDS}) AS needle FROM benchmark)
SELECT query_id, doc_id AS id, 2 AS grade FROM n JOIN (SELECT doc_id, {MATCH} AS body FROM documents) ON needle <> '' AND contains(body, needle)""")
def qrels_short(spark: SparkSession, d: str) -> DataFrame:
    """Expectations of one and of two words, wherever they are contained."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("").alias("title"))
    first = F.slice(F.filter(F.split(X.squeeze(F.col("text")), " "), lambda w: w != ""), F.lit(1), (F.col("item_id") % 2 + 1).cast("int"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("text").alias("kind"), F.array_join(first, " ").alias("value"), F.lit(2).alias("grade"))
    return evaluate.resolve(asked, docs)


@query("golden_generate")
def golden_generate(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.sources.golden import generate

    return generate(table(spark, d, "documents"))


# telemetry ---------------------------------------------------------------------------------------------------


def retrievals(spark: SparkSession, d: str) -> DataFrame:
    """Events as a retrieval log: the user's number is the chunk, the kind of event the query."""
    return table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_type").alias("query"), F.left(F.sha2("event_type", 256), F.lit(16)).alias("query_hash"), (F.col("event_id") % 10 + 1).alias("rank"), F.col("value").alias("score"), F.col("ts").alias("created_at"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))


@query("heatmap", "SELECT user_id AS chunk_id, count(*)::BIGINT AS hits, round(avg(event_id % 10 + 1), 6) AS avg_rank, round(avg(value), 6) AS avg_score, max(ts) AS last_at FROM events WHERE user_id IN (SELECT doc_id FROM documents) GROUP BY user_id")
def heatmap(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.heatmap(retrievals(spark, d), chunk_ids(spark, d))


@query("recent_queries", "SELECT left(sha256(event_type), 16) AS query_hash, event_type AS query, max(ts) AS last_at, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def recent_queries(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.recent_queries(retrievals(spark, d))


@query("coverage", "SELECT count(*)::BIGINT AS chunks, sum((doc_id IN (SELECT user_id FROM events))::INT)::BIGINT AS retrieved, round(sum((doc_id IN (SELECT user_id FROM events))::INT)::DOUBLE / count(*), 6) AS share, (SELECT count(DISTINCT event_type) FROM events)::BIGINT AS queries FROM documents")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.coverage(retrievals(spark, d), chunk_ids(spark, d))


@query("never_retrieved", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM events)")
def never_retrieved(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.never_retrieved(retrievals(spark, d), chunk_ids(spark, d))


@query("retrieval_counts", "SELECT doc_id AS chunk_id, count(user_id)::BIGINT AS retrievals FROM documents LEFT JOIN events ON user_id = doc_id GROUP BY doc_id")
def retrieval_counts(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.counted(chunk_ids(spark, d), retrievals(spark, d))


@query("events_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.streaming.events import tumbling

    return tumbling(table(spark, d, "events"), "1 hour")


@query("events_sliding", "SELECT time_bucket(INTERVAL 15 minute, ts) - k * INTERVAL 15 minute AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events, range(4) r(k) GROUP BY ALL")
def events_sliding(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.streaming.events import sliding

    return sliding(table(spark, d, "events"), "1 hour", "15 minutes")


@query("events_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 hour THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 hour AS "end", count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_session(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.streaming.events import sessions

    return sessions(table(spark, d, "events"), "6 hours")


# analytics ---------------------------------------------------------------------------------------------------


@query("doc_centroids", """WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
p AS (SELECT label, i, avg(e[i]) AS x, count(*) AS n FROM u, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, max(n) AS n, list(x ORDER BY i) AS c FROM p GROUP BY label)
SELECT label, n::BIGINT AS n, round(c[1] / sqrt(list_inner_product(c, c)), 6) AS first, round(c[64] / sqrt(list_inner_product(c, c)), 6) AS last FROM c""")
def doc_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.centroids(table(spark, d, "embeddings"), "label")
    return c.select("label", "n", F.round(F.col("centroid")[0], 6).alias("first"), F.round(F.element_at("centroid", -1), 6).alias("last"))


@query("centroid_graph", """WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
p AS (SELECT label, i, avg(e[i]) AS x FROM u, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label),
s AS (SELECT a.label AS q, b.label AS id, round(list_inner_product(a.c, b.c) / sqrt(list_inner_product(a.c, a.c) * list_inner_product(b.c, b.c)), 6) AS score FROM c a, c b WHERE a.label <> b.label),
t AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)
SELECT DISTINCT least(q, id)::BIGINT AS a, greatest(q, id)::BIGINT AS b, round(score, 4) AS weight FROM t WHERE rank <= 6 AND score >= -0.05""")
def centroid_graph(spark: SparkSession, d: str) -> DataFrame:
    c = materialise(vectors.centroids(table(spark, d, "embeddings"), "label").select(F.col("label").cast("long").alias("label"), "centroid"), "centroids")
    return vectors.similarity_graph(c, "label", "centroid", 6, -0.05)


def _distinctive(column: str) -> str:
    from loomwright.functions.text import LABEL_STOPWORDS, STOPWORDS

    stop = ",".join(f"'{w}'" for w in sorted({*STOPWORDS, *LABEL_STOPWORDS}))
    return f"""WITH r AS (SELECT {column} AS cluster, list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_-]{{2,}}'), lambda t: t NOT IN ({stop})) AS w FROM documents),
z AS (SELECT cluster, count(*) AS texts FROM r GROUP BY cluster), y AS (SELECT cluster, term, count(*) AS y FROM (SELECT cluster, unnest(w) AS term FROM r) GROUP BY ALL),
df AS (SELECT cluster, term, count(*) AS df FROM (SELECT cluster, unnest(list_distinct(w)) AS term FROM r) GROUP BY ALL), n AS (SELECT term, sum(y)::DOUBLE AS n FROM y GROUP BY term),
t AS (SELECT cluster, sum(y)::DOUBLE AS big FROM y GROUP BY cluster), w AS (SELECT sum(n) AS total, count(*) AS v FROM n),
s AS (SELECT cluster, term, round(ln((y + 0.01)/greatest(big + 0.01*v - y - 0.01, 1e-9)) - ln((n - y + 0.01)/greatest(total - big + 0.01*v - (n - y) - 0.01, 1e-9)) + 0.05*ln(1.0 + df), 6) AS score
 FROM y JOIN df USING (cluster, term) JOIN n USING (term) JOIN t USING (cluster) JOIN z USING (cluster), w WHERE texts < 4 OR df >= 2)
SELECT cluster, term, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 4"""


@query("distinctive_terms", _distinctive("lang"))
def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    return analytics.distinctive_terms(table(spark, d, "documents"), "lang")


@query("suggest_k", "SELECT source, CASE WHEN count(*) < 6 THEN 1 ELSE greatest(2, least(12, round_even(sqrt(count(*) / 2.0), 0)))::INT END AS k FROM documents GROUP BY source")
def suggest_k(spark: SparkSession, d: str) -> DataFrame:
    n = F.count("*")
    k = F.when(n < 6, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(12), F.bround(F.sqrt(n / 2), 0).cast("int"))))
    return table(spark, d, "documents").groupBy("source").agg(k.alias("k"))


@query("unit_square", """WITH p AS (SELECT event_id AS id, value AS x, (user_id % 37)::DOUBLE AS y FROM events), b AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM p)
SELECT id, round((x - x0)/s, 6) AS x, round((y - y0)/s, 6) AS y FROM p, b""")
def unit_square(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), (F.col("user_id") % 37).cast("double").alias("y"))
    return analytics.unit_square(points).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("cluster_coherence", """WITH u AS (SELECT label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS e FROM embeddings),
p AS (SELECT label, i, avg(e[i]) AS x FROM u, range(1, 65) r(i) GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM p GROUP BY label)
SELECT label, count(*)::BIGINT AS n, round(avg(list_inner_product(e, c) / sqrt(list_inner_product(c, c))), 6) AS coherence FROM u JOIN c USING (label) GROUP BY label""")
def cluster_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return analytics.coherence(rows, "label", vectors.centroids(rows, "label"))


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return analytics.kmeans(rows, 10).select("id", "cluster")


@query("pca_2d")
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    return analytics.pca_2d(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))[0]


@query("corpus_map")
def corpus_map(spark: SparkSession, d: str) -> DataFrame:
    return analytics.corpus_map(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), retrievals(spark, d))


# plain relational queries ------------------------------------------------------------------------------------


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("top_customers", "SELECT o_custkey, count(*)::BIGINT AS n_orders FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_customers(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders")).orderBy(F.desc("n_orders"), "o_custkey").limit(20)


@query("semi_anti_orders", "SELECT count(*)::BIGINT AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").agg(F.count("*").alias("n"))
