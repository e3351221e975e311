"""Index, BM25, vectors, fusion, reranking and diversity as queries. Queries are the whole ``benchmark`` table;
vector queries are all vectors with an id divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.operators import fusion, index, rerank, search, vectors
from loomwright.plans import sql
from loomwright.plans.catalogue import query
from loomwright.session import materialise, stored, table

TOKENS = "regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+')"


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def documents_index(spark: SparkSession, d: str, **options) -> index.TextIndex:
    """The stored index of the documents; the other queries read the table itself."""
    return index.documents_index(table(spark, d, "documents"), d, **options)


def documents_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stored hashed vectors of the documents."""
    return stored(spark, f"hash-vectors:{d}", lambda: materialise(vectors.hash_embed(table(spark, d, "documents")).select(F.col("doc_id").alias("id"), "embedding"), "vectors"))


@query("postings", f"SELECT term, doc_id AS id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY ALL")
def postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents")).select("term", "id", "n")


@query("postings_porter")
def postings_porter(spark: SparkSession, d: str) -> DataFrame:
    """The stemmed index; tested against SQLite's FTS5."""
    return search.postings(table(spark, d, "documents"), stemmed=True)


@query("doc_lengths", f"SELECT doc_id AS id, len({TOKENS})::BIGINT AS len FROM documents")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return search.analysed(table(spark, d, "documents"), "doc_id", {"text": 1.0}).select("id", "len")


@query("corpus_stats", f"SELECT count(*)::BIGINT AS n_docs, round(sum(len({TOKENS}))::DOUBLE / count(*), 6) AS avg_len FROM documents")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = search.corpus_stats(search.analysed(table(spark, d, "documents"), "doc_id", {"text": 1.0}))
    return stats.select("n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("idf_table", f"""WITH t AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents)
SELECT term, count(*)::BIGINT AS df, round(CASE WHEN ln((any_value(n) - count(*) + 0.5)/(count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((any_value(n) - count(*) + 0.5)/(count(*) + 0.5)) END, 6) AS idf FROM t, n GROUP BY term""")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    df = search.postings(docs).groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n"))))
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return df.select("term", "df", F.round(F.when(weight <= 0, search.LEAST_IDF).otherwise(weight), 6).alias("idf"))


@query("bm25_topk", sql.bm25() + "SELECT query_id, doc_id AS id, score, rank::INT AS rank FROM top")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_search(documents_index(spark, d), items(spark, d), 10)


@query("bm25_filtered", sql.bm25(where="WHERE lang = 'en' AND source <> 'src0'") + "SELECT query_id, doc_id AS id, score, rank::INT AS rank FROM top")
def bm25_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Filters act before the ranking and after the statistics."""
    docs = table(spark, d, "documents")
    return search.bm25_search(docs, items(spark, d), 10, allowed=docs.where("lang = 'en' AND source <> 'src0'"))


@query("bm25_min_score", sql.bm25() + "SELECT query_id, doc_id AS id, score FROM top WHERE score >= 5")
def bm25_min_score(spark: SparkSession, d: str) -> DataFrame:
    """The least score acts after the ranking."""
    return search.bm25_search(table(spark, d, "documents"), items(spark, d), 10).where("score >= 5").select("query_id", "id", "score")


FIELDS = {"text": 1.0, "source": 0.4, "lang": 0.25}


@query("bm25_column_weighted", f"""WITH f AS (SELECT doc_id, text AS t, source AS s, lang AS l FROM documents), q AS (SELECT * FROM (VALUES (1,'en'),(1,'src1'),(2,'the'),(2,'fr'),(3,'src2'),(3,'de')) v(query_id, term)),
toks AS (SELECT doc_id, regexp_extract_all(lower(t), '[a-z0-9]+') AS a, regexp_extract_all(lower(s), '[a-z0-9]+') AS b, regexp_extract_all(lower(l), '[a-z0-9]+') AS c FROM f),
stats AS (SELECT count(*) AS n, sum(len(a)+len(b)+len(c))::DOUBLE/count(*) AS avg_len FROM toks),
occ AS (SELECT doc_id, unnest(a) AS term, 1.0 AS w FROM toks UNION ALL SELECT doc_id, unnest(b), 0.4 FROM toks UNION ALL SELECT doc_id, unnest(c), 0.25 FROM toks),
tf AS (SELECT doc_id, term, sum(w)::DOUBLE AS f FROM occ WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, greatest(ln((any_value(n)-count(*)+0.5)/(count(*)+0.5)), 1e-6) AS idf FROM tf, stats GROUP BY term),
s AS (SELECT query_id, doc_id, round(sum(idf*f*2.2/(f+1.2*(0.25+0.75*(len(a)+len(b)+len(c))/avg_len))), 6) AS score FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN toks USING (doc_id), stats GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id AS id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_column_weighted(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "en src1"), (2, '"the" fr'), (3, "src2 de")], "query_id long, query string")
    return search.bm25_search(documents_index(spark, d, fields=FIELDS), asked, 10)


@query("bm25_prefix", f"""WITH q AS (SELECT * FROM (VALUES (1,'tion'),(2,'edthe'),(3,'queel')) v(query_id, p)),
toks AS (SELECT doc_id, {TOKENS} AS w FROM documents), stats AS (SELECT count(*) AS n, sum(len(w))::DOUBLE/count(*) AS avg_len FROM toks),
occ AS (SELECT doc_id, unnest(w) AS term FROM toks),
ph AS (SELECT query_id, p, 'term' AS kind FROM q UNION ALL SELECT query_id, p, 'prefix' FROM q WHERE length(p) >= 5),
tf AS (SELECT query_id, p, kind, doc_id, count(*)::DOUBLE AS f FROM occ JOIN ph ON CASE WHEN kind = 'term' THEN term = p ELSE starts_with(term, p) END GROUP BY ALL),
idf AS (SELECT p, kind, greatest(ln((any_value(n)-count(*)+0.5)/(count(*)+0.5)), 1e-6) AS idf FROM tf, stats GROUP BY p, kind),
s AS (SELECT query_id, doc_id, round(sum(idf*f*2.2/(f+1.2*(0.25+0.75*len(w)/avg_len))), 6) AS score FROM tf JOIN idf USING (p, kind) JOIN toks USING (doc_id), stats GROUP BY ALL)
SELECT query_id::BIGINT AS query_id, doc_id AS id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, "tion"), (2, "edthe"), (3, "queel")], "query_id long, query string")
    return search.bm25_search(documents_index(spark, d), asked, 10, prefix_expansion=True)


@query("bm25_phrase", f"""WITH toks AS (SELECT doc_id, {TOKENS} AS w FROM documents), stats AS (SELECT count(*) AS n, sum(len(w))::DOUBLE/count(*) AS avg_len FROM toks),
q AS (SELECT * FROM (VALUES (1,['of','the']),(2,['in','the','and']),(3,['de','la'])) v(query_id, p)),
pl AS (SELECT doc_id, w, unnest(range(1, len(w)+1)) AS i FROM toks),
tf AS (SELECT query_id, doc_id, count(*)::DOUBLE AS f FROM pl JOIN q ON w[i:i+len(p)-1] = p GROUP BY ALL),
idf AS (SELECT query_id, greatest(ln((any_value(n)-count(*)+0.5)/(count(*)+0.5)), 1e-6) AS idf FROM tf, stats GROUP BY query_id),
s AS (SELECT query_id, doc_id, round(idf*f*2.2/(f+1.2*(0.25+0.75*len(w)/avg_len)), 6) AS score FROM tf JOIN idf USING (query_id) JOIN toks USING (doc_id), stats)
SELECT query_id::BIGINT AS query_id, doc_id AS id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def bm25_phrase(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([(1, '"of the"'), (2, '"in the and"'), (3, '"de la"')], "query_id long, query string")
    return search.bm25_search(documents_index(spark, d), asked, 10)


@query("bm25_porter")
def bm25_porter(spark: SparkSession, d: str) -> DataFrame:
    """Stemmed, with prefixes; tested against SQLite's FTS5."""
    return search.bm25_search(documents_index(spark, d, stemmed=True), items(spark, d), 10, prefix_expansion=True)


def vector_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows, rows.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def _cosine(where: str, k: int = 10) -> str:
    inner = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    size = "sqrt(list_inner_product({0}.embedding::DOUBLE[], {0}.embedding::DOUBLE[]))"
    return f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round({inner} / ({size.format('q')} * {size.format('v')}), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 {where})
SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= {k}"""


@query("cosine_topk_gemm", _cosine(""))
def cosine_topk_gemm(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cosine_top_k(*vector_tables(spark, d))


@query("cosine_topk", _cosine(""))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same by expressions alone; for many queries, whose scores would all be shuffled, by blocks as well."""
    rows, asked = vector_tables(spark, d)
    return search.top_k(vectors.cosine_scores(rows, asked), 10) if vectors.few(asked) else vectors.cosine_top_k(rows, asked)


@query("similar_vectors", _cosine("AND q.vec_id <> v.vec_id", 5))
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors.cosine_top_k(*vector_tables(spark, d), k=5, exclude_self=True)


@query("cosine_filtered_topk", _cosine("AND v.label IN (1, 3, 5)"))
def cosine_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = vector_tables(spark, d)
    return vectors.cosine_top_k(rows.where(F.col("label").isin(1, 3, 5)), asked)


@query("l2_normalize", """WITH n AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)
SELECT id, round(n, 6) AS norm, round(list_sum(list_transform(e, lambda x: x / n)), 6) AS unit_sum FROM n""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    unit = F.aggregate(vectors.l2_normalize(e), F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(vectors.norm(e), 6).alias("norm"), F.round(unit, 6).alias("unit_sum"))


@query("hash_embed_documents")
def hash_embed_documents(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hash_embed(table(spark, d, "documents")).select("doc_id", "embedding")


def dense_list(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Each item's best documents by hashed vectors."""
    asked = vectors.hash_embed(items(spark, d), "query").select("query_id", "embedding")
    return vectors.cosine_top_k(documents_vectors(spark, d), asked, k)


@query("hash_embed_search")
def hash_embed_search(spark: SparkSession, d: str) -> DataFrame:
    return dense_list(spark, d, 10)


@query("hybrid_search")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 and hashed vectors, fused by reciprocal ranks: the best ten of each item."""
    lexical = search.bm25_search(documents_index(spark, d), items(spark, d), 50)
    return fusion.fuse(lexical, dense_list(spark, d, 50)).where("rank <= 10")


def two_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """BM25's best 50 and the best 50 vectors for each item, whose own vector has its id."""
    rows, _ = vector_tables(spark, d)
    asked = items(spark, d).join(rows.select(F.col("id").alias("query_id"), "embedding"), "query_id").select("query_id", "embedding")
    return search.bm25_search(documents_index(spark, d), items(spark, d), 50), vectors.cosine_top_k(rows.select("id", "embedding"), asked, 50)


def fused_clauses(scores: dict[str, str]) -> str:
    """WITH clauses of the two lists and of a fused list for each name and score."""
    scaled = lambda t: f"(SELECT *, CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS scaled FROM {t} WINDOW w AS (PARTITION BY query_id))"
    both = f"fu AS (SELECT query_id, doc_id AS id, l.rank AS lr, l.score AS lsc, l.scaled AS ls, v.rank AS dr, v.score AS dsc, v.scaled AS ds FROM {scaled('top')} l FULL JOIN {scaled('den')} v USING (query_id, doc_id))"
    lists = [f"g_{name} AS (SELECT *, round({score}, 6) AS score FROM fu), {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM g_{name})" for name, score in scores.items()]
    return f"{sql.bm25(50)}, {sql.cosine(50)}, {both}, {', '.join(lists)}"


def _fused(score: str, extra: str = "") -> str:
    return f"{fused_clauses({'r': score})} SELECT query_id, id, score, rank::INT AS rank{extra} FROM r"


@query("fuse_rrf", _fused("coalesce(0.65/(60+lr), 0) + coalesce(0.35/(60+dr), 0)"))
def fuse_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*two_lists(spark, d), "rrf").select("query_id", "id", "score", "rank")


@query("fuse_weighted", _fused("0.65*coalesce(ls, 0) + 0.35*coalesce(ds, 0)"))
def fuse_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*two_lists(spark, d), "weighted").select("query_id", "id", "score", "rank")


@query("fuse_max", _fused("greatest(coalesce(ls, 0), coalesce(ds, 0))"))
def fuse_max(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(*two_lists(spark, d), "max").select("query_id", "id", "score", "rank")


@query("score_explain", _fused("coalesce(0.65/(60+lr), 0) + coalesce(0.35/(60+dr), 0)", """, concat_ws(', ', format('score {:.6f}', score), CASE WHEN lr IS NOT NULL THEN format('lexical #{} ({:.6f})', lr, lsc) END, CASE WHEN dr IS NOT NULL THEN format('dense #{} ({:.6f})', dr, dsc) END) AS explanation"""))
def score_explain(spark: SparkSession, d: str) -> DataFrame:
    return fusion.explain(fusion.fuse(*two_lists(spark, d), "rrf")).select("query_id", "id", "score", "rank", "explanation")


def pool(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    """Each item's best k documents by BM25 with their texts."""
    docs = table(spark, d, "documents")
    hits = materialise(search.bm25_search(documents_index(spark, d), items(spark, d), k), "pool")
    rows = hits.join(docs.select(F.col("doc_id").alias("id"), "text", F.col("source").alias("document_title"), F.lit("").alias("heading_context"), F.lit("prose").alias("kind")), "id")
    return materialise(rows.join(items(spark, d), "query_id"), "candidates")  # its users read it several times, each time through all documents


RERANK_TERMS = f"""{sql.bm25(30)}, terms AS (SELECT query_id, list_distinct(a) AS t FROM qb),
cand AS (SELECT query_id, doc_id, text, regexp_extract_all(lower(text), '[a-z0-9_]+(?:''[a-z]+)?') AS k FROM top JOIN documents USING (doc_id)),
ct AS (SELECT query_id, doc_id, k, unnest(t) AS term FROM cand JOIN terms USING (query_id)),
m AS (SELECT query_id, doc_id, term, len(k) AS n_tok, len(list_filter(k, lambda x: starts_with(x, term))) > 0 AS anywhere,
 list_min(list_transform(list_filter(list_zip(k, range(len(k))), lambda x: x[1] = term OR (length(term) >= 5 AND starts_with(x[1], term))), lambda x: x[2])) AS first FROM ct),
rdf AS (SELECT query_id, term, sum(anywhere::INT) AS df, count(*) AS n FROM m GROUP BY ALL),
ridf AS (SELECT query_id, term, ln(1 + (n - df + 0.5)/(df + 0.5)) AS idf FROM rdf)"""


@query("rerank_coverage", RERANK_TERMS + "SELECT query_id, doc_id AS id, round(sum(CASE WHEN first IS NOT NULL THEN idf ELSE 0 END) / sum(idf), 6) AS coverage FROM m JOIN ridf USING (query_id, term) GROUP BY ALL")
def rerank_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rerank.features(pool(spark, d)).select("query_id", "id", F.round("coverage", 6).alias("coverage"))


@query("rerank_first_position", RERANK_TERMS + "SELECT query_id, doc_id AS id, round(CASE WHEN min(first) IS NULL THEN 0 ELSE greatest(0, 1 - min(first)::DOUBLE / any_value(n_tok)) END, 6) AS position FROM m GROUP BY query_id, doc_id")
def rerank_first_position(spark: SparkSession, d: str) -> DataFrame:
    return rerank.features(pool(spark, d)).select("query_id", "id", F.round("position", 6).alias("position"))


@query("rerank_phrase_run", RERANK_TERMS + """, x AS (SELECT query_id, doc_id, t, unnest(k) AS tok, unnest(range(len(k))) AS i FROM cand JOIN terms USING (query_id)),
y AS (SELECT query_id, doc_id, t, i, i - row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i) AS g FROM x WHERE list_contains(t, tok)),
z AS (SELECT query_id, doc_id, any_value(len(t)) AS n, count(*) AS run FROM y GROUP BY query_id, doc_id, g)
SELECT query_id, doc_id AS id, round(CASE WHEN len(t) < 2 OR coalesce(run, 0) < 2 THEN 0 ELSE least(1.0, run::DOUBLE / len(t)) END, 6) AS phrase
FROM (SELECT query_id, doc_id, t FROM cand JOIN terms USING (query_id)) LEFT JOIN (SELECT query_id, doc_id, max(run) AS run FROM z GROUP BY ALL) USING (query_id, doc_id)""")
def rerank_phrase_run(spark: SparkSession, d: str) -> DataFrame:
    return rerank.features(pool(spark, d)).select("query_id", "id", F.round("phrase", 6).alias("phrase"))


@query("rerank_full")
def rerank_full(spark: SparkSession, d: str) -> DataFrame:
    return rerank.rerank(pool(spark, d)).select("query_id", "id", "rerank_score", "rank")


def _mmr_sql(picks: int = 8, balance: float = 0.7) -> str:
    """Each pick takes the best value of what is left, and what is left notes its likeness to it."""
    steps = []
    for k in range(picks):
        value = f"{balance}::DOUBLE * rel - (1 - {balance}::DOUBLE) * worst"
        steps.append(f"p{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {value} DESC, rank) AS best FROM c{k}) WHERE best = 1)")
        alike = "len(list_intersect(c.w, p.w))::DOUBLE / len(list_distinct(list_concat(c.w, p.w)))"
        steps.append(f"c{k + 1} AS (SELECT c.query_id, c.id, c.rank, c.w, c.rel, greatest(c.worst, coalesce({alike}, 0)) AS worst FROM c{k} c JOIN p{k} p USING (query_id) WHERE c.id <> p.id)")
    rel = "CASE WHEN max(score) OVER q - min(score) OVER q > 1e-12 THEN (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) ELSE 1.0 END"
    out = " UNION ALL ".join(f"SELECT query_id, id, {k + 1} AS pick FROM p{k}" for k in range(picks))
    return f"{sql.bm25(32)}, c0 AS (SELECT query_id, doc_id AS id, rank, list_distinct({sql.words('text')}) AS w, {rel} AS rel, 0.0::DOUBLE AS worst FROM top JOIN documents USING (doc_id) WINDOW q AS (PARTITION BY query_id)), {', '.join(steps)} {out}"


@query("mmr_select", _mmr_sql())
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    """Eight diverse documents of each item's best 32; similarity by words."""
    rows = pool(spark, d, 32).select("query_id", "id", "score", "rank", F.lit(None).cast("array<double>").alias("embedding"), F.array_distinct(X.words(F.col("text"))).alias("tokens"))
    return vectors.mmr(rows, 8)


@query("jaccard_pairs", f"""{sql.bm25(10)}, t AS (SELECT query_id, doc_id, list_distinct({sql.words('text')}) AS w FROM top JOIN documents USING (doc_id))
SELECT a.query_id, a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 6) AS jaccard FROM t a JOIN t b ON a.query_id = b.query_id AND a.doc_id < b.doc_id""")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Word overlap of the documents in each item's top ten."""
    rows = pool(spark, d, 10).select("query_id", F.col("id").alias("a"), F.array_distinct(X.words(F.col("text"))).alias("x"))
    other = rows.select("query_id", F.col("a").alias("b"), F.col("x").alias("y"))
    pairs = rows.join(other, "query_id").where("a < b")
    return pairs.select("query_id", "a", "b", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))
