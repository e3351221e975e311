"""Text functions, listings, tokens, sentences and addresses as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import text as X
from loomwright.plans import sql
from loomwright.plans.catalogue import query
from loomwright.session import table


@query("doc_hash_dedup", """SELECT doc_id, sha256(text) AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def doc_hash_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each source and content hash."""
    rows = table(spark, d, "documents").select("doc_id", "source", X.content_hash(F.col("text")).alias("content_hash"))
    return rows.groupBy("source", "content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "content_hash")


@query("near_dup_line_counts", """SELECT source, line, count(DISTINCT doc_id)::BIGINT AS n_docs FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) BETWEEN 1 AND 119 GROUP BY source, line HAVING count(DISTINCT doc_id) >= 3""")
def near_dup_line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Short lines that at least three documents of a source have."""
    rows = table(spark, d, "documents").select("source", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    rows = rows.where(F.length("line").between(1, 119))
    return rows.groupBy("source", "line").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


@query("token_estimate_stats", """SELECT lang, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens, count(*)::BIGINT AS n FROM documents GROUP BY lang""")
def token_estimate_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents")
    return rows.groupBy("lang").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("n"))


@query("tokenize_counts", f"SELECT doc_id, len({sql.words('text')})::BIGINT AS n_words FROM documents")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.words(F.col("text"))).cast("long").alias("n_words"))


@query("doc_frequency", f"SELECT w AS term, count(*)::BIGINT AS df FROM (SELECT DISTINCT doc_id, unnest({sql.words('text')}) AS w FROM documents) GROUP BY w")
def doc_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(F.explode(F.array_distinct(X.words(F.col("text")))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@query("sentence_split", f"SELECT doc_id, len({sql.sentences('text')})::BIGINT AS n_sentences, sha256(array_to_string({sql.sentences('text')}, chr(31))) AS joined FROM documents")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    s = X.raw_sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.sha2(F.array_join(s, "\u001f"), 256).alias("joined"))


LAST_WORD = r"lower(regexp_extract(regexp_replace(acc, '[.]+$', ''), '([^ \t\n\r\f\x0B\x1F]+)$', 1))"
ABBREVIATED = ", ".join(f"'{a}'" for a in X.ABBREVIATIONS)


@query("sentence_split_merged", f"""WITH t AS (SELECT doc_id, {sql.sentences('text')} AS raw FROM documents),
m AS (SELECT doc_id, string_split(list_reduce(list_transform(raw, lambda x: trim(x, ' ')), lambda acc, x: acc || CASE WHEN {LAST_WORD} IN ({ABBREVIATED}) THEN ' ' ELSE chr(31) END || x), chr(31)) AS s FROM t WHERE len(raw) > 0)
SELECT doc_id, (unnest(range(len(s))))::INT AS idx, unnest(s) AS sentence FROM m""")
def sentence_split_merged(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with abbreviations rejoined; see tests for the brute-force version."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("idx", "sentence"))


@query("bigram_counts", f"""WITH t AS (SELECT doc_id, {sql.words('text')} AS w FROM documents), p AS (SELECT w, unnest(range(1, len(w))) AS i FROM t)
SELECT w[i] || '_' || w[i+1] AS bigram, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select(X.words(F.col("text")).alias("w")).select(F.explode(X.bigrams(F.col("w"))).alias("bigram"))
    return rows.groupBy("bigram").agg(F.count("*").alias("n"))


@query("char4gram_counts", f"""WITH t AS (SELECT lower({sql.squeeze('text')}) AS c FROM benchmark), p AS (SELECT c, unnest(range(1, length(c) - 2)) AS i FROM t)
SELECT substring(c, i, 4) AS gram, count(*)::BIGINT AS n FROM p GROUP BY ALL""")
def char4gram_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.explode(X.ngrams(F.col("text"), 4)).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


@query("normalize_whitespace", rf"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{sql.WS}+|{sql.WS}+$', '', 'g')) AS clean FROM documents""")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(X.normalize_whitespace(F.col("text")), 256).alias("clean"))


@query("extract_terms", f"""WITH a AS (SELECT item_id, {sql.all_terms('text')} AS a FROM benchmark),
b AS (SELECT item_id, CASE WHEN len(list_filter(a, lambda t: t NOT IN ({sql.STOP}))) > 0 THEN list_filter(a, lambda t: t NOT IN ({sql.STOP})) ELSE a END AS a FROM a),
p AS (SELECT item_id, a[i] AS t, i FROM (SELECT item_id, a, unnest(range(1, len(a) + 1)) AS i FROM b))
SELECT item_id, string_agg(t, ' ' ORDER BY i) AS terms FROM (SELECT item_id, t, min(i) AS i FROM p GROUP BY ALL) GROUP BY item_id""")
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.array_join(X.terms(F.col("text")), " ").alias("terms")).where("terms <> ''")


@query("snippet", "SELECT doc_id, CASE WHEN length(trim(text, ' ')) <= 320 THEN trim(text, ' ') ELSE rtrim(left(trim(text, ' '), 320), ' ') || '…' END AS snippet FROM documents")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("snippet_middle_words", f"""WITH t AS (SELECT doc_id, list_filter(string_split({sql.squeeze('text')}, ' '), lambda w: w <> '') AS p FROM documents)
SELECT doc_id, regexp_replace(array_to_string(p[greatest(0, (len(p) - 8) // 2) + 1 : greatest(0, (len(p) - 8) // 2) + 8], ' '), '[.,;:]+$', '') AS middle FROM t""")
def snippet_middle_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.middle_words(F.col("text")).alias("middle"))


URL_PARTS = r"""u AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS bare FROM pages),
h AS (SELECT page_id, url, regexp_extract(bare, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*)', 1) AS host, regexp_replace(regexp_replace(regexp_extract(bare, '^([^?]*)', 1), '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/]*', ''), '/+$', '') AS path, regexp_extract(bare, '(\?.*)$', 1) AS q FROM u)"""


@query("canonical_url", f"WITH {URL_PARTS} SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || q AS canonical FROM h")
def canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


@query("url_host", r"SELECT regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)', 1) AS host, count(*)::BIGINT AS n FROM pages GROUP BY 1")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(X.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("html_title", r"SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("html_lang", r"""SELECT regexp_extract(html, '<html[^>]*\blang="([a-zA-Z]+)', 1) AS lang, count(*)::BIGINT AS n FROM pages GROUP BY 1""")
def html_lang(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").groupBy(F.regexp_extract("html", r'<html[^>]*\blang="([a-zA-Z]+)', 1).alias("lang")).agg(F.count("*").alias("n"))


@query("html_links", r"""SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: NOT regexp_matches(x, '^(#|mailto:|tel:|javascript:)') AND x <> '')))::BIGINT AS n_links FROM pages""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    kept = F.array_distinct(F.filter(found, lambda x: ~x.rlike("^(#|mailto:|tel:|javascript:)") & (x != "")))
    return table(spark, d, "pages").select("page_id", F.size(kept).cast("long").alias("n_links"))


@query("deep_links", f"""WITH {URL_PARTS}, c AS (SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || q AS url FROM h),
t AS (SELECT page_id, url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ') AS title FROM c JOIN (SELECT page_id, html FROM pages) USING (page_id)),
w AS (SELECT page_id, url, list_filter(string_split({sql.squeeze("regexp_replace(title, '[#>*`\\[\\]()]|^-[ \\t]+', ' ', 'g')")}, ' '), lambda x: x <> '') AS w FROM t),
p AS (SELECT page_id, url, array_to_string(w[1:6], ' ') AS pre, CASE WHEN len(w) > 6 THEN array_to_string(w[len(w)-5:len(w)], ' ') ELSE array_to_string(w[1:6], ' ') END AS suf FROM w)
SELECT page_id, CASE WHEN pre = '' THEN url ELSE url || '#:~:text=' || url_encode(pre) || CASE WHEN suf = pre THEN '' ELSE ',' || url_encode(suf) END END AS link FROM p""")
def deep_links(spark: SparkSession, d: str) -> DataFrame:
    from loomwright.functions.locators import deep_link, locator

    title = F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    anchors = X.fragment_anchors(title)
    rows = table(spark, d, "pages").select("page_id", "url", anchors.alias("a"))
    return rows.select("page_id", deep_link(locator("web", url=F.col("url"), quote_prefix=F.col("a.prefix"), quote_suffix=F.col("a.suffix"))).alias("link"))


@query("list_documents_page", """SELECT doc_id, source || '/' || doc_id AS uri FROM documents WHERE source || '/' || doc_id ILIKE '%SRC1%' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25""")
def list_documents_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a filtered listing (paging is the feature)."""
    uri = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", "n_chars", uri.alias("uri")).where(F.col("uri").ilike("%SRC1%"))
    return rows.orderBy(F.desc("n_chars"), "doc_id").offset(25).limit(25).select("doc_id", "uri")


@query("multi_get_ordered", """WITH ids AS (SELECT list(doc_id ORDER BY quality DESC, toxic DESC, doc_id DESC) AS l FROM labels), p AS (SELECT l[i] AS doc_id, i - 1 AS pos FROM (SELECT l, unnest(range(1, len(l) + 1)) AS i FROM ids))
SELECT pos::BIGINT AS pos, doc_id, sha256(text) AS content_hash FROM p JOIN documents USING (doc_id)""")
def multi_get_ordered(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a list of ids, with each one's place in the list."""
    from loomwright.operators.store import numbered

    ids = numbered(table(spark, d, "labels"), [F.desc("quality"), F.desc("toxic"), F.desc("doc_id")], "pos")
    docs = table(spark, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))
    return ids.select("pos", "doc_id").join(docs, "doc_id").select("pos", "doc_id", "content_hash").orderBy("pos")


@query("collection_stats", """SELECT source AS collection, count(*)::BIGINT AS n_documents, sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END)::BIGINT AS tokens,
count(l.doc_id)::BIGINT AS n_labelled, count(DISTINCT lang)::BIGINT AS n_types FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("collection"), "lang", X.token_estimate(F.col("text")).alias("tokens"))
    rows = docs.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("labelled")), "doc_id", "left")
    return rows.groupBy("collection").agg(F.count("*").alias("n_documents"), F.sum("tokens").alias("tokens"), F.count("labelled").alias("n_labelled"), F.countDistinct("lang").alias("n_types"))


@query("list_collections", "SELECT name FROM (SELECT source AS name FROM documents UNION SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) FROM pages) ORDER BY name")
def list_collections(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "documents").select(F.col("source").alias("name")).union(table(spark, d, "pages").select(X.url_host(F.col("url"))))
    return names.distinct().orderBy("name")


@query("keyword_coverage", f"""WITH a AS (SELECT item_id, {sql.all_terms('text')} AS a, text FROM benchmark), m AS (SELECT item_id, list_distinct(CASE WHEN len(list_filter(a, lambda t: t NOT IN ({sql.STOP}))) > 0 THEN list_filter(a, lambda t: t NOT IN ({sql.STOP})) ELSE a END) AS t FROM a)
SELECT doc_id, item_id, round(len(list_filter(t, lambda x: contains(lower(text), x)))::DOUBLE / len(t), 6) AS coverage FROM (SELECT doc_id, text, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents) JOIN m USING (item_id)""")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of a benchmark item's terms the document has that is dealt to it by id."""
    items = table(spark, d, "benchmark").select("item_id", X.terms(F.col("text")).alias("t"))
    n = items.count()
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % n).alias("item_id"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.round(X.keyword_coverage(F.col("t"), F.col("text")), 6).alias("coverage"))


@query("embedding_text", """SELECT doc_id, sha256(CASE WHEN source <> '' AND NOT contains(left(text, 200), source) THEN source || chr(10) || chr(10) || text ELSE text END) AS hash FROM documents""")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(X.embedding_text(F.col("source"), F.col("text")), 256).alias("hash"))


@query("line_numbers", """SELECT doc_id, (length(left(text, n_chars // 2)) - length(replace(left(text, n_chars // 2), chr(10), '')) + 1)::BIGINT AS line FROM documents""")
def line_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.line_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("line"))


@query("timestamp_labels", """SELECT order_id AS key, CASE WHEN s >= 3600 THEN format('{:d}:{:02d}:{:02d}', s // 3600, (s // 60) % 60, s % 60) ELSE format('{:d}:{:02d}', s // 60, s % 60) END AS label FROM (SELECT event_id AS order_id, floor(value * 10)::BIGINT AS s FROM events)""")
def timestamp_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("key"), X.timestamp_label(F.col("value") * 10).alias("label"))
