"""Pieces of DuckDB SQL that several oracles share."""

from loomwright.functions.text import STOPWORDS

WS = r"[ \t\n\r\f\x0B]"
STOP = ",".join(f"'{w}'" for w in STOPWORDS)


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'), ' ')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+(?:''[a-z]+)?')"


def sentences(x: str) -> str:
    clean = f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
    return rf"list_filter(string_split(regexp_replace({clean}, '([.!?]){WS}+([\"''(\[]?[A-Z0-9])', '\1' || chr(31) || '\2', 'g'), chr(31)), lambda s: length(trim(s, ' ')) > 0)"


def all_terms(x: str) -> str:
    found = rf"regexp_extract_all({x}, '[A-Za-z0-9_]+(?:[.\-''][A-Za-z0-9_]+)*')"
    return f"list_filter(list_transform({found}, lambda t: lower(trim(t, '''-.'))), lambda t: length(t) >= 2)"


def bm25(k: int = 10, where: str = "", by: str = "d", docs: str = "documents", rounded: str = "score") -> str:
    """WITH clauses up to ``top``: the best k documents of every benchmark item by unstemmed terms."""
    return f"""
WITH qa AS (SELECT item_id AS query_id, {all_terms("text")} AS a FROM benchmark),
qb AS (SELECT query_id, CASE WHEN len(list_filter(a, lambda t: t NOT IN ({STOP}))) > 0 THEN list_filter(a, lambda t: t NOT IN ({STOP})) ELSE a END AS a FROM qa),
qc AS (SELECT DISTINCT query_id, unnest(a) AS t FROM qb),
q AS (SELECT DISTINCT query_id, regexp_extract(t, '[a-z0-9]+') AS term FROM qc WHERE len(regexp_extract_all(t, '[a-z0-9]+')) = 1),
toks AS (SELECT doc_id, source, lang, regexp_extract_all(lower(coalesce(text,'')), '[a-z0-9]+') AS w FROM {docs}),
stats AS (SELECT count(*) AS n, sum(len(w))::DOUBLE / count(*) AS avg_len FROM toks),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS f FROM (SELECT doc_id, unnest(w) AS term FROM toks) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
idf AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idg AS (SELECT term, CASE WHEN ln((n - df + 0.5)/(df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5)/(df + 0.5)) END AS idf FROM idf, stats),
scored AS (SELECT query_id, doc_id, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / avg_len))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idg USING (term) JOIN toks USING (doc_id), stats {where} GROUP BY query_id, doc_id),
top AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k})
"""


def cosine(k: int = 50) -> str:
    """A clause ``den``: the best k vectors for each benchmark item, whose own vector is vec_id = item_id."""
    return f"""
vq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS e FROM benchmark JOIN embeddings ON vec_id = item_id),
vs AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(e, embedding::DOUBLE[]) / sqrt(list_inner_product(e, e) * list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS score FROM vq, embeddings),
den AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM vs) WHERE rank <= {k})
"""
