"""Reranking by how query and passage fit together: coverage, proximity, phrases, first place, headings.

Candidates' tokens are laid out as rows and joined to their query's terms in generated code; only places that
match are kept, so what is grouped is small. Proximity walks the matched places once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import terms
from loomwright.operators.search import sized
from loomwright.session import materialise

# Feature weights, and how many words beyond the ideal make proximity vanish.
COVERAGE, PROXIMITY, PHRASE, POSITION, HEADING = 1.0, 0.35, 0.30, 0.15, 0.20
CODE_PENALTY, HORIZON = 0.05, 120


def is_code_query(query: Column) -> Column:
    return query.rlike(r"[(){}\[\];]|::|->|=>|\bdef\b|\bclass\b|\bimport\b|_[a-z]|[a-z][A-Z]")


def _proximity(hits: Column) -> Column:
    """1 less the excess of the narrowest window over the number of matched terms, for (place, term) in order."""
    n = F.size(F.array_distinct(F.transform(hits, lambda h: h["term"])))
    width = F.aggregate(
        hits,
        F.struct(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")).alias("last"), F.lit(1 << 30).alias("best")),
        lambda a, h: _step(a, h, n),
        lambda a: a["best"],
    )
    return F.when(n == 0, 0.0).when(n == 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0), width - n) / HORIZON))


def _step(a: Column, h: Column, n: Column) -> Column:
    last = F.map_concat(F.map_filter(a["last"], lambda k, _: k != h["term"]), F.create_map(h["term"], h["place"]))
    width = h["place"] - F.array_min(F.map_values(last)) + 1
    return F.struct(last.alias("last"), F.when(F.size(last) == n, F.least(a["best"], width)).otherwise(a["best"]).alias("best"))


def _matches(rows: DataFrame) -> DataFrame:
    """query_id, id, pos, term, fits, equal: places whose token begins with a term of the query; it fits if it is equal,
    or if the term has five letters or more."""
    tokens = rows.select("query_id", "id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+('[a-z]+)?"), F.lit(0))).alias("pos", "token"))
    # tokens and terms meet by query and first letter, so that a query's terms are not tried on every token
    asked = rows.select("query_id", "terms").dropDuplicates(["query_id"]).select("query_id", F.explode("terms").alias("term"))
    asked = asked.withColumn("first", F.left("term", F.lit(1)))
    both = tokens.withColumn("first", F.left("token", F.lit(1))).join(sized(asked), ["query_id", "first"]).where(F.startswith("token", "term"))
    equal = F.col("token") == F.col("term")
    return both.select("query_id", "id", "pos", "term", (equal | (F.length("term") >= 5)).alias("fits"), equal.alias("equal"))


def features(pool: DataFrame) -> DataFrame:
    """``pool`` (query_id, query, id, text, heading_context, document_title, kind, score) with its features. A token
    matches a term if it is equal, or begins with it where the term has five letters or more."""
    rows = pool.withColumn("terms", terms(F.col("query")))
    hits = materialise(_matches(rows), "matches")  # read for the frequencies and for the places
    # per query: candidates, and those that have a term (or a longer word that begins with it)
    n = rows.groupBy("query_id").agg(F.count("*").alias("n"), F.first("terms").alias("terms"))
    df = hits.groupBy("query_id", "term").agg(F.countDistinct("id").alias("df"))
    every = n.select("query_id", "n", F.explode("terms").alias("term")).join(df, ["query_id", "term"], "left")
    value = F.log(1 + (F.col("n") - F.coalesce("df", F.lit(0)) + 0.5) / (F.coalesce("df", F.lit(0)) + 0.5))
    idf = every.select("query_id", "term", value.alias("idf"))
    total = idf.groupBy("query_id").agg(F.sum("idf").alias("total"))
    per = hits.where("fits").groupBy("query_id", "id", "term").agg(F.collect_list("pos").alias("at")).join(idf, ["query_id", "term"])
    places = F.array_sort(F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("place"), F.col("term").alias("term"))))))
    per = per.groupBy("query_id", "id").agg(F.sum("idf").alias("held"), places.alias("hits"))
    # neighbouring places that equal a term are a run: place less rank stays the same
    rank = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("pos"))
    runs = hits.where("equal").select("query_id", "id", "pos").distinct().withColumn("run", F.col("pos") - rank)
    runs = runs.groupBy("query_id", "id", "run").agg(F.count("*").alias("size")).groupBy("query_id", "id").agg(F.max("size").alias("run"))
    rows = rows.join(per, ["query_id", "id"], "left").join(runs, ["query_id", "id"], "left").join(total, "query_id", "left")
    n_terms, run = F.size("terms"), F.coalesce("run", F.lit(0))
    found = F.coalesce("hits", F.array().cast("array<struct<place:int,term:string>>"))
    n_tokens = F.regexp_count(F.lower("text"), F.lit("[a-z0-9_]+('[a-z]+)?"))
    haystack = F.lower(F.concat_ws(" ", "heading_context", "document_title"))
    return rows.withColumns(
        {
            "coverage": F.coalesce(F.col("held") / F.nullif("total", F.lit(0.0)), F.lit(0.0)),
            "proximity": _proximity(found),
            "phrase": F.when((n_terms < 2) | (run < 2), 0.0).otherwise(F.least(F.lit(1.0), run / n_terms)),
            "position": F.when(F.size(found) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.get(found, F.lit(0))["place"] / n_tokens)),
            "heading": F.when(n_terms == 0, 0.0).otherwise(F.size(F.filter("terms", lambda t: F.contains(haystack, t))) / n_terms),
        }
    ).drop("hits", "held", "total", "run")


def rerank(pool: DataFrame, top_n: int = 30, code_penalty: float = CODE_PENALTY) -> DataFrame:
    """``pool`` with rerank_score and its new rank; ties go to the higher old score, then to the smaller id. Queries
    without terms keep their scores; a missing rerank score is the old one."""
    rows = features(pool)
    score = COVERAGE * F.col("coverage") + PROXIMITY * F.col("proximity") + PHRASE * F.col("phrase") + POSITION * F.col("position") + HEADING * F.col("heading")
    score = score - F.when((F.col("kind") == "code") & ~is_code_query(F.col("query")), code_penalty).otherwise(0.0)
    rows = rows.withColumn("rerank_score", F.round(F.coalesce(F.when(F.size("terms") > 0, score), F.col("score")), 6)).drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def rerank_by(pool: DataFrame, scorer: Callable[[DataFrame], DataFrame], top_n: int = 30) -> DataFrame:
    """``pool`` (query_id, id, score, ...) by the scores (query_id, id, rerank_score) of any scorer. A query for which the
    scorer does not give every candidate exactly one score keeps its order, and ``reranked`` is false."""
    given = scorer(pool).groupBy("query_id", "id").agg(F.first("rerank_score").alias("rerank_score"), F.count("rerank_score").alias("n"))
    rows = pool.drop("rank").join(given, ["query_id", "id"], "left")
    whole = F.min(F.coalesce(F.col("n"), F.lit(0)) == 1).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("reranked", whole).withColumn("rerank_score", F.when(F.col("reranked"), F.col("rerank_score").cast("double")).otherwise(F.col("score"))).drop("n")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def reply_order(reply: Column, n: Column) -> Column:
    """The order (from 0) that a ranking reply names by numbers from 1: others and repeated ones count for nothing,
    and what it does not mention follows in its old order."""
    said = F.transform(F.regexp_extract_all(F.coalesce(reply, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int") - 1)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    named = F.array_intersect(said, every)
    return F.concat(named, F.array_except(every, named))
