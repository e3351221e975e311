"""Retrieval metrics over ranked lists and graded judgements, summaries, sweeps, judgements from expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import match_form
from loomwright.session import materialise

CUTOFFS = (1, 3, 5, 10)


def judged(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """``ranked`` (query_id, id, rank) with the grade of each hit (0 if not judged)."""
    return ranked.join(qrels.select("query_id", "id", "grade"), ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def metrics(ranked: DataFrame, qrels: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per query: recall, precision, hit rate and ndcg at each cutoff, mrr, map and the first relevant
    rank. Queries without a grade of 1 or more are excluded (``excluded``, with null metrics), never zero. Recall
    is of at most k; the average precision divides by the relevant ones or the list's length, whichever is less."""
    hits = judged(ranked, qrels)
    by = Window.partitionBy("query_id").orderBy("rank")
    rel = (F.col("grade") >= 1).cast("int")
    hits = hits.withColumn("hit", rel).withColumn("found", F.sum("hit").over(by))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    aggs = [F.count("*").alias("listed"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first_relevant_rank"), F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank"))).alias("ap")]
    for k in cutoffs:
        inside = F.col("rank") <= k
        aggs += [F.sum(F.when(inside, F.col("hit")).otherwise(0)).alias(f"h{k}"), F.sum(F.when(inside, gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg{k}")]
    per = hits.groupBy("query_id").agg(*aggs)
    best = Window.partitionBy("query_id").orderBy(F.desc("grade"), "id")
    ideal = qrels.where("grade > 0").withColumn("r", F.row_number().over(best))
    ideal = ideal.groupBy("query_id").agg(F.sum((F.col("grade") >= 1).cast("int")).alias("relevant"), *[F.sum(F.when(F.col("r") <= k, gain(F.col("grade"), F.col("r"))).otherwise(0.0)).alias(f"ideal{k}") for k in cutoffs])
    rows = per.join(ideal, "query_id", "full")
    ok = F.coalesce("relevant", F.lit(0)) > 0
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = ["query_id", (~ok).alias("excluded"), "first_relevant_rank"]
    for k in cutoffs:
        out += [
            F.when(ok, zero(f"h{k}") / F.least(F.col("relevant"), F.lit(k))).alias(f"recall_{k}"),
            F.when(ok, zero(f"h{k}") / k).alias(f"precision_{k}"),
            F.when(ok, (zero(f"h{k}") > 0).cast("double")).alias(f"hit_rate_{k}"),
            F.when(ok, zero(f"dcg{k}") / F.col(f"ideal{k}")).alias(f"ndcg_{k}"),
        ]
    out += [F.when(ok, F.coalesce(1 / F.col("first_relevant_rank"), F.lit(0.0))).alias("mrr"), F.when(ok, F.coalesce(F.col("ap") / F.nullif(F.least("relevant", "listed"), F.lit(0)), F.lit(0.0))).alias("map")]
    return rows.select(*out)


def long_form(per_query: DataFrame, label: str) -> DataFrame:
    """label, query_id, metric, value of every metric that is there."""
    names = [c for c in per_query.columns if c not in ("query_id", "excluded", "first_relevant_rank")]
    return per_query.unpivot(["query_id"], names, "metric", "value").where("value IS NOT NULL").select(F.lit(label).alias("label"), "query_id", "metric", "value")


def summary(values: DataFrame) -> DataFrame:
    """label, metric, n, mean, median, stdev (of the sample; 0 for one), min, max."""
    v = F.col("value")
    return values.groupBy("label", "metric").agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("stdev"), F.round(F.min(v), 4).alias("min"), F.round(F.max(v), 4).alias("max"),
    )


def deltas(summaries: DataFrame, baseline: str) -> DataFrame:
    """label, metric, mean and its difference from the baseline's."""
    base = summaries.where(F.col("label") == baseline).select("metric", F.col("mean").alias("base"))
    return summaries.join(base, "metric").select("label", "metric", "mean", F.round(F.col("mean") - F.col("base"), 4).alias("delta"))


def rank_histogram(per_query: DataFrame, most: int = 10) -> DataFrame:
    """rank (most + 1: not found), n."""
    return per_query.where("NOT excluded").groupBy(F.least(F.coalesce("first_relevant_rank", F.lit(most + 1)), F.lit(most + 1)).cast("int").alias("rank")).agg(F.count("*").alias("n"))


def nearest_rank(values: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """by, p: the value at place round(share * (n - 1)), half to even, of the sorted ones; found by counting."""
    n = values.groupBy(by).agg(F.count("*").alias("n"))
    counted = values.groupBy(by, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("c").over(order)).join(n, by)
    place = F.bround(share * (F.col("n") - 1), 0)
    return upto.where(F.col("upto") > place).groupBy(by).agg(F.min(value).alias("p"))


def resolve(golden: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """query_id, id, grade of the chunks that meet an expectation; the highest grade counts."""
    return resolve_each(golden, chunks, id_col).groupBy("query_id", "id").agg(F.max("grade").alias("grade"))


def resolve_each(golden: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """query_id, kind, value, grade, id of each expectation (query_id, kind, value, grade) and chunk that meets it: chunk
    and document ids, titles without regard to case, and texts that a chunk must contain. Contained texts are looked up
    by a word inside them as an equi-join, then checked; those without one (one or two words, other scripts) are checked
    against all chunks. Empty texts are contained in none."""
    own = ["query_id", "kind", "value", "grade"]
    rows = chunks.select(F.col(id_col).alias("id"), "title", match_form(F.col("text")).alias("body"), *[c for c in ("document",) if c in chunks.columns])
    keyed = [("chunk", F.col("value"), F.col("id").cast("string")), ("title", F.lower(F.trim("value")), F.lower(F.trim("title")))]
    if "document" in rows.columns:
        keyed.append(("document", F.col("value"), F.col("document")))
    met = None
    for kind, wanted, there in keyed:
        part = golden.where(F.col("kind") == kind).select(*own, wanted.alias("key")).join(rows.select("id", there.alias("key")), "key").select(*own, "id")
        met = part if met is None else met.unionByName(part)
    asked = golden.where("kind = 'text'").select(*own, match_form(F.col("value")).alias("needle")).where("needle <> ''")
    # only a token with something on both of its sides is a whole token wherever the text is found; the longest is the rarest
    inner = F.regexp_extract_all("needle", F.lit("(?<=[^a-z0-9])[a-z0-9]+(?=[^a-z0-9])"), F.lit(0))
    asked = materialise(asked.withColumn("w", F.array_max(F.transform(inner, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]), "asked")
    words = rows.select("id", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("[a-z0-9]+"), F.lit(0)))).alias("w"))
    from loomwright.operators.search import sized

    likely = words.join(sized(asked.where("w IS NOT NULL")), "w").select(*own, "needle", "id")
    held = likely.join(rows.select("id", "body"), "id").where(F.contains("body", "needle")).select(*own, "id")
    other = asked.where("w IS NULL")
    found = rows.join(sized(other.select("needle").distinct()), F.contains("body", "needle")).select("id", "needle")
    return met.unionByName(held).unionByName(found.join(sized(other.drop("w")), "needle").select(*own, "id"))
