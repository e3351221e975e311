"""Retrieval events: log, heat, recent queries, coverage; events as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.search import sized


def log_events(ranked: DataFrame, queries: DataFrame, strategy: str, at) -> DataFrame:
    """Rows for the event log of a ranked list: ids by content, so that a retry writes the same rows. An explicit
    step, never a side effect of a search."""
    rows = ranked.join(queries.select("query_id", "query"), "query_id")
    mark = F.left(F.sha2("query", 256), F.lit(16))
    key = F.sha2(F.concat_ws("\u0000", "query", F.col("id").cast("string"), F.col("rank").cast("string"), F.lit(strategy), F.lit(at).cast("string")), 256)
    return rows.select(key.alias("event_id"), "query", mark.alias("query_hash"), F.col("id").alias("chunk_id"), "rank", "score", F.lit(strategy).alias("strategy"), F.lit(at).cast("timestamp").alias("created_at"))


def heatmap(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, hits, avg_rank, avg_score, last_at of chunks that still exist."""
    heat = events.groupBy("chunk_id").agg(F.count("*").alias("hits"), F.round(F.avg("rank"), 6).alias("avg_rank"), F.round(F.avg("score"), 6).alias("avg_score"), F.max("created_at").alias("last_at"))
    return heat.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def recent_queries(events: DataFrame) -> DataFrame:
    """query_hash, the query as last asked, last_at and n."""
    return events.groupBy("query_hash").agg(F.max_by("query", F.struct("created_at", "query")).alias("query"), F.max("created_at").alias("last_at"), F.count("*").alias("n"))


def coverage(events: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, retrieved, share, queries."""
    seen = chunks.select("chunk_id").join(events.select("chunk_id").distinct(), "chunk_id", "left_semi").agg(F.count("*").alias("retrieved"))
    total = chunks.agg(F.count("*").alias("chunks"))
    asked = events.agg(F.countDistinct("query_hash").alias("queries"))
    share = F.round(F.coalesce(F.col("retrieved") / F.nullif(F.col("chunks"), F.lit(0)), F.lit(0.0)), 6)
    return total.crossJoin(seen).crossJoin(asked).select("chunks", "retrieved", share.alias("share"), "queries")  # one row each


def never_retrieved(events: DataFrame, chunks: DataFrame) -> DataFrame:
    return chunks.join(events.select("chunk_id").distinct(), "chunk_id", "left_anti")


def counted(points: DataFrame, events: DataFrame) -> DataFrame:
    """Points (chunk_id, ...) with how often each was retrieved."""
    n = events.groupBy("chunk_id").agg(F.count("*").alias("retrievals"))
    return points.join(sized(n), "chunk_id", "left").withColumn("retrievals", F.coalesce("retrievals", F.lit(0)))
