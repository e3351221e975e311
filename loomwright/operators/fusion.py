"""Fusion of two ranked lists (query_id, id, rank, score) per query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("rrf", "weighted", "max")


def _scaled(df: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each query; 1 where all are equal."""
    by = Window.partitionBy("query_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    return df.withColumn("scaled", F.when(high - low < 1e-12, 1.0).otherwise((F.col("score") - low) / (high - low)))


def fuse(lexical: DataFrame, dense: DataFrame, method: str = "rrf", weights: tuple[float, float] = (0.65, 0.35), k: int = 60) -> DataFrame:
    """query_id, id, score, rank, and each list's rank and score. rrf: sum of weight / (k + rank); weighted: weighted
    sum of scaled scores, absent ones 0; max: the larger scaled score. Ties go to the smaller id."""
    if method not in METHODS:
        raise ValueError(f"no fusion method {method!r}")
    if len(weights) != 2:
        raise ValueError("a weight for each list")
    tag = lambda df, name: _scaled(df).select("query_id", "id", F.lit(name).alias("src"), "rank", "score", "scaled")
    both = tag(lexical, "lexical").unionByName(tag(dense, "dense"))
    of = lambda name, c: F.max(F.when(F.col("src") == name, F.col(c)))
    rows = both.groupBy("query_id", "id").agg(
        of("lexical", "rank").alias("lexical_rank"), of("lexical", "score").alias("lexical_score"), of("lexical", "scaled").alias("ls"),
        of("dense", "rank").alias("dense_rank"), of("dense", "score").alias("dense_score"), of("dense", "scaled").alias("ds"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = {
        "rrf": zero(weights[0] / (k + F.col("lexical_rank"))) + zero(weights[1] / (k + F.col("dense_rank"))),
        "weighted": weights[0] * zero(F.col("ls")) + weights[1] * zero(F.col("ds")),
        "max": F.greatest(zero(F.col("ls")), zero(F.col("ds"))),
    }[method]
    rows = rows.withColumn("score", F.round(score, 6)).drop("ls", "ds")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))


def explain(df: DataFrame) -> DataFrame:
    """Adds a line that says where a fused score comes from."""
    part = lambda name: F.when(F.col(f"{name}_rank").isNotNull(), F.format_string(f"{name} #%d (%.6f)", F.col(f"{name}_rank"), F.col(f"{name}_score")))
    return df.withColumn("explanation", F.concat_ws(", ", F.format_string("score %.6f", "score"), part("lexical"), part("dense")))
