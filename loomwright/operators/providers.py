"""Models that others host, as functions that a caller plugs in: embedders, generators and judges.

A plugged function takes a list and gives a list of the same length; it is called in the tasks, once a batch, with
``batch`` items at most. An item that it gives None for falls back to the library's own operator. Exceptions are the
function's to catch; one that leaves it fails the task, which Spark runs again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import looks_like_refusal
from loomwright.operators import answer, verify
from loomwright.operators.vectors import hash_vector


def _called(f: Callable[[list], list], items: list, batch: int) -> Iterator:
    for low in range(0, len(items), batch):
        part = items[low : low + batch]
        out = f(part)
        if len(out) != len(part):
            raise ValueError(f"{len(out)} results for {len(part)} items")
        yield from out


def embed_by(df: DataFrame, embed: Callable[[list[str]], list[list[float] | None]], text_col: str = "text", out: str = "embedding", dim: int | None = None, batch: int = 64) -> DataFrame:
    """``df`` with vectors of a text column; with ``dim``, a text without a vector gets a hashed one of that size."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        found = _called(embed, [t or "" for t in texts], batch)
        return pd.Series([v if v is not None or dim is None else hash_vector(t, dim) for v, t in zip(found, texts, strict=True)], dtype=object)

    return df.withColumn(out, run(F.col(text_col)))


def answers_by(packed: DataFrame, queries: DataFrame, complete: Callable[[list[str]], list[str | None]], batch: int = 8) -> DataFrame:
    """query_id, answer, refused from a generator over prompts of numbered sources; markers of sources that are not
    there are taken out, and a question without sources or reply is declined."""
    asked = answer.prompt(packed, queries).join(packed.groupBy("query_id").agg(F.max("marker").alias("most")), "query_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [answer.strip_invalid(r, int(m)) if r else None for r, m in zip(_called(complete, list(b["prompt"]), batch), b["most"], strict=True)]
            yield pd.DataFrame({"query_id": b["query_id"], "answer": said})

    given = asked.select("query_id", "prompt", "most").mapInPandas(run, "query_id long, answer string")
    rows = queries.select("query_id").join(given, "query_id", "left")
    text = F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(answer.REFUSAL))
    return rows.select("query_id", text.alias("answer"), looks_like_refusal(text).alias("refused"))


def judged_by(pairs: DataFrame, judge: Callable[[list[tuple[str, str]]], list[str | None]], batch: int = 8) -> DataFrame:
    """``pairs`` (query_id, idx, marker, said, text) to query_id, idx, score, quote, reason: the judge's best reply over a
    claim's sources (its confidence if it says supported, else what is left of it), the first of equals; a pair without
    a usable reply is scored by words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["reply"] = list(_called(judge, list(zip(b["said"], b["text"], strict=True)), batch))
            yield b[["query_id", "idx", "marker", "said", "text", "reply"]]

    asked = pairs.select("query_id", "idx", "marker", "said", "text").mapInPandas(run, "query_id long, idx int, marker int, said string, text string, reply string")
    own = verify.supported(asked).withColumn("v", verify.reply_verdict(F.col("reply")))
    score = F.when(F.col("v.supported"), F.col("v.confidence")).when(F.col("v").isNotNull(), 1 - F.col("v.confidence")).otherwise(F.col("score"))
    rows = own.select("query_id", "idx", "marker", score.alias("score"), F.coalesce("v.quote", "quote").alias("quote"), F.col("v.reason").alias("reason"))
    best = F.max_by(F.struct("score", "quote", "reason"), F.struct("score", -F.col("marker")))
    return rows.groupBy("query_id", "idx").agg(best.alias("b")).select("query_id", "idx", "b.*")
