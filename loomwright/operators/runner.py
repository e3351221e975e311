"""Evaluation runs: a golden set against a corpus under several settings, with times, summaries and a gate."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.corpus import Corpus
from loomwright.operators import evaluate
from loomwright.session import materialise

# What is compared, by the name of the comparison.
PRESETS: dict[str, dict[str, dict]] = {
    "strategies": {name: {"strategy": name, "rerank": False} for name in ("lexical", "dense", "hybrid")},
    "fusion": {name: {"fusion": name, "rerank": False} for name in ("rrf", "weighted", "max")},
    "rerank": {"fusion only": {"rerank": False}, "reranked": {"rerank": True}},
    "mmr": {"no mmr": {"mmr": None}, "mmr 0.7": {"mmr": 0.7}, "mmr 0.5": {"mmr": 0.5}},
    "full": {name: {"strategy": name, "rerank": False} for name in ("lexical", "dense", "hybrid")} | {"hybrid+rerank": {"strategy": "hybrid", "rerank": True}},
}
#: A result is at least this long, whatever the cutoffs.
DEEP = 10
GRADE = 2


@dataclass(frozen=True)
class Evaluation:
    """per_query (label, query_id, metrics), summary (label, metric, n, mean, ...), unresolved (query_id, kind, value), and
    by label the milliseconds a query and the number of excluded queries."""

    per_query: DataFrame
    summary: DataFrame
    unresolved: DataFrame
    milliseconds: dict[str, float]
    excluded: dict[str, int]

    def worst(self, metric: str, n: int = 10) -> DataFrame:
        """The n rows with the least of a metric."""
        return self.per_query.where(F.col(metric).isNotNull()).select("label", "query_id", metric).orderBy(metric, "label", "query_id").limit(n)

    def fails_under(self, metric: str, least: float) -> bool:
        """Whether the best run's mean is below a bound."""
        best = self.summary.where(F.col("metric") == metric).agg(F.max("mean")).first()[0]
        return best is None or best < least


def expectations(golden: DataFrame) -> DataFrame:
    """query_id, kind, value, grade of each expectation; the grade is the value's own, else that of a direct answer."""
    kinds = {"chunk_ids": "chunk", "document_ids": "document", "document_titles": "title", "must_contain": "text"}

    def told(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))

    each = [F.transform(c, told(k)) for c, k in kinds.items() if c in golden.columns]
    rows = golden.select(F.col("id").alias("query_id"), "grades", F.explode(F.concat(*each)).alias("e"))
    return rows.select("query_id", "e.kind", "e.value", F.coalesce(F.try_element_at("grades", F.col("e.value")), F.lit(GRADE)).alias("grade"))


def run(corpus: Corpus, golden: DataFrame, configs: dict[str, dict], cutoffs: tuple[int, ...] = evaluate.CUTOFFS) -> Evaluation:
    """Every configuration over the whole golden set at once. Questions are numbered; those without a chunk that meets an
    expectation are excluded and never count as zero."""
    asked = golden.select("id", "query", F.dense_rank().over(_by_id()).cast("long").alias("query_id"))
    asked = materialise(asked, "asked")
    wanted = materialise(expectations(golden).withColumnRenamed("query_id", "id").join(asked.select("id", "query_id"), "id").drop("id"), "wanted")
    chunks = corpus.chunks.select("id", F.col("document_title").alias("title"), "text", F.col("document_id").cast("string").alias("document"))
    met = materialise(evaluate.resolve_each(wanted, chunks, "id"), "met")
    qrels = materialise(met.groupBy("query_id", "id").agg(F.max("grade").alias("grade")), "qrels")
    unresolved = wanted.join(met.select("query_id", "kind", "value").distinct(), ["query_id", "kind", "value"], "left_anti")
    per_query, milliseconds, excluded = None, {}, {}
    n = asked.count()
    for label, changes in configs.items():
        own = corpus.with_settings(replace(corpus.settings, **changes, top_k=max(DEEP, *cutoffs)))
        own.retrieve(asked.limit(1)).count()  # the index is there before the clock runs
        began = time.perf_counter()
        hits = materialise(own.retrieve(asked.select("query_id", "query")), "hits")
        milliseconds[label] = 1000 * (time.perf_counter() - began) / max(1, n)
        rows = materialise(evaluate.metrics(hits, qrels, cutoffs).join(asked.select("query_id"), "query_id", "right"), "metrics")
        excluded[label] = n - rows.where("NOT excluded").count()
        rows = rows.select(F.lit(label).alias("label"), "*")
        per_query = rows if per_query is None else per_query.unionByName(rows)
    values = None
    for label in configs:
        part = evaluate.long_form(per_query.where(F.col("label") == label).drop("label"), label)
        values = part if values is None else values.unionByName(part)
    return Evaluation(per_query, materialise(evaluate.summary(values), "summary"), unresolved, milliseconds, excluded)


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("id")  # a golden set is small
