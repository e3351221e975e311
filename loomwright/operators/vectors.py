"""Vectors: hashing embedder, exact cosine search in blocks, normalisation, centroids."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators.best import CELLS, ROWS, Best
from loomwright.session import spread

#: Query matrices up to this many values go to every task; larger query sets are taken in several passes.
BLOCK_VALUES = 4_000_000
#: Queries whose scores are laid out as rows, at most.
MOST_QUERIES = 1_000
# Weights of the three kinds of features.
WORD_WEIGHT, PAIR_WEIGHT, GRAM_WEIGHT = 1.0, 0.7, 0.35
TOKEN = re.compile(r"[a-z0-9_]+")
#: Features whose hashes a worker remembers, in each of two generations.
HELD = 300_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit length in doubles; zero vectors stay."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


class _Places:
    """Features' hashes, remembered for two generations of ``HELD`` features, of which those used again live on."""

    def __init__(self) -> None:
        self.now: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def of(self, features: list[str]) -> list[int]:
        now, older = self.now, self.older
        if len(now) > HELD:
            self.now, self.older = now, older = {}, now
        out = []
        for f in features:
            value = now.get(f)
            if value is None:
                value = older.get(f)
                if value is None:
                    value = int.from_bytes(hashlib.blake2b(f.encode(), digest_size=8).digest(), "little")
                now[f] = value
            out.append(value)
        return out


_PLACES = _Places()


def hash_vector(text: str | None, dim: int) -> np.ndarray:
    """Signed feature hashing of words, word pairs and character 4-grams, with 1 + ln(count), to unit length."""
    low = (text or "").lower()
    tokens = TOKEN.findall(low)
    clean = " ".join(low.split())
    kinds = (
        (WORD_WEIGHT, Counter([f"w:{t}" for t in tokens])),
        (PAIR_WEIGHT, Counter([f"b:{a}_{b}" for a, b in pairwise(tokens)])),
        (GRAM_WEIGHT, Counter([f"c:{clean[i : i + 4]}" for i in range(len(clean) - 3)])),
    )
    value = np.array([v for _, c in kinds for v in _PLACES.of(list(c))], np.uint64)
    weight = np.concatenate([w * (1.0 + np.log(np.fromiter(c.values(), float, len(c)))) for w, c in kinds])
    sign = np.where(value >> np.uint64(63), 1.0, -1.0)
    out = np.bincount((value % np.uint64(dim)).astype(np.int64), weights=sign * weight, minlength=dim).astype(np.float32)
    length = float(np.linalg.norm(out))
    return out / length if length > 1e-12 else out


def hash_embed(df: DataFrame, text_col: str = "text", out: str = "embedding", dim: int = 512) -> DataFrame:
    """``df`` with a hashed vector of a text column; an empty text gives zeros."""
    if dim < 16:
        raise ValueError("at least 16 dimensions")

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hash_vector(t, dim))

    return spread(df).withColumn(out, embed(F.col(text_col)))


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, exclude_self: bool = False, digits: int = 6) -> DataFrame:
    """query_id, id, score, rank: the best k of ``vectors`` (id, embedding) for each of ``queries`` (query_id,
    embedding) by exact cosine. Query vectors are taken in blocks of a bounded size; each task multiplies its
    vectors with a block, some at a time, and keeps its own best k per query, so the ranking sees k rows per task and
    query. Scores are rounded once, by the ranking. Vectors of another dimension fail; zero vectors have similarity 0."""
    rows = queries.select("query_id", "embedding").where("embedding IS NOT NULL").orderBy("query_id").toLocalIterator()
    found, block = None, []

    def search(block: list) -> DataFrame:
        ids = np.array([r[0] for r in block], np.int64)
        matrix = np.array([r[1] for r in block], np.float64)
        lengths = np.linalg.norm(matrix, axis=1)
        matrix = matrix / np.where(lengths > 0, lengths, 1)[:, None]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(ids, k, digits)
            step = max(1, CELLS // len(ids))
            for batch in batches:
                if not batch.num_rows:
                    continue
                if pc.any(pc.not_equal(pc.list_value_length(batch.column(1)), matrix.shape[1])).as_py():
                    raise ValueError("vectors of different dimensions")
                every = batch.column(0).to_numpy(zero_copy_only=False)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for low in range(0, batch.num_rows, step):
                    names, rows = every[low : low + step], values[low : low + step].astype(np.float64)
                    size = np.linalg.norm(rows, axis=1)
                    score = matrix @ (rows / np.where(size > 0, size, 1)[:, None]).T
                    if exclude_self:
                        score[ids[:, None] == names[None, :]] = -np.inf
                    best.add(0, names, score)
            yield best.rows()

        return vectors.select(F.col("id").cast("long"), "embedding").where("embedding IS NOT NULL").mapInArrow(run, ROWS)

    for row in rows:
        block.append(row)
        if len(block) * len(row[1]) >= BLOCK_VALUES:
            found = search(block) if found is None else found.unionByName(search(block))
            block = []
    if block or found is None:
        if not block:
            return vectors.sparkSession.createDataFrame([], "query_id long, id long, score double, rank int")
        found = search(block) if found is None else found.unionByName(search(block))
    from loomwright.operators.search import top_k

    return top_k(found, k, digits=digits)


def few(queries: DataFrame) -> bool:
    """Whether all scores of some queries may be laid out as rows and ranked (counted)."""
    return queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES


def cosine_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """The same scores as expressions, of every pair; for the best of many queries there is ``cosine_top_k``."""
    q = queries.select("query_id", l2_normalize(F.col("embedding")).alias("q"))
    q = F.broadcast(q) if few(queries) else q
    return vectors.select("id", l2_normalize(F.col("embedding")).alias("v")).crossJoin(q).select("query_id", "id", dot(F.col("q"), F.col("v")).alias("score"))


def centroids(vectors: DataFrame, group: str) -> DataFrame:
    """group, n, centroid: the mean of the unit vectors of each group, to unit length again. Places are averaged
    each by itself with partial aggregation, so a hot group is one row per task and place."""
    unit = vectors.select(group, F.posexplode(l2_normalize(F.col("embedding"))).alias("pos", "x"))
    mean = unit.groupBy(group, "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    out = mean.groupBy(group).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("c"))
    return out.select(group, "n", l2_normalize(F.col("c")).alias("centroid"))


def similarity_graph(nodes: DataFrame, id_col: str, vector_col: str, nearest: int = 6, least: float = 0.35) -> DataFrame:
    """a, b, weight: undirected edges of each node to its nearest others with at least a weight; an edge is in the
    graph if either end has it among its nearest."""
    pairs = cosine_top_k(nodes.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding")), nodes.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("embedding")), nearest, exclude_self=True)
    pairs = pairs.where(F.col("score") >= least)
    return pairs.select(F.least("query_id", "id").alias("a"), F.greatest("query_id", "id").alias("b"), F.round("score", 4).alias("weight")).dropDuplicates(["a", "b"])


def mmr(pool: DataFrame, k: int, balance: float = 0.7) -> DataFrame:
    """query_id, id, pick: maximal marginal relevance over each query's pool (query_id, id, score, rank, embedding,
    tokens). Relevance is scaled to 0..1 in the pool; similarity is the cosine held to 0..1, or the tokens' Jaccard
    where a vector is missing; ties go to the better rank. Pools are at most 4 k rows, cut before."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        n = len(pdf)
        score = pdf["score"].to_numpy(float)
        span = score.max() - score.min()
        relevance = (score - score.min()) / span if span > 1e-12 else np.ones(n)
        has = pdf["embedding"].map(lambda v: v is not None and len(v) > 0).to_numpy(bool)
        sim = np.zeros((n, n))
        if has.any():
            at = np.flatnonzero(has)
            m = np.stack([np.asarray(pdf["embedding"][i], float) for i in at])
            m = m / np.maximum(np.linalg.norm(m, axis=1), 1e-12)[:, None]
            sim[np.ix_(at, at)] = np.clip(m @ m.T, 0, 1)
        sets = [set(t if t is not None else []) for t in pdf["tokens"]]
        for i in range(n):
            for j in range(n):
                if not (has[i] and has[j]) and (union := sets[i] | sets[j]):
                    sim[i, j] = len(sets[i] & sets[j]) / len(union)
        picks: list[int] = []
        if k >= n and balance >= 1:
            picks = list(range(n))
        while len(picks) < min(k, n):
            worst = sim[:, picks].max(axis=1) if picks else np.zeros(n)
            value = balance * relevance - (1 - balance) * worst
            value[picks] = -np.inf
            picks.append(int(np.argmax(value)))
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "id": pdf["id"].iloc[picks].to_numpy(), "pick": np.arange(1, len(picks) + 1)})

    best = Window.partitionBy("query_id").orderBy("rank")
    cut = pool.withColumn("place", F.row_number().over(best)).where(F.col("place") <= 4 * k).drop("place")
    return cut.groupBy("query_id").applyInPandas(run, "query_id long, id long, pick int")
