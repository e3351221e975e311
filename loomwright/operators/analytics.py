"""Corpus analytics: clusters, projection, labels, document graph, map."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import LABEL_STOPWORDS, STOPWORDS
from loomwright.operators.vectors import dot, l2_normalize

SEED = 42


def suggest_k(n: int) -> int:
    """About the root of half the points, 2 to 12; 1 below six points."""
    return 1 if n < 6 else max(2, min(12, round(math.sqrt(n / 2))))


def kmeans(vectors: DataFrame, k: int, seed: int = SEED, iterations: int = 100) -> DataFrame:
    """``vectors`` (id, embedding) with a cluster, by MLlib's distributed k-means on unit vectors; one cluster where
    there are no more points than clusters."""
    if vectors.limit(k + 1).count() <= k:
        return vectors.withColumn("cluster", F.lit(0))
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = vectors.withColumn("features", array_to_vector(l2_normalize(F.col("embedding"))))
    model = KMeans(k=k, seed=seed, maxIter=iterations, tol=1e-5).fit(data)
    return model.transform(data).withColumnRenamed("prediction", "cluster").drop("features")


def pca_2d(vectors: DataFrame) -> tuple[DataFrame, float]:
    """(id, x, y) by the two main axes of the centred vectors, and the share of variance that they explain. The
    covariance, dim x dim, is summed in the tasks; each axis's largest loading is positive. Fewer than three points
    lie on a line."""
    unit = vectors.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    n, dim = unit.agg(F.count("*"), F.max(F.size("v"))).first()
    if n < 3:
        rank = F.row_number().over(Window.orderBy("id"))  # at most two rows
        return unit.select("id", rank.cast("double").alias("x"), F.lit(0.0).alias("y")), 1.0

    def moments(batches):
        import pyarrow as pa

        total, square, count = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            m = np.array(b.column(0).to_pylist(), float).reshape(-1, dim)
            total, square, count = total + m.sum(axis=0), square + m.T @ m, count + len(m)
        yield pa.RecordBatch.from_arrays([pa.array([count]), pa.array([total.tolist()]), pa.array([square.ravel().tolist()])], names=["n", "s", "q"])

    parts = unit.select("v").mapInArrow(moments, "n long, s array<double>, q array<double>")
    sums = parts.select(F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col("s").alias("a")), F.struct(F.lit("q").alias("k"), F.col("q").alias("a")))).alias("x")).select("x.k", F.posexplode("x.a").alias("i", "v"))
    rows = sums.groupBy("k", "i").agg(F.sum("v").alias("v")).collect()  # dim * (dim + 1) numbers
    s, q = np.zeros(dim), np.zeros(dim * dim)
    for r in rows:
        (s if r["k"] == "s" else q)[r["i"]] = r["v"]
    mean = s / n
    values, axes = np.linalg.eigh(q.reshape(dim, dim) / n - np.outer(mean, mean))
    axes, values = axes[:, ::-1][:, :2].T, values[::-1]
    axes = axes * np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    place = lambda a: dot(F.col("v"), F.array(*[F.lit(float(x)) for x in a])) - float(mean @ a)
    share = float(values[:2].sum() / values.sum()) if values.sum() > 0 else 1.0
    return unit.select("id", place(axes[0]).alias("x"), place(axes[1]).alias("y")), share


def project(vectors: DataFrame, method: str = "auto", methods: dict | None = None) -> tuple[DataFrame, str]:
    """((id, x, y), note) by the first of the plugged ``methods`` (name to a function of vectors) that works, else by the
    two main axes; the note says which one it was, and why others were not."""
    notes = []
    for name in [method] if method not in ("auto", "pca") else list(methods or {}) if method == "auto" else []:
        try:
            return (methods or {})[name](vectors), "; ".join([*notes, name])
        except Exception as problem:
            notes.append(f"{name}: {'not there' if isinstance(problem, KeyError) else problem}")
    points, share = pca_2d(vectors)
    return points, "; ".join([*notes, f"pca, {share:.0%} of the variance"])


def unit_square(points: DataFrame) -> DataFrame:
    """x and y moved and scaled into 0..1 by the larger span; one point is in the middle."""
    box = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    span = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    scale = lambda c, low: F.when(span > 1e-12, (F.col(c) - F.col(low)) / span).otherwise(0.5)
    return points.crossJoin(F.broadcast(box)).withColumns({"x": scale("x", "x0"), "y": scale("y", "y0")}).drop("x0", "x1", "y0", "y1")  # one row


def distinctive_terms(texts: DataFrame, cluster: str, text: str = "text", best: int = 4, alpha: float = 0.01) -> DataFrame:
    """cluster, term, score, rank: terms whose odds in a cluster exceed those outside, with a small prior; in clusters
    of four texts or more only terms of at least two texts."""
    stop = set(STOPWORDS) | set(LABEL_STOPWORDS)
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    rows = texts.select(F.col(cluster).alias("cluster"), F.filter(found, lambda t: ~t.isin(*stop)).alias("w"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("texts"))
    counted = rows.select("cluster", F.explode("w").alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("y"))
    df = rows.select("cluster", F.explode(F.array_distinct("w")).alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("df"))
    everywhere = counted.groupBy("term").agg(F.sum("y").alias("n"))
    totals = counted.groupBy("cluster").agg(F.sum("y").alias("all_y"))
    world = everywhere.agg(F.sum("n").alias("all_n"), F.count("*").alias("n_terms"))
    rows = counted.join(df, ["cluster", "term"]).join(everywhere, "term").join(totals, "cluster").join(sizes, "cluster").crossJoin(F.broadcast(world))  # one row
    a = alpha * F.col("n_terms")
    odds = lambda y, t: F.log((y + alpha) / F.greatest(t + a - y - alpha, F.lit(1e-9)))
    score = odds(F.col("y"), F.col("all_y")) - odds(F.col("n") - F.col("y"), F.col("all_n") - F.col("all_y")) + 0.05 * F.log(1.0 + F.col("df"))
    rows = rows.where((F.col("texts") < 4) | (F.col("df") >= 2)).select("cluster", "term", F.round(score, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("score"), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= best)


def coherence(vectors: DataFrame, group: str, centres: DataFrame) -> DataFrame:
    """group, n, coherence: mean cosine of members to their centroid."""
    rows = vectors.join(centres.select(group, "centroid"), group)
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(dot(l2_normalize(F.col("embedding")), F.col("centroid"))), 6).alias("coherence"))


def corpus_map(vectors: DataFrame, events: DataFrame, clusters: int | None = None, most: int = 2000) -> DataFrame:
    """id, x, y, cluster, retrievals of an even sample of the vectors."""
    from loomwright.operators.store import even_sample
    from loomwright.operators.telemetry import counted

    sample = even_sample(vectors.select("id", "embedding"), [F.asc("id")], most)
    k = clusters or suggest_k(sample.count())
    places = unit_square(pca_2d(sample)[0])
    rows = kmeans(sample, k).select("id", "cluster").join(places, "id")
    return counted(rows.withColumnRenamed("id", "chunk_id"), events).withColumnRenamed("chunk_id", "id")
