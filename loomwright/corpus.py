"""A corpus of chunks with its search, answers and statistics: the library's operators behind one object.

Every method gives a lazy DataFrame and is batched over many queries; nothing is logged. A corpus does not change:
its text index and its hashed vectors are written when they are first needed and serve all later searches, and what
adds or takes away chunks gives a corpus of the next version, which has none of them yet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import islice

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from loomwright.functions.text import content_hash, token_estimate
from loomwright.operators import answer, fusion, rerank, search, store, telemetry, vectors, verify
from loomwright.operators.index import TextIndex, build_index
from loomwright.session import materialise


@dataclass(frozen=True)
class Settings:
    """Sizes and weights of a search."""

    top_k: int = 8
    candidate_k: int = 50
    rerank_top_n: int = 30
    strategy: str = "hybrid"
    fusion: str = "rrf"
    rrf_k: int = 60
    lexical_weight: float = 0.65
    dense_weight: float = 0.35
    rerank: bool = True
    mmr: float | None = None
    min_score: float | None = None
    prefix_expansion: bool = True
    stemmed: bool = True
    dim: int = 512
    token_budget: int = 6000

    def __post_init__(self):
        if self.strategy not in ("lexical", "dense", "hybrid") or self.fusion not in fusion.METHODS:
            raise ValueError("unknown strategy or fusion")
        if min(self.top_k, self.candidate_k, self.rerank_top_n) < 1 or self.dim < 16:
            raise ValueError("sizes must be positive, and vectors of 16 dimensions at least")


    def merged(self, **overrides) -> Settings:
        """These settings with others where they are given; None changes nothing."""
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})


class Corpus:
    """chunks: id, document_id, collection, ordinal, text, kind, heading_context, document_title, source_type."""

    def __init__(self, chunks: DataFrame, settings: Settings | None = None, embeddings: DataFrame | None = None, events: DataFrame | None = None, reranker: Callable[[DataFrame], DataFrame] | None = None, version: int = 0):
        self.chunks, self.settings, self._embeddings, self.events = chunks, settings or Settings(), embeddings, events
        self.reranker, self.version = reranker, version
        self._index: dict[bool, TextIndex] = {}
        self._hashed: dict[int, DataFrame] = {}

    def index(self) -> TextIndex:
        """The stored text index of all chunks."""
        if self.settings.stemmed not in self._index:
            self._index[self.settings.stemmed] = build_index(self.chunks, "id", search.WEIGHTS, self.settings.stemmed)
        return self._index[self.settings.stemmed]

    def embeddings(self) -> DataFrame:
        """id, embedding of all chunks: the given ones, else hashed and stored."""
        if self._embeddings is not None:
            return self._embeddings
        if self.settings.dim not in self._hashed:
            hashed, _ = embed_distinct(self.chunks, self.settings.dim)
            self._hashed[self.settings.dim] = materialise(hashed, "vectors")
        return self._hashed[self.settings.dim]

    def with_settings(self, settings: Settings) -> Corpus:
        """The same corpus, with what it has stored, under other settings."""
        out = Corpus(self.chunks, settings, self._embeddings, self.events, self.reranker, self.version)
        out._index, out._hashed = self._index, self._hashed
        return out

    def scoped(self, collection: str) -> Corpus:
        """The chunks and events of one collection: all reads, statistics included, see nothing else."""
        inside = F.col("collection") == collection
        events = self.events.where(inside) if self.events is not None and "collection" in self.events.columns else self.events
        kept = None if self._embeddings is None else self._embeddings.join(self.chunks.where(inside).select("id"), "id", "left_semi")
        return Corpus(self.chunks.where(inside), self.settings, kept, events, self.reranker, self.version)

    def retrieve(self, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, id, score, rank of each of ``queries`` (query_id, query); filters (ids) act before the ranking."""
        s = self.settings
        lists = {}
        if s.strategy != "dense":
            lists["lexical"] = search.bm25_search(self.index(), queries, s.candidate_k, "id", allowed, prefix_expansion=s.prefix_expansion)
        if s.strategy != "lexical":
            rows = self.embeddings() if allowed is None else self.embeddings().join(allowed.select("id"), "id", "left_semi")
            lists["dense"] = vectors.cosine_top_k(rows, vectors.hash_embed(queries, "query", dim=s.dim).select("query_id", "embedding"), s.candidate_k)
        hits = fusion.fuse(lists["lexical"], lists["dense"], s.fusion, (s.lexical_weight, s.dense_weight), s.rrf_k) if len(lists) == 2 else next(iter(lists.values()))
        hits = hits.select("query_id", "id", "score", "rank")
        if s.rerank:
            pool = hits.where(F.col("rank") <= s.rerank_top_n).join(self.chunks.select("id", "text", "heading_context", "document_title", "kind"), "id").join(queries.select("query_id", "query"), "query_id")
            hits = rerank.rerank(pool, s.rerank_top_n) if self.reranker is None else rerank.rerank_by(pool, self.reranker, s.rerank_top_n)
            hits = hits.select("query_id", "id", F.col("rerank_score").alias("score"), "rank")
        if s.mmr is not None:
            rows = hits.join(self.embeddings(), "id", "left").join(self.chunks.select("id", F.split(F.lower("text"), "[^a-z0-9]+").alias("tokens")), "id")
            picks = vectors.mmr(rows.select("query_id", "id", "score", "rank", F.col("embedding").cast("array<double>"), "tokens"), s.top_k, s.mmr)
            hits = hits.drop("rank").join(picks.withColumnRenamed("pick", "rank"), ["query_id", "id"])
        hits = hits.where(F.col("rank") <= s.top_k)
        return hits if s.min_score is None else hits.where(F.col("score") >= s.min_score)

    def search(self, queries: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
        """Hits with their chunks."""
        return self.retrieve(queries, allowed).join(self.chunks, "id")

    def timed(self, queries: DataFrame) -> tuple[DataFrame, dict[str, float]]:
        """Hits, and the seconds that each stage of the search took for all queries, each stage written by itself."""
        s, seconds = self.settings, {}

        def stage(name: str, f: Callable[[], DataFrame]) -> DataFrame:
            began = time.perf_counter()
            out = materialise(f(), name)
            seconds[name] = time.perf_counter() - began
            return out

        bare = lambda **changes: Settings(**(vars(s) | {"rerank": False, "mmr": None, "min_score": None, "top_k": s.candidate_k} | changes))
        for name in ("lexical", "dense"):
            if s.strategy in (name, "hybrid"):
                stage(name, lambda n=name: self.with_settings(bare(strategy=n)).retrieve(queries))
        hits = stage("search", lambda: self.retrieve(queries))
        seconds["fusion_and_rerank"] = max(0.0, seconds["search"] - sum(v for k, v in seconds.items() if k != "search"))
        return hits, seconds

    def similar(self, ids: DataFrame, k: int = 8) -> DataFrame:
        """Chunks like given ones (ids)."""
        rows = self.embeddings()
        return vectors.cosine_top_k(rows, rows.join(ids.select("id"), "id", "left_semi").withColumnRenamed("id", "query_id"), k, exclude_self=True)

    def _context(self, queries: DataFrame) -> DataFrame:
        hits = self.search(queries)
        packed = answer.pack(hits.select("query_id", "id", "rank", "text"), self.settings.token_budget)
        return packed.join(self.chunks.select("id", "text", "heading_context", F.col("document_title").alias("label")), "id")

    def ask(self, queries: DataFrame) -> DataFrame:
        """query_id, answer, refused with citations."""
        return answer.extractive_answers(self._context(queries), queries)

    def ask_in_parts(self, queries: DataFrame) -> Iterator[tuple[str, dict]]:
        """Answers as they are read off the cluster, one query after the other: ("delta", query_id and a sentence) for
        each sentence and then ("done", the whole answer and its citations); ("error", ...) ends a stream that fails."""
        try:
            context = materialise(self._context(queries), "context")
            said = answer.extractive_answers(context, queries)
            cited = context.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("marker", "id", "label"))).alias("sources"))
            for r in said.join(cited, "query_id", "left").orderBy("query_id").toLocalIterator():
                for s, *_ in answer.spans(r["answer"]):
                    yield "delta", {"query_id": r["query_id"], "text": s}
                used = {m for *_, ms in answer.spans(r["answer"]) for m in ms}
                yield "done", {"query_id": r["query_id"], "answer": r["answer"], "refused": r["refused"], "citations": [x.asDict() for x in r["sources"] or [] if x["marker"] in used]}
        except Exception as e:  # the terminal event of a stream says what went wrong
            yield "error", {"message": str(e)}

    def verify(self, claims: DataFrame, queries: DataFrame) -> DataFrame:
        """Verdicts on sentences (query_id, idx, text, markers, refused) by the chunks that the queries find."""
        return verify.verify(claims, self._context(queries))

    def documents(self, search_for: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = self.chunks.groupBy("document_id", "collection", "document_title").agg(F.count("*").alias("n_chunks"), F.sum(token_estimate(F.col("text"))).alias("tokens"))
        rows = rows if search_for is None else rows.where(F.col("document_title").ilike(f"%{search_for}%"))
        rows = rows.orderBy("document_title", "document_id").offset(offset)
        return rows if limit is None else rows.limit(limit)

    def stats(self) -> DataFrame:
        return self.chunks.groupBy("collection").agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_chunks"), F.sum(token_estimate(F.col("text"))).alias("tokens"))

    def with_context(self, ids: DataFrame, width: int = 1) -> DataFrame:
        hits = self.chunks.join(ids.select("id"), "id", "left_semi").select("document_id", "ordinal")
        return store.neighbours(self.chunks, hits, "document_id", "ordinal", width)

    def chunk(self, id: int) -> Row:
        """One chunk; a KeyError if there is none."""
        return _only(self.chunks.where(F.col("id") == id), id)

    def document(self, document_id: int) -> Row:
        """One document's row, as in ``documents``; a KeyError if there is none."""
        return _only(self.documents().where(F.col("document_id") == document_id), document_id)

    def document_chunks(self, document_id: int) -> DataFrame:
        return self.chunks.where(F.col("document_id") == document_id).orderBy("ordinal")

    def pages_of_chunks(self, size: int = 500) -> Iterator[list[Row]]:
        """All chunks in order of their ids, read off the cluster a page at a time."""
        rows = self.chunks.orderBy("id").toLocalIterator(prefetchPartitions=True)
        while page := list(islice(rows, size)):
            yield page

    def vectors_of(self, ids: DataFrame) -> DataFrame:
        """id, embedding (unit length) of given chunks; those without a vector are left out."""
        return self.embeddings().join(ids.select("id"), "id", "left_semi").where("embedding IS NOT NULL").select("id", vectors.l2_normalize(F.col("embedding")).alias("embedding"))

    def unembedded(self) -> DataFrame:
        return self.chunks if self._embeddings is None else store.missing(self.chunks, self._embeddings, ["id"])

    def without(self, document_ids: DataFrame) -> Corpus:
        """The corpus without some documents, their chunks and vectors."""
        chunks = self.chunks.join(document_ids.select("document_id"), "document_id", "left_anti")
        kept = None if self._embeddings is None else self._embeddings.join(chunks.select("id"), "id", "left_semi")
        return Corpus(chunks, self.settings, kept, self.events, self.reranker, self.version + 1)

    def added(self, chunks: DataFrame) -> Corpus:
        """The corpus with more chunks; given vectors stay, and those of new chunks are to be added to them."""
        return Corpus(self.chunks.unionByName(chunks), self.settings, self._embeddings, self.events, self.reranker, self.version + 1)

    def heatmap(self) -> DataFrame:
        return telemetry.heatmap(self.events, self.chunks.select(F.col("id").alias("chunk_id")))


def _only(rows: DataFrame, key: object) -> Row:
    found = rows.limit(1).collect()
    if not found:
        raise KeyError(key)
    return found[0]


def valid_queries(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``queries`` with the query trimmed, rows that ask nothing and are to be rejected)."""
    rows = queries.withColumn("query", F.trim("query"))
    blank = F.coalesce(F.col("query"), F.lit("")) == ""
    return rows.where(~blank), rows.where(blank)


def embed_distinct(chunks: DataFrame, dim: int) -> tuple[DataFrame, Observation]:
    """(id, embedding of every chunk; an observation of hits and misses): each text is embedded once."""
    rows = chunks.select("id", "text", content_hash(F.col("text")).alias("hash"))
    once = vectors.hash_embed(rows.groupBy("hash").agg(F.first("text").alias("text"), F.count("*").alias("n")), dim=dim)
    seen = Observation("embedding cache")
    once = once.observe(seen, F.count("*").alias("misses"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"))
    return rows.join(once.select("hash", "embedding"), "hash", "left").select("id", "embedding"), seen


def merged_reports(reports: DataFrame) -> DataFrame:
    """One row of several ingestions' reports (n_documents, n_chunks, n_skipped, errors): sums, and all errors."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_documents", "n_chunks", "n_skipped")]
    return reports.agg(*sums, F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors"))


def ingestion_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """n_documents and n_chunks that came in, n_skipped (blank, repeated or known documents), no errors."""
    made = chunks.agg(F.countDistinct("document_id").alias("n_documents"), F.count("*").alias("n_chunks"))
    return made.crossJoin(F.broadcast(documents.agg(F.count("*").alias("given")))).select("n_documents", "n_chunks", (F.col("given") - F.col("n_documents")).alias("n_skipped"), F.array().cast("array<string>").alias("errors"))


def ingest(documents: DataFrame, chunker: str = "recursive", collection: str = "default", known: DataFrame | None = None, **options) -> DataFrame:
    """Chunks of documents (uri, title, text, source_type), with ids from contents, so that a retry makes the same
    rows. Blank texts, repeated (uri, text) pairs and pairs that ``known`` (content_hash) has are left out."""
    from loomwright.functions.chunking import chunk_documents

    mark = F.sha2(F.concat("uri", F.lit("\u0000"), "text"), 256)
    rows = documents.where(F.trim("text") != "").withColumn("content_hash", mark).dropDuplicates(["content_hash"])
    if known is not None:
        rows = rows.join(known.select("content_hash"), "content_hash", "left_anti")
    cut = chunk_documents(rows, chunker, id_col="content_hash", **options)
    about = rows.select("content_hash", "uri", F.col("title").alias("document_title"), "source_type")
    cut = cut.withColumnRenamed("doc", "content_hash").join(about, "content_hash")
    key = lambda *c: F.conv(F.left(F.sha2(F.concat_ws("\u0000", F.lit(collection), *c), 256), F.lit(15)), 16, 10).cast("long")
    return cut.select(
        key("uri", "content_hash", F.col("ordinal").cast("string")).alias("id"), key("uri", "content_hash").alias("document_id"), F.lit(collection).alias("collection"), "content_hash", "uri", "document_title",
        "source_type", "ordinal", "text", "kind", F.array_join("heading_path", " › ").alias("heading_context"), "char_start", "char_end", "line_start", "line_end", "heading_path", "symbol",
    )
