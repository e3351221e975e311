"""A training-data pipeline over ``documents``: quality rules, line dedup, near duplicates, benchmark
decontamination, BPE encoding. Each stage takes (spark, docs, sf_dir), works on all that the stage before kept,
and is written to the shared folder as Parquet before the next one reads it.

Nulls, empty and very long texts, repeated rows, empty tables and more columns are handled as the operators say;
rows without a doc_id pass near-duplicate removal and decontamination unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomwright.llm import bpe, chosen_path, decontaminate, line_dedup, quality_rules
from loomwright.llm.queries import tokenizer_file
from loomwright.session import scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.apply_rules(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their host go; documents stay."""
    return line_dedup.clean_pages(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest id."""
    return chosen_path.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of each document that is left."""
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the Jaccard join at this size nor byte-pair merging; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as tables:  # what a stage writes on the way goes with it
            docs = tables.keep(stage(spark, docs, sf_dir), f"stage{number}", compact=False)
    return STAGES[-1][1](spark, docs, sf_dir)
