"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, chosen_path, decontaminate, html_text, license_scan, line_dedup, lm_scores, quality_rules, suffix_dedup, token_counts
from loomwright.session import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"))
    clean = F.coalesce("clean", F.lit(""))
    return done.select("__row.doc_id", "n_lines", "n_removed", F.length(clean).cast("long").alias("n_chars_kept"), F.sha2(clean, 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return pairs.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.quality_report(table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, named through the package that holds them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), kind=token_counts.Merges)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), digest=True)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


_ALL: list[Callable[[SparkSession, str], DataFrame]] = [op1_license_scan, op2_line_dedup, op3_decontaminate, op4_suffix_dedup, op5_lm_scores, op6_quality_rules, op7_token_counts, op8_bpe, op9_html_text, op10_chosen_path]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in _ALL} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op2_line_dedup": line_dedup.ORACLE,
        "op3_decontaminate": decontaminate.ORACLE,
        "op6_quality_rules": quality_rules.oracle(),
    }
