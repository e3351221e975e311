"""Corpus analytics on Spark: ingestion, retrieval, answering, evaluation."""
