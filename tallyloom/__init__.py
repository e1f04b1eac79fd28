"""Spark engine for back-office data: sync, ingestion, exploration, normalisation, evaluation."""
