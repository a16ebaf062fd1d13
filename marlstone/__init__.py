"""Spark-first document ingest, hybrid retrieval and evaluation engine."""

__version__ = "0.1.0"
