"""Spark-first retrieval and corpus-processing engine."""
