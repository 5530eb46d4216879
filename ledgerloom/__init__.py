"""Spark-first analytics over semi-structured financial documents and retrieval tables."""
