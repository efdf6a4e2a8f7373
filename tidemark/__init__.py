"""Tidemark: log normalisation, evidence and analytics as Spark DataFrame jobs."""
