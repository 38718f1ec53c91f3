"""Granary: retrieval, evaluation and text-ingest operators as Spark DataFrame plans."""
