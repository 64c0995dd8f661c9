"""Retrieval analytics over text corpora, expressed as Spark DataFrame operators."""
