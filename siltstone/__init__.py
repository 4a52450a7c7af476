"""Siltstone: corpus and retrieval analytics as Spark DataFrame plans."""
