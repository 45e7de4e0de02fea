"""Similarity analytics over source trees, expressed as Spark DataFrame plans."""
