"""Corpus text analytics as Spark DataFrame operators."""
