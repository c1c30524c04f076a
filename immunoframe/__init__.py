"""Immune-repertoire analytics as Spark DataFrame transformations."""
