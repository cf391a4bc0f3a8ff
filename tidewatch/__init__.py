"""Observability analytics as PySpark DataFrame operators."""
