"""Trellisq: a PySpark-native engine for typed property graphs, documents and vectors."""

__version__ = "0.1.0"
