"""Spark-first engine for grounded question answering and claim verification data."""

__version__ = "0.1.0"
