"""Voxloom: narrative text to structured, queryable dialogue data on Spark."""

__version__ = "0.1.0"
