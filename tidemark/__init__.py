"""Tidemark: whole-table copies as Spark jobs, with a durable high-water mark."""

__version__ = "0.1.0"
