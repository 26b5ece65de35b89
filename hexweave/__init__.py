"""hexweave: analytics over H3-indexed tables, written as PySpark DataFrame operators."""

__version__ = "0.1.0"
