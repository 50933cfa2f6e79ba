"""Siltstone: evidence analytics and large-table record operators on PySpark DataFrames."""

__version__ = "0.1.0"
