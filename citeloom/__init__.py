"""Citeloom: research, source-code and operations analytics as PySpark jobs."""

__version__ = "0.1.0"
