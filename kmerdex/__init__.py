"""Exact, colored de Bruijn graph indexes of sequence collections as Spark tables."""

__version__ = "0.1.0"
