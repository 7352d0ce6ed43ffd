"""Spanloom: stand-off annotation and knowledge-graph analytics on PySpark."""

__version__ = "0.1.0"
