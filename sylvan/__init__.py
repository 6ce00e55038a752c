"""Structural code search and call-graph analysis on PySpark."""
