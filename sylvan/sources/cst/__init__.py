"""Tolerant parsers that give concrete syntax trees of six languages."""

from sylvan.sources.cst.tree import Node, rows
from sylvan.sources.cst.parse import parse

__all__ = ["Node", "parse", "rows"]
