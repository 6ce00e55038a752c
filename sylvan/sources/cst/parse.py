"""Parser of each language."""

from __future__ import annotations

import sys

from sylvan.sources.cst.c_family import C, Cpp
from sylvan.sources.cst.go import Go
from sylvan.sources.cst.javascript import JavaScript
from sylvan.sources.cst.python import Python
from sylvan.sources.cst.rust import Rust
from sylvan.sources.cst.tree import Node, put_comments

#: Frames of the interpreter that a tree may take.
FRAMES = 200_000
PARSERS = {"c": C, "cpp": Cpp, "go": Go, "javascript": JavaScript, "python": Python, "rust": Rust}


def parse(source: str, lang: str) -> Node:
    """The tree of a file. Never fails: what can't be read is an ERROR node, and a tree nested beyond
    the interpreter's stack is its root alone."""
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)  # frames of Python functions are on the heap
    try:
        parser = PARSERS[lang](source)
        root = parser.run()
        put_comments(root, parser.comments)
    except RecursionError:
        root = Node(PARSERS[lang].ROOT, 0, len(source), [Node("ERROR", 0, len(source))])
    return root
