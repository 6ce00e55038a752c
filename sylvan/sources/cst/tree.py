"""Syntax trees and their rows."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

#: Texts of longer nodes aren't kept in the table of nodes; they are cut from the file when needed.
KEPT_TEXT = 200


class Node:
    """A named node: kind, field in its parent (or None), span in characters, named children in order."""

    __slots__ = ("end", "field", "kids", "kind", "start")

    def __init__(self, kind: str, start: int, end: int, kids: list[Node] | None = None, field: str | None = None):
        self.kind, self.start, self.end, self.kids, self.field = kind, start, end, kids or [], field

    def get(self, field: str) -> Node | None:
        return next((k for k in self.kids if k.field == field), None)

    def all(self, field: str) -> list[Node]:
        return [k for k in self.kids if k.field == field]

    def of(self, *kinds: str) -> list[Node]:
        return [k for k in self.kids if k.kind in kinds]

    def text(self, source: str) -> str:
        return source[self.start : self.end]

    def __repr__(self) -> str:
        return f"({self.field + ': ' if self.field else ''}{self.kind}{''.join(' ' + repr(k) for k in self.kids)})"


class Lines:
    """Line numbers (from 1) of offsets."""

    def __init__(self, source: str):
        self.starts = [0]
        at = source.find("\n")
        while at >= 0:
            self.starts.append(at + 1)
            at = source.find("\n", at + 1)

    def __call__(self, offset: int) -> int:
        return bisect_right(self.starts, offset)


def put_comments(root: Node, comments: list[Node]) -> None:
    """Comments become children of the innermost nodes that hold them."""
    for c in comments:
        at = root
        while True:
            inner = next((k for k in at.kids if k.start <= c.start and c.end <= k.end and k.kids), None)
            if inner is None:
                break
            at = inner
        i = 0
        while i < len(at.kids) and at.kids[i].start < c.start:
            i += 1
        at.kids.insert(i, c)


def rows(root: Node, source: str) -> Iterator[tuple]:
    """(node_id, last_desc, parent_id, depth, kind, field, named_idx, start_pos, end_pos, start_line,
    end_line, text) in preorder. x lies in a exactly if a.node_id <= x.node_id <= a.last_desc."""
    starts = Lines(source).starts
    nodes: list[Node] = []
    places: list[tuple[int, int, int]] = []  # parent, depth, index among its siblings
    stack = [(root, -1, 0, 0)]
    while stack:
        node, *place = stack.pop()
        me = len(nodes)
        nodes.append(node)
        places.append(place)
        if node.kids:
            below = place[1] + 1
            stack += [(k, me, below, i) for i, k in enumerate(node.kids)][::-1]
    last = list(range(len(nodes)))
    for i in range(len(nodes) - 1, 0, -1):
        p = places[i][0]
        if last[i] > last[p]:
            last[p] = last[i]
    for i, (node, (parent, depth, index)) in enumerate(zip(nodes, places, strict=True)):
        start, end = node.start, node.end
        first = final = bisect_right(starts, start)
        if first < len(starts) and end >= starts[first]:
            final = bisect_right(starts, end, first)
        yield i, last[i], parent, depth, node.kind, node.field, index, start, end, first, final, source[start:end] if end - start <= KEPT_TEXT else None
