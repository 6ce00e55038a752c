"""What the parsers share: tokens, a cursor, brackets, and tolerance.

A parser never fails. What it can't read becomes an ERROR node of one token, and
every loop that reads a list makes sure that it moved on.
"""

from __future__ import annotations

import re

from sylvan.sources.cst.tree import Node

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Nesting beyond which brackets are one ERROR node without structure.
DEEP = 10_000


class Token:
    __slots__ = ("after_line", "end", "start", "text", "type")

    def __init__(self, type_: str, text: str, start: int, end: int, after_line: bool):
        self.type, self.text, self.start, self.end, self.after_line = type_, text, start, end, after_line


class Parser:
    """Subclasses give ``TOKENS`` (groups named by token type; skip, comment and line are special),
    and ``file``."""

    TOKENS: re.Pattern
    ROOT = "source_file"
    COMMENT = "comment"

    def __init__(self, source: str):
        self.source = source
        self.comments: list[Node] = []
        self.toks: list[Token] = []
        self.i = 0
        self.depth = 0
        self.scan()
        end = len(source)
        # more than one, so that a step past a bracket that never closes stays in the list
        self.toks += [Token("end", "", end, end, True) for _ in range(3)]

    def scan(self) -> None:
        at, n, new_line, match = 0, len(self.source), True, self.TOKENS.match
        while at < n:
            m = match(self.source, at)
            if m is None:
                at += 1
                continue
            kind, text, start, at = m.lastgroup, m.group(), at, m.end()
            if at == start:
                at += 1
                continue
            if kind == "skip":
                new_line = new_line or "\n" in text
            elif kind == "comment":
                self.comments.append(Node(self.comment_kind(text), start, at))
                new_line = new_line or "\n" in text
            else:
                if kind == "raw":
                    at = self.raw_end(text, start, at)
                    kind, text = "string", self.source[start:at]
                self.toks.append(self.made(Token(kind, text, start, at, new_line)))
                new_line = False

    def made(self, token: Token) -> Token:
        return token

    def comment_kind(self, text: str) -> str:
        return self.COMMENT

    def raw_end(self, text: str, start: int, at: int) -> int:
        return at

    # ---- cursor

    @property
    def t(self) -> Token:
        return self.toks[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.i + n, len(self.toks) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.toks[self.i]
        return t.text in texts and t.type != "string" and t.type != "end"

    def end(self) -> bool:
        return self.toks[self.i].type == "end"

    def next(self) -> Token:
        t = self.toks[self.i]
        if t.type != "end":
            self.i += 1
        return t

    def eat(self, *texts: str) -> bool:
        if self.at(*texts):
            self.i += 1
            return True
        return False

    def back(self) -> int:
        """Where the last token ended."""
        return self.toks[self.i - 1].end if self.i else 0

    def leaf(self, kind: str, field: str | None = None) -> Node:
        t = self.next()
        return Node(kind, t.start, t.end, None, field)

    def node(self, kind: str, start: int, kids: list[Node | None], field: str | None = None) -> Node:
        return Node(kind, start, max(start, self.back()), [k for k in kids if k is not None], field)

    def error(self) -> Node:
        return self.leaf("ERROR")

    @staticmethod
    def tag(node: Node | None, field: str) -> Node | None:
        if node is not None:
            node.field = field
        return node

    # ---- brackets

    pairs: dict[int, int] | None = None

    def closing(self, i: int) -> int:
        """Number of the token that closes the bracket at token i (the end, if none does)."""
        if self.pairs is None:
            self.pairs, opened = {}, []
            for k, t in enumerate(self.toks):
                if t.type == "op":
                    if t.text in OPEN:
                        opened.append(k)
                    elif t.text in CLOSE and opened:
                        self.pairs[opened.pop()] = k
            self.pairs |= dict.fromkeys(opened, len(self.toks) - 3)
        return self.pairs[i] if i in self.pairs else self.scan_closing(i)

    def scan_closing(self, i: int) -> int:
        depth, n = 0, len(self.toks)
        while i < n:
            t = self.toks[i]
            if t.type == "op":
                if t.text in OPEN:
                    depth += 1
                elif t.text in CLOSE:
                    depth -= 1
                    if depth <= 0:
                        return i
            i += 1
        return n - 3

    def skip_brackets(self) -> None:
        self.i = min(self.closing(self.i) + 1, len(self.toks) - 1)

    def many(self, stop: str, item, separators: tuple[str, ...] = (",",)) -> list[Node]:
        """Items up to the closing token, which is eaten."""
        out: list[Node] = []
        self.depth += 1
        while not self.end() and not self.at(stop):
            before = self.i
            if self.depth > DEEP and self.t.text in OPEN and self.t.type == "op":
                start = self.t.start
                self.skip_brackets()
                out.append(self.node("ERROR", start, []))
            elif self.t.type == "op" and self.t.text in CLOSE and self.t.text != stop:
                # a bracket that closes something outside: leave it to its owner
                if self.outer_closes(self.t.text):
                    break
                out.append(self.error())
            else:
                x = item()
                if isinstance(x, list):
                    out += x
                elif x is not None:
                    out.append(x)
            while self.at(*separators):
                self.next()
            if self.i == before:
                out.append(self.error())
        self.depth -= 1
        self.eat(stop)
        return out

    def outer_closes(self, text: str) -> bool:
        return self.depth > 1 and text == "}"

    def run(self) -> Node:
        kids = self.file()
        return Node(self.ROOT, 0, len(self.source), kids)

    def file(self) -> list[Node]:
        raise NotImplementedError
